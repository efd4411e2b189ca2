"""The tracing engine on hand-written lines."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usage_trace import trace
from usage_trace.functions import extract
from usage_trace.functions.classify import usage
from usage_trace.functions.text import lines as split_lines
from usage_trace.functions.text import strip
from usage_trace.operators import aliases, java_structure, quality, scopes
from usage_trace.operators.java_structure import Structure, structures
from usage_trace.operators.tokens import tokens
from usage_trace.plans.trace import language
from usage_trace.schema import DIRECT, GETTER, INDIRECT, SETTER
from usage_trace.sources import scratch
from usage_trace.sources.encoding import sniff
from usage_trace.sources.hits import count_hits, parse_hits, read_hits
from usage_trace.sources.results import read_results, sorted_records, write_result_file, write_results


def tree(spark, files):
    rows = [(path, i, line) for path, text in files.items() for i, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "filepath string, lineno int, line string")


def hits_of(spark, *rows):
    return spark.createDataFrame(list(rows), "keyword string, value string")


def short(records):
    return sorted((r.ref_type, r.usage_type, r.filepath, int(r.lineno), r.src_var) for r in records.collect())


LABELS = [
    ("java", "@Name(X)", "アノテーション"),
    ("java", "x = a == b;", "条件判定"),
    ("java", "/* nothing */", "その他"),
    ("kotlin", 'const val A = "1"', "const定数定義"),
    ("kotlin", "val a = A", "変数代入"),
    ("c", "#define A 1", "#define定数定義"),
    ("c", "a[1] = 2;", "変数代入"),
    ("c", "a == 2", "その他"),
    ("c", "switch (a)", "条件判定"),
    ("proc", "switch (a)", "関数引数"),
    ("proc", "exec sql select 1", "EXEC SQL文"),
    ("sql", "x := 1", "定数・変数定義"),
    ("sql", "case a when 1", "比較・DECODE"),
    ("sh", "export A=1", "環境変数エクスポート"),
    ("sh", "A=1", "変数代入"),
    ("sh", "run this", "コマンド引数"),
    ("ts", "const a = 1", "const定数定義"),
    ("ts", "a === 1", "条件判定"),
    ("python", "x == 1", "変数代入"),
    ("python", "if x:", "条件判定"),
    ("perl", "use strict;", "その他"),
    ("perl", "use constant A => 1;", "use constant定義"),
    ("dotnet", "[Attr]", "属性(Attribute)"),
    ("groovy", "return a == b", "変数代入"),
    ("plsql", "cursor c is select", "カーソル定義"),
    ("none", "if (x)", "その他"),
    ("kotlin", "　return 1　", "return文"),
]


def test_labels(spark):
    for lang in sorted({x[0] for x in LABELS}):
        own = [x for x in LABELS if x[0] == lang]
        got = spark.createDataFrame([(i, x[1]) for i, x in enumerate(own)], "i int, line string").select("i", usage(F.col("line"), lang).alias("u")).orderBy("i").collect()
        assert [(x[1], r.u) for x, r in zip(own, got)] == [(x[1], x[2]) for x in own]


NAMES = [
    (extract.java_name, "public static final String CODE = \"1\";", "CODE"),
    (extract.java_name, "private String type;", "type"),
    (extract.java_name, "x = 1;", None),
    (extract.c_variable, "unsigned int x = 1;", "int"),
    (extract.c_variable, "char *p = s;", "p"),
    (extract.c_define, "#define A 1", "A"),
    (extract.c_define, "#define A", None),
    (extract.proc_host_variable, "EXEC SQL SELECT a into :hv", "hv"),
    (extract.ts_const, "export const A: string = 'x'", "A"),
    (extract.ts_const, "const {a} = b", None),
    (extract.python_const, "A_B = 1", "A_B"),
    (extract.python_const, "ab = 1", None),
    (extract.python_const, "A == 1", None),
    (extract.perl_our, "our $A = 1;", "A"),
    (extract.dotnet_const, 'Public Const A As String = "1"', "A"),
    (extract.groovy_field, "private String a = 1", "a"),
    (extract.plsql_const, " c_a constant number := 1;", "c_a"),
    (extract.sql_variable, "v_a VARCHAR2(10) := 'x';", "v_a"),
    (extract.sh_variable, "setenv A b", "A"),
    (extract.getter_of, "type", "getType"),
]


def test_names(spark):
    for f, line, name in NAMES:
        got = spark.createDataFrame([(line,)], "line string").select(f(F.col("line")).alias("n")).first().n
        assert got == name, (f.__name__, line)
    line = "use constant { A => 1, B => 2 };"
    assert spark.createDataFrame([(line,)], "line string").select(extract.perl_const_names(F.col("line")).alias("n")).first().n == ["A", "B"]


def test_hits(spark, tmp_path):
    values = ["a/b.c:12: x ", "C:/a/b.c:12:x:3:y", "", "   ", "Binary file x matches", ":12:x", "no number", "a\0b:1:x", "p" * 5000 + ":1:x"]
    rows = parse_hits(hits_of(spark, *[("k", v) for v in values])).select("filepath", "lineno", "code").collect()
    assert sorted(map(tuple, rows)) == [("C:/a/b.c", "12", "x:3:y"), ("a/b.c", "12", "x")]
    assert tuple(count_hits(hits_of(spark, *[("k", v) for v in values])).first()) == ("k", 9, 2, 7)
    (tmp_path / "WORD.grep").write_bytes("\ufeffa.c:1:日本\r\nb.c:2:y\n".encode())
    assert sorted((r.keyword, r.value) for r in read_hits(spark, str(tmp_path)).collect()) == [("WORD", "a.c:1:日本"), ("WORD", "b.c:2:y")]
    (tmp_path / "WORD.grep").write_bytes("a.c:1:日本\r\n".encode("cp932"))
    assert read_hits(spark, str(tmp_path), "cp932").first().value == "a.c:1:日本"


def test_encodings_of_hit_files(spark, tmp_path):
    text = "a.c:1:日本語の文字列をここに書く\r\nb.c:2:カタカナ x\r\n"
    want = ["a.c:1:日本語の文字列をここに書く", "b.c:2:カタカナ x"]
    for name in ("utf-8", "utf-8-sig", "cp932", "euc_jp", "iso2022_jp", "utf-16", "utf-16-le", "utf-16-be"):
        (tmp_path / f"{name}.grep").write_bytes(text.encode(name))
    (tmp_path / "west.grep").write_bytes("a.c:1:caf\xe9 cr\xe8me\r\n".encode("cp1252"))
    (tmp_path / "empty.grep").write_bytes(b"")
    got = {}
    for r in read_hits(spark, str(tmp_path)).collect():
        got.setdefault(r.keyword, []).append(r.value)
    assert {k: [x for x in sorted(v) if x] for k, v in got.items() if k != "west"} == {n: want for n in ("utf-8", "utf-8-sig", "cp932", "euc_jp", "iso2022_jp", "utf-16", "utf-16-le", "utf-16-be")} | ({"empty": []} if "empty" in got else {})
    assert [x for x in got["west"] if x] == ["a.c:1:café crème"]


def test_command(spark, tmp_path):
    from usage_trace import cli

    for folder in ("hits", "src"):
        (tmp_path / folder).mkdir()
    (tmp_path / "hits" / "V.grep").write_text('A.kt:1:const val A = "V"\n')
    (tmp_path / "hits" / "NONE.grep").write_text("")
    (tmp_path / "src" / "A.kt").write_text('const val A = "V"\nval b = A\n')
    args = ["--input", str(tmp_path / "hits"), "--source", str(tmp_path / "src"), "--output", str(tmp_path / "out")]
    cli.run(spark, cli.parser().parse_args(args))
    assert (tmp_path / "out" / "V.tsv").read_bytes().count(b"\r\n") == 3 and (tmp_path / "out" / "NONE.tsv").read_bytes().count(b"\r\n") == 1
    assert cli.main(["--input", str(tmp_path), "--source", str(tmp_path), "--output", "x"]) == 1 and cli.main([]) == 1


def test_prefilter(spark):
    from usage_trace.operators.tokens import prefilter

    lines = tree(spark, {"a": "xFOOx b", "b": "f(a.b, 1)", "c": "q", "d": "日FOO"})
    files = lambda *names: sorted(r.filepath for r in prefilter(lines, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert files("FOO") == ["a", "d"] and files("a.b", "q") == ["b", "c"] and files("b") == ["a", "b"] and files("日") == ["a", "b", "c", "d"] and files("nowhere") == []


def test_scan_of_constants_alone(spark):
    lines = tree(spark, {"A.java": 'static final String N = "V";\nN();\nx = N;'})
    got = lambda **how: sorted(x[3] for x in short(trace(hits_of(spark, ("V", 'A.java:1:static final String N = "V";')), lines, **how)) if x[0] == INDIRECT)
    assert got() == [3] and got(combined=False) == [2, 3]


def test_tasks_beyond_the_broadcast(spark, monkeypatch):
    from usage_trace.operators import track

    lines = tree(spark, {"A.kt": 'const val A = "V"\nval b = A + A', "a.sh": "V=x\necho ${V} $V", "p.pl": "our $A = 1;\nprint $A;\nA();"})
    hits = hits_of(spark, ("V", 'A.kt:1:const val A = "V"'), ("x", "a.sh:1:V=x"), ("1", "p.pl:1:our $A = 1;"))
    few = short(trace(hits, lines))
    monkeypatch.setattr(track.uses, "__defaults__", (False, 0))
    assert short(trace(hits, lines)) == few and len(few) == 7


def test_families_in_turn(spark, monkeypatch):
    """Sums of a mixed tree, a family of languages at a time, are those of the whole trace; a write leaves no shuffle files."""
    from usage_trace.operators import track
    from usage_trace.plans.languages import SPECS, families
    from usage_trace.plans.trace import FAMILY, family, summed_up
    from usage_trace.sources.scratch import written

    ends = [e for _, own in families() for e in own]
    assert len(ends) == len(set(ends)) and sorted(s.name for own, _ in families() for s in own) == sorted(s.name for s in SPECS)
    assert {"c", "proc"} in [{s.name for s in own} for own, _ in families()]
    lines = tree(spark, {
        "a.kt": 'const val A = "k"\nval x = A + A', "b.kt": "return A", "d.c": '#define D "k"\n#define E D\nif (E > 1) {', "d.pc": 'y = D;\n#define F "k"', "d.h": "g(F, E);",
        "run": '#!/bin/sh\nV="k"\necho ${V} A', "old": '#!/usr/bin/perl\nuse constant P => "k";', "p.pl": "print P;", "n.txt": 'A "k"', "Q.SQL": 'v_q VARCHAR2(9) := "k";\nV_Q := 1;',
    })
    found = lines.where(F.contains("line", F.lit('"k"'))).select(F.lit("k").alias("keyword"), F.concat_ws(":", "filepath", F.col("lineno").cast("string"), "line").alias("value"))
    by = lambda records: records.groupBy("keyword", "ref_type", "usage_type", "filepath", "lineno", "code", "src_var", "src_file").count()
    whole = sorted(map(tuple, by(trace(found, lines)).collect()))
    assert {r[3] for r in whole} == {"a.kt", "b.kt", "d.c", "d.pc", "d.h", "run", "old", "p.pl", "n.txt", "Q.SQL"}
    kept = written([lines.where("filepath < 'd'"), lines.where("filepath >= 'd'")], "tree", **{FAMILY: family(F.col("filepath"))})
    for most in (track.FEW, 0):
        monkeypatch.setattr(track.uses, "__defaults__", (False, most))
        assert sorted(map(tuple, summed_up(found, lines, by).collect())) == whole
        assert sorted(map(tuple, summed_up(found, kept, by).collect())) == whole
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    before = blocks()
    written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert blocks() <= before


def test_boundaries_and_plain_searches(spark):
    """Shortened boundaries and the search before a pattern change no label."""
    import random
    import re

    from usage_trace.functions.classify import RULES
    from usage_trace.functions.text import literals

    r = random.Random(4)
    parts = ["if", "while", "(", "return", "static", "final", " ", "x", "=", "==", "日", "_", "@", "const", "val", "print", "#", "define", "$", "eq", "-eq", "use", "é", "1", "Dim", "export", "."]
    code = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(code)], "i int, line string")
    for lang in ("java", "sh", "perl", "dotnet", "kotlin"):
        want = [next((label for p, label in RULES[lang] if re.search(p, x.strip())), "その他") for x in code]
        assert [x.u for x in df.select("i", usage(F.col("line"), lang).alias("u")).orderBy("i").collect()] == want
    for p in (p for rules in RULES.values() for p, _ in rules):
        if literals(p):
            assert all(any(x in line for x in literals(p)) for line in code if re.search(p.removeprefix("(?i)"), line))


def test_text(spark):
    row = spark.createDataFrame([("　a\x1f ", "x\r\ny\x0cz\u2028\n")], "s string, t string").select(strip(F.col("s")).alias("s"), split_lines(F.col("t")).alias("l")).first()
    assert row.s == "a" and row.l == ["x", "y", "z", ""]
    assert sniff("日本".encode()) == "utf-8" and sniff("日本語の".encode("cp932")) == "cp932" and sniff(b"\xef\xbb\xbfa") == "utf-8-sig"


def test_language(spark):
    rows = [("a/B.JAVA", None, "java"), ("x.xml", None, "none"), ("run", "#!/usr/bin/env perl", "perl"), ("run", "#! /bin/ksh93", "sh"), ("run", None, "none"), (".h", None, "none"), ("a.b/c", None, "none")]
    got = spark.createDataFrame([(i, p, f) for i, (p, f, _) in enumerate(rows)], "i int, p string, f string").orderBy("i").select(language(F.col("p"), F.col("f")).alias("l")).collect()
    assert [r.l for r in got] == [x[2] for x in rows]


def test_tokens(spark):
    rows = tokens(tree(spark, {"a": "$A b(A (日A A=1"})).select("tok", "sigil", "paren").collect()
    assert [tuple(r) for r in rows] == [("A", True, False), ("b", False, True), ("A", False, True), ("日A", False, False), ("A", False, False), ("1", False, False)]


def test_kotlin(spark):
    lines = tree(spark, {"A.kt": 'const val A = "V"\nval b = A + A', "B.kts": "if (x == A) {\nxA", "C.java": "A"})
    got = trace(hits_of(spark, ("V", 'A.kt:1:const val A = "V"')), lines)
    assert short(got) == sorted([(DIRECT, "const定数定義", "A.kt", 1, ""), (INDIRECT, "変数代入", "A.kt", 2, "A"), (INDIRECT, "変数代入", "A.kt", 2, "A"), (INDIRECT, "条件判定", "B.kts", 1, "A")])
    once = trace(hits_of(spark, ("V", 'A.kt:1:const val A = "V"')), lines, per_line=True)
    assert once.count() == 3


def test_two_keywords_and_roots(spark):
    lines = tree(spark, {"a.py": "A = 'V W'\nprint(A)"})
    got = trace(hits_of(spark, ("V", "src/a.py:1:A = 'V W'"), ("W", "./a.py:1:A = 'V W'"), ("X", "gone.py:1:B = 1")), lines, roots=("src",))
    assert short(got.where("ref_type = '間接'")) == [(INDIRECT, "関数引数", "a.py", 2, "A")] * 2


def test_aliases(spark):
    lines = tree(spark, {"a.c": '#define A "V"\n#define B A\n#define C B\nf(C, B);', "b.pc": "EXEC SQL :A"})
    got = trace(hits_of(spark, ("V", 'a.c:1:#define A "V"')), lines)
    assert sorted(x[2:] for x in short(got) if x[0] == INDIRECT) == [("a.c", 2, "A"), ("a.c", 2, "B"), ("a.c", 3, "B"), ("a.c", 3, "C"), ("a.c", 4, "B"), ("a.c", 4, "C"), ("b.pc", 1, "A")]
    edges = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "alias string, target string")
    names = spark.createDataFrame([("A",)], "name string")
    for f in (aliases.closure, aliases.closure_sql):
        assert sorted(map(tuple, f(names, edges).select("name", "alias", "depth").collect())) == [("A", "B", 1), ("A", "C", 2)]


def test_same_file(spark):
    lines = tree(spark, {"a.sh": "V=x\necho ${V}\necho $VA $V\n$V $V", "b.sh": "echo $V", "q.sql": "v_a VARCHAR2(1) := 'x';\nSELECT V_A", "c.c": "int n = 1;\nn = n + 2;"})
    got = trace(hits_of(spark, ("x", "a.sh:1:V=x"), ("x", "q.sql:1:v_a VARCHAR2(1) := 'x';"), ("x", "c.c:1:int n = 1;")), lines)
    assert sorted(x[2:] for x in short(got) if x[0] == INDIRECT) == [("a.sh", 2, "V"), ("a.sh", 3, "V"), ("a.sh", 4, "V"), ("c.c", 2, "n"), ("q.sql", 2, "v_a")]


def test_perl_sigil_and_plsql_case(spark):
    lines = tree(spark, {"a.pl": "our $A = 1;\nprint $A;\nA();", "b.pks": "c_a CONSTANT NUMBER := 1;\nx := C_A;"})
    got = trace(hits_of(spark, ("1", "a.pl:1:our $A = 1;"), ("1", "b.pks:1:c_a CONSTANT NUMBER := 1;")), lines)
    assert sorted(x[2:] for x in short(got) if x[0] == INDIRECT) == [("a.pl", 2, "A"), ("b.pks", 2, "c_a")]


def test_groovy_accessors(spark):
    lines = tree(spark, {"F.groovy": 'private String a = "V"\nString read() {\nreturn this.a\n}', "U.groovy": "x.getA() + x.read()\nx.setA(1)\ngetA plain"})
    got = trace(hits_of(spark, ("V", 'F.groovy:1:private String a = "V"')), lines)
    assert [x for x in short(got) if x[0] in (GETTER, SETTER)] == sorted([(GETTER, "メソッド引数", "F.groovy", 2, "read"), (GETTER, "メソッド引数", "U.groovy", 1, "getA"), (GETTER, "メソッド引数", "U.groovy", 1, "read"), (SETTER, "メソッド引数", "U.groovy", 2, "setA")])


JAVA = """class A {
  private String type = "V";
  static final int N = 1;
  String kind() {
    return type;
  }
  void put(String v) {
    this.type = v;
    String s = "V";
    if (s == null) { g(s); }
  }
  @Tag(N)
  void other() { s(); }
}"""


def test_java_structure():
    s = Structure(JAVA)
    assert s.ok and s.starts == [4, 7, 12]
    assert s.usage[2] == "変数代入" and s.scope[2] == "class" and s.usage[3] == "定数定義" and s.usage[5] == "return文"
    assert s.scope[9] == "method" and s.usage[10] == "条件判定" and s.usage[12] == "アノテーション"
    assert ("kind", "type") in s.returns and ("put", "type") in s.assigns
    assert not Structure("class A { (").ok and not Structure("").ok


def test_java(spark):
    lines = tree(spark, {"A.java": JAVA, "B.java": "class B { void f(A a) { a.kind(); a.put(1); a.getType(); N(); x = N; } }"})
    files = spark.createDataFrame([("A.java", JAVA), ("B.java", "class B { void f(A a) { a.kind(); } }")], "filepath string, text string")
    got = trace(hits_of(spark, ("V", 'A.java:2:  private String type = "V";'), ("V", 'A.java:9:    String s = "V";'), ("1", "A.java:3:  static final int N = 1;")), lines, structure=structures(files))
    rows = sorted((x[0], x[2], x[3], x[4]) for x in short(got) if x[0] != DIRECT)
    assert rows == sorted([(INDIRECT, "A.java", 5, "type"), (INDIRECT, "A.java", 8, "type"), (INDIRECT, "A.java", 10, "s"), (GETTER, "A.java", 4, "kind"), (GETTER, "B.java", 1, "kind"), (GETTER, "B.java", 1, "getType"), (SETTER, "A.java", 7, "put"), (SETTER, "B.java", 1, "put"), (INDIRECT, "A.java", 12, "N"), (INDIRECT, "B.java", 1, "N")])


def test_method_ranges(spark):
    lines = tree(spark, {"a": "f() {\nx {\n}\n}\ng() { }\nh() {\n}"})
    starts = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6)], "filepath string, start_line int")
    assert sorted(tuple(r)[1:] for r in scopes.method_ranges(starts, lines).collect()) == [(1, 4), (5, 7), (6, 7)]


def test_results(spark, tmp_path):
    lines = tree(spark, {"A.kt": 'const val A = "V"\nval b = A', "B.kt": 'f("q\t", A)'})
    records = trace(hits_of(spark, ("V", 'A.kt:1:const val A = "V"')), lines)
    shuffled = records.repartition(7)
    assert sorted_records(records).collect() == sorted_records(shuffled).collect()
    path = str(tmp_path / "out" / "V.tsv")
    assert write_result_file(records, path) == 3
    raw = open(path, "rb").read()
    assert raw.startswith("\ufeff文言\t".encode()) and raw.count(b"\r\n") == 4 and b'"const val A = ""V"""' in raw
    back = read_results(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))
    write_results(records, str(tmp_path / "all"))
    part = next((tmp_path / "all" / "keyword=V").glob("part-*"))
    assert part.read_bytes().startswith("\ufeff文言".encode())


def test_quality(spark):
    cols = "keyword string, ref_type string, usage_type string, filepath string, lineno string, code string, src_var string, src_file string, src_lineno string"
    row = lambda line, label: ("V", DIRECT, label, "a", line, "x", "", "", "")
    expected = spark.createDataFrame([row("1", "p"), row("2", "p"), row("3", "p"), row("3", "p")], cols)
    actual = spark.createDataFrame([row("1", "p"), row("2", "q"), row("9", "p")], cols)
    s = quality.scores(expected, actual).first()
    assert (s.expected_total, s.matched, s.correct, s.false_positives, s.coverage, s.accuracy) == (4, 2, 1, 1, 0.5, 0.5)
    none = quality.scores(expected.limit(0), actual.limit(0)).first()
    assert none.coverage == 1.0 and none.accuracy == 0.0
    text = quality.report(expected, actual, "kotlin")
    assert "網羅率: 2/4 (50.0%) [WARN]" in text and "取りこぼし" in text and "参照種別「間接」" in text


def test_stream(spark, tmp_path):
    from usage_trace.streaming import read_hit_stream, trace_stream

    lines = tree(spark, {"A.kt": 'const val A = "V"\nval b = A'})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "V.grep").write_text('A.kt:1:const val A = "V"\n')
    run = lambda: trace_stream(read_hit_stream(spark, str(tmp_path / "in")), lines, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in" / "W.grep").write_text("A.kt:2:val b = A\n")
    run()
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*")).groupBy("keyword").count().collect()
    assert sorted(map(tuple, rows)) == [("V", 2), ("W", 1)]


@pytest.mark.parametrize("name", ["parse_hits", "count_hits", "classify_kotlin", "extract_sql", "trace_kotlin", "trace_sh", "kpi_scores", "method_ranges"])
def test_query_against_sql(spark, name):
    import glob
    import os

    import duckdb

    from usage_trace import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert as_rows(got) == as_rows(want)


def test_java_structure_a_few_files_at_once():
    """A batch of Spark's has 10,000 files; their objects are held for FILES at most, and a file gives a row whatever is in it."""
    texts = [JAVA, None, "", "class {"] * 50
    batch = pa.RecordBatch.from_pydict({"filepath": [f"{i}.java" for i in range(200)], "text": texts})
    got = list(java_structure._read([batch.slice(0, 0), batch]))
    assert max(x.num_rows for x in got) <= java_structure.FILES and [p for x in got for p in x.column("filepath").to_pylist()] == batch.column("filepath").to_pylist()
    assert [u for x in got for u in x.column("understood").to_pylist()] == [True, False, False, False] * 50


def test_packed_tables_are_not_broadcast_by_their_files(spark):
    """Files of lines that look alike are some hundred times smaller than the rows that a broadcast would hold."""
    table = lambda c: scratch.written(spark.range(200_000).select("id", F.repeat(F.lit("x"), 300).alias(c)), "packed")
    a, b = table("a"), table("b")
    assert scratch.written(a.join(b, "id"), "joined").count() == 200_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(store.executionsList().size())]
    joins = [p for p in plans if "joined-" in p and "SortMergeJoin" in p or "BroadcastHashJoin" in p and "joined-" in p]
    assert joins and "BroadcastHashJoin" not in joins[-1]
    assert spark.conf.get(scratch._PACKED) == "1.0"
    scratch.drop(a, b)
