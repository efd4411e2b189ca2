"""Further queries: first lines that name interpreters, further arms of the extractors, Java by structure."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.functions import extract
from usage_trace.operators.java_structure import structures
from usage_trace.plans.trace import language, trace
from usage_trace.queries import _sql, _tables, query
from usage_trace.schema import DIRECT, GETTER, INDIRECT, SETTER
from usage_trace.sources.files import file_lines
from usage_trace.sources.scratch import written


def _cases(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEADS = {"#!/bin/sh": "sh", "#!/usr/bin/env perl": "perl", "#! /usr/bin/ksh93 -x": "sh", "#!/bin/cat": "none", "plain": "none"}
_BARE = f"SELECT event_id, 'bin/run' || event_id || CASE event_id % 3 WHEN 0 THEN '.py' ELSE '' END AS filepath, {_cases('event_id', [_quoted(h) for h in _HEADS])} AS first_line FROM events"


@query("route_by_first_line", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'python' ELSE {_cases('event_id', [_quoted(n) for n in _HEADS.values()])} END AS lang FROM events")
def _route_first(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _BARE, "events").select("event_id", language(F.col("filepath"), F.col("first_line")).alias("lang"))


#: Extractor, lines ({k}: a number) and the name that each defines (empty: none).
_ARMS = [
    (extract.c_variable, "char *p{k} = s;", "p{k}"),
    (extract.c_variable, "int n{k} = 1;", "n{k}"),
    (extract.c_variable, "f(x);", ""),
    (extract.proc_host_variable, "EXEC SQL SELECT a INTO :hv{k} FROM t;", "hv{k}"),
    (extract.perl_our, "our $A{k} = 1;", "A{k}"),
    (extract.perl_our, "my $b{k} = 2;", ""),
    (extract.dotnet_const, "private static readonly string R{k} = null;", "R{k}"),
    (extract.dotnet_const, "Public Const V{k} As String = 1", "V{k}"),
    (extract.dotnet_const, "var x = {k};", ""),
    (extract.sh_variable, "setenv A{k} b", "A{k}"),
    (extract.sh_variable, "set B{k}=1", "B{k}"),
    (extract.sh_variable, "C{k}=2", "C{k}"),
    (extract.sh_variable, "echo {k}", ""),
]


def _filled(template: str, number: str) -> str:
    return " || ".join(number if x == "{k}" else _quoted(x) for x in re.split(r"(\{k\})", template) if x) or "''"


_ARM_LINES = f"SELECT o_orderkey, o_orderkey % {len(_ARMS)} AS arm, {_cases('o_orderkey', [_filled(line, 'o_orderkey') for _, line, _ in _ARMS])} AS line FROM orders"


@query("extract_arms", f"SELECT o_orderkey, {_cases('o_orderkey', [f'nullif({_filled(name, "o_orderkey")}, {_quoted("")})' for _, _, name in _ARMS])} AS name FROM orders")
def _extract_arms(spark: SparkSession, d: str) -> DataFrame:
    """Variables of C, host variables, Perl's our, readonly and VB constants, set and setenv."""
    name = reduce(lambda c, i: c.when(F.col("arm") == i, _ARMS[i][0](F.col("line"))), range(1, len(_ARMS)), F.when(F.col("arm") == 0, _ARMS[0][0](F.col("line"))))
    return _sql(spark, d, _ARM_LINES, "orders").select("o_orderkey", name.alias("name"))


#: A file for each supplier ({k}, named {v}): a field, a getter and a setter by structure, a constant, a local, and a class that uses them.
_FILE = """class S{k} {
  private String f{k} = "{v}";
  static final int N{k} = {k};
  String read{k}() {
    return f{k};
  }
  void put{k}(String v) {
    this.f{k} = v;
    String loc = "{v}";
    if (loc == null) { g(loc); }
  }
  void other() { loc(); }
}
class U{k} { void h(S{k} a) {
  a.read{k}(); a.put{k}(1);
  x = N{k} + a.getF{k}();
  N{k}();
} }"""
#: Lines that are hits, with their labels; then uses: line, kind, label, name (a number follows all but loc's), line of the origin.
_HITS = {2: "変数代入", 3: "定数定義", 9: "変数代入"}
_USES = [
    (5, INDIRECT, "return文", "f", 2),
    (8, INDIRECT, "その他", "f", 2),
    (10, INDIRECT, "条件判定", "loc", 9),
    (4, GETTER, "メソッド引数", "read", 2),
    (15, GETTER, "メソッド引数", "read", 2),
    (7, SETTER, "メソッド引数", "put", 2),
    (15, SETTER, "メソッド引数", "put", 2),
    (16, GETTER, "メソッド引数", "getF", 2),
    (16, INDIRECT, "メソッド引数", "N", 3),
]
_PATH = "'j/S' || s_suppkey || '.java'"


def _code(n: int) -> str:
    return f"replace(replace({_quoted(_FILE.splitlines()[n - 1].strip())}, '{{k}}', '' || s_suppkey), '{{v}}', s_name)"


def _java_files(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace(F.replace(F.lit(_FILE), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{v}"), F.col("s_name"))
    return written(_tables(spark, d, "supplier")["supplier"].select(F.expr(_PATH).alias("filepath"), text.alias("text"), "s_name"), "java")


_DIRECT_SQL = [f"SELECT s_name AS keyword, '{DIRECT}' AS ref_type, '{label}' AS usage_type, {_PATH} AS filepath, '{n}' AS lineno, {_code(n)} AS code, '' AS src_var, '' AS src_file, '' AS src_lineno FROM supplier" for n, label in _HITS.items()]
_USES_SQL = [f"SELECT s_name, '{kind}', '{label}', {_PATH}, '{n}', {_code(n)}, '{name}'{'' if name == 'loc' else ' || s_suppkey'}, {_PATH}, '{at}' FROM supplier" for n, kind, label, name, at in _USES]


@query("trace_java_structure", " UNION ALL ".join(_DIRECT_SQL + _USES_SQL))
def _trace_java_structure(spark: SparkSession, d: str) -> DataFrame:
    """Fields, locals in their method, constants and accessors by structure, and direct uses by the structural index."""
    files = _java_files(spark, d)
    lines = file_lines(files)
    picked = lines.where(F.col("lineno").isin(*_HITS)).join(files.select("filepath", F.col("s_name").alias("keyword")), "filepath")
    hits = picked.select("keyword", F.concat_ws(":", "filepath", F.col("lineno").cast("string"), "line").alias("value"))
    return trace(hits, lines, structure=written(structures(files), "structure"))


#: Line: label and scope of the structural index.
_INDEX = {2: ("変数代入", "class"), 3: ("定数定義", "class"), 5: ("return文", None), 9: ("変数代入", "method"), 10: ("条件判定", None), 12: ("メソッド引数", None), 15: ("メソッド引数", None), 16: ("メソッド引数", None), 17: ("メソッド引数", None)}
_SCOPE = {None: "CAST(NULL AS VARCHAR)", "class": "'class'", "method": "'method'"}


@query("java_index", " UNION ALL ".join(f"SELECT {_PATH} AS filepath, {n} AS lineno, '{usage}' AS usage, {_SCOPE[scope]} AS scope FROM supplier" for n, (usage, scope) in _INDEX.items()))
def _java_index(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the structural index: what the first node of each line does, and the scope of what it declares."""
    return structures(_java_files(spark, d)).select("filepath", F.explode("index").alias("i")).select("filepath", "i.*")


#: Kind, method and member, in SQL.
_MEMBERS = [("get", "'read' || s_suppkey", "'f' || s_suppkey"), ("set", "'put' || s_suppkey", "'f' || s_suppkey"), ("set", "'h'", "'x'")]


@query("java_members", " UNION ALL ".join(f"SELECT {_PATH} AS filepath, '{kind}' AS kind, {method} AS method, {member} AS member FROM supplier" for kind, method, member in _MEMBERS))
def _java_members(spark: SparkSession, d: str) -> DataFrame:
    """Getters and setters inferred from what methods return and assign."""
    rows = written(structures(_java_files(spark, d)), "structure")
    pairs = lambda column, kind: rows.select("filepath", F.lit(kind).alias("kind"), F.explode(column).alias("m")).select("filepath", "kind", "m.*")
    return pairs("returns", "get").unionByName(pairs("assigns", "set"))


@query("java_method_starts", " UNION ALL ".join(f"SELECT {_PATH} AS filepath, {n} AS start_line FROM supplier" for n in (4, 7, 12, 14)))
def _java_starts(spark: SparkSession, d: str) -> DataFrame:
    return structures(_java_files(spark, d)).select("filepath", F.explode("starts").alias("start_line"))
