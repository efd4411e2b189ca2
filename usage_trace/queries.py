"""One query for each operator over the star-schema and text tables, with SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.corpora import FIELDS, METHODS, SAME_FILE, TEMPLATES, corpus
from usage_trace.functions import extract
from usage_trace.functions.classify import IGNORE_CASE, RULES, labels, usage
from usage_trace.operators import aliases, quality, scopes
from usage_trace.operators import tokens as tokenizer
from usage_trace.operators.java_structure import structures
from usage_trace.plans.languages import by_suffix
from usage_trace.plans.trace import FAMILY, direct, family, language, summed_up, trace
from usage_trace.schema import DIRECT, GETTER, INDIRECT, OTHER, SETTER
from usage_trace.sources.files import file_lines
from usage_trace.sources.hits import count_hits, parse_hits
from usage_trace.sources.results import rendered
from usage_trace.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = {"documents": ("doc_id", "text", "lang"), "pages": ("page_id", "html", "'html'"), "conversations": ("conv_id", "text", "role")}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{d.rstrip('/')}/{n}.parquet") for n in names}


def _sql(spark: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    """SQL over tables; each is a view named by its folder, so other folders' tables stay apart."""
    heads = []
    for n, frame in _tables(spark, d, *names).items():
        view = f"usage_trace_{n}_{hashlib.md5(d.encode()).hexdigest()[:8]}"
        frame.createOrReplaceTempView(view)
        heads.append(f"{n} AS (SELECT * FROM {view})")
    return spark.sql(f"WITH {', '.join(heads)} SELECT * FROM ({text}) q")


def tree(spark: SparkSession, d: str, *langs: str) -> DataFrame:
    """The corpora of languages as one tree, written first, as a real tree is there before it is traced."""
    return written(reduce(DataFrame.unionByName, [code(spark, d, x) for x in langs]), "tree")


def code(spark: SparkSession, d: str, lang: str) -> DataFrame:
    return _sql(spark, d, corpus(lang), "part", "lineitem")


# --- lines, hits, routing ------------------------------------------------------------------------------------------


def _lines_of(table: str):
    key, text, end = TABLES[table]
    oracle = f"""SELECT '{table}/' || {key} || '.' || {end} AS filepath, CAST(u.n AS INT) AS lineno, u.line FROM (
      SELECT {key}, {end} AS {'role' if table == 'conversations' else 'e'}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {table}) u"""
    if table == "conversations":
        oracle = oracle.replace("'conversations/' || conv_id || '.' || role", "'conversations/' || conv_id || '.' || role")
    else:
        oracle = oracle.replace(f"|| '.' || {end} AS filepath", "|| '.' || u.e AS filepath")

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _tables(spark, d, table)[table]
        path = F.concat(F.lit(f"{table}/"), F.col(key), F.lit("."), F.expr(end))
        return file_lines(rows.select(path.alias("filepath"), text), text)

    query(f"lines_{table}", oracle)(run)


for _t in TABLES:
    _lines_of(_t)


_HITS = """SELECT CASE WHEN doc_id % 7 = 6 THEN '   ' WHEN doc_id % 11 = 10 THEN 'Binary file x' || doc_id || ' matches' WHEN doc_id % 13 = 12 THEN ':12:' || lang
    WHEN doc_id % 17 = 16 THEN 'C:/a' || doc_id || '.c:12:x:3:y' ELSE 'src/' || source || '/d' || doc_id || '.' || lang || ':' || n_chars || ': ' || lang || ':' || doc_id || ':  ' END AS value, source AS keyword FROM documents"""


@query(
    "parse_hits",
    f"""SELECT keyword, regexp_extract(value, '(?s)^(.*?):([0-9]+):(.*)$', 1) AS filepath, regexp_extract(value, '(?s)^(.*?):([0-9]+):(.*)$', 2) AS lineno,
    trim(regexp_extract(value, '(?s)^(.*?):([0-9]+):(.*)$', 3)) AS code FROM ({_HITS}) h WHERE regexp_extract(value, '(?s)^(.*?):([0-9]+):(.*)$', 1) <> '' AND NOT regexp_matches(value, '^Binary file .+ matches$')""",
)
def _parse(spark, d):
    return parse_hits(_sql(spark, d, _HITS, "documents"))


@query(
    "count_hits",
    f"""SELECT keyword, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS skipped FROM (
    SELECT keyword, regexp_extract(value, '(?s)^(.*?):([0-9]+):(.*)$', 1) <> '' AND NOT regexp_matches(value, '^Binary file .+ matches$') AS valid FROM ({_HITS}) h) v GROUP BY keyword""",
)
def _count(spark, d):
    return count_hits(_sql(spark, d, _HITS, "documents"))


_ENDS = [*by_suffix(), ".xml", ".TXT", ".JAVA", ".Py", ""]
_PATHS = "SELECT event_id, 'a.b/' || event_type || '/e' || event_id || CASE event_id % {} {} END AS filepath FROM events".format(len(_ENDS), " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS)))
_SUFFIX = r"lower(regexp_extract(filepath, '[^/.][^/]*?(\.[^./]+)$', 1))"


@query("route_language", f"SELECT event_id, filepath, CASE {_SUFFIX} {' '.join(f'''WHEN '{e}' THEN '{n}' ''' for e, n in by_suffix().items())} ELSE 'none' END AS lang FROM ({_PATHS}) p")
def _route(spark, d):
    return _sql(spark, d, _PATHS, "events").select("event_id", "filepath", language(F.col("filepath")).alias("lang"))


# --- classification and extraction ---------------------------------------------------------------------------------


def _case(lang: str, line: str = "line") -> str:
    flag = "(?i)" if lang in IGNORE_CASE else ""
    sql = " ".join(f"WHEN regexp_matches(trim({line}), '{flag}{p}') THEN '{label}'" for p, label in RULES[lang])
    return f"CASE {sql} ELSE '{OTHER}' END"


def _classified(lang: str):
    @query(f"classify_{lang}", f"SELECT filepath, lineno, {_case(lang)} AS usage_type FROM ({corpus(lang)}) c")
    def run(spark, d):
        return code(spark, d, lang).select("filepath", "lineno", usage(F.col("line"), lang).alias("usage_type"))


# RE2 forms of the extractors' patterns, for definitions as the corpora have them.
_RE2 = {
    "kotlin": (extract.kotlin_const, r"\bconst\s+val\s+(\w+)\s*="),
    "ts": (extract.ts_const, r"\b(?:export\s+)?const\s+(\w+)\s*(?::\s*[^=]+?)?\s*=(?:[^=]|$)"),
    "perl": (extract.perl_const, r"\buse\s+constant\s+(\w+)\s*=>"),
    "dotnet": (extract.dotnet_const, r"\bconst\s+\w[\w<>]*\s+(\w+)\s*="),
    "groovy": (extract.groovy_const, r"\bstatic\s+final\s+\w[\w<>]*\s+(\w+)\s*="),
    "plsql": (extract.plsql_const, r"(?i)^\s*(\w+)\s+CONSTANT\b"),
    "c": (extract.c_define, r"^#\s*define\s+(\w+)\s+"),
    "proc": (lambda c: F.coalesce(extract.proc_variable(c), extract.proc_host_variable(c)), r"(?i)\bINTO\s*:(\w+)"),
    "sql": (extract.sql_variable, r"(?i)^\s*(\w+)(?:\s+\w[\w\s\(\),]*?)?\s*:="),
    "sh": (extract.sh_variable, r"^\s*(?:export\s+)?(\w+)\s*="),
}


def _extracted(lang: str, function, pattern: str):
    @query(f"extract_{lang}", f"SELECT filepath, lineno, name FROM (SELECT filepath, lineno, regexp_extract(line, '{pattern}', 1) AS name FROM ({corpus(lang)}) c) x WHERE name <> ''")
    def run(spark, d):
        return code(spark, d, lang).select("filepath", "lineno", function(F.col("line")).alias("name")).where("name IS NOT NULL")


for _l in TEMPLATES:
    _classified(_l)
for _l, (_f, _p) in _RE2.items():
    _extracted(_l, _f, _p)


@query("extract_python", rf"SELECT filepath, lineno, name FROM (SELECT filepath, lineno, regexp_extract(line, '^\s*(\w+)\s*(?::\s*[^=]+?)?\s*=(?:[^=]|$)', 1) AS name FROM ({corpus('python')}) c) x WHERE name <> '' AND name = upper(name) AND name <> lower(name)")
def _extract_python(spark, d):
    return code(spark, d, "python").select("filepath", "lineno", extract.python_const(F.col("line")).alias("name")).where("name IS NOT NULL")


@query("extract_java", rf"SELECT filepath, lineno, name FROM (SELECT filepath, lineno, regexp_extract(split_part(regexp_replace(trim(line), ';+$', ''), '=', 1), '\S\s+[\[\];()\{{\}}<>]*([A-Za-z_]\w*)[\[\];()\{{\}}<>]*\s*$', 1) AS name FROM ({corpus('java')}) c) x WHERE name <> ''")
def _extract_java(spark, d):
    return code(spark, d, "java").select("filepath", "lineno", extract.java_name(F.col("line")).alias("name")).where("name IS NOT NULL")


# --- tracing --------------------------------------------------------------------------------------------------------

_HIT = """SELECT line AS code, regexp_extract(line, '"([^"]*)"', 1) AS keyword, filepath, lineno FROM code WHERE regexp_extract(line, '"([^"]*)"', 1) <> ''"""
_NINE = "keyword, ref_type, usage_type, filepath, lineno, code, src_var, src_file, src_lineno"


def _hits(lines: DataFrame) -> DataFrame:
    word = F.regexp_extract("line", '"([^"]*)"', 1)
    return lines.where(word != "").select(word.alias("keyword"), F.concat_ws(":", "filepath", F.col("lineno").cast("string"), "line").alias("value"))


def _direct_sql(lang: str) -> str:
    return f"SELECT keyword, '{DIRECT}' AS ref_type, {_case(lang, 'code')} AS usage_type, filepath, CAST(lineno AS VARCHAR) AS lineno, trim(code) AS code, '' AS src_var, '' AS src_file, '' AS src_lineno FROM hit"


def _use_sql(lang: str, kind: str = f"'{INDIRECT}'") -> str:
    return f"SELECT keyword, {kind} AS ref_type, {_case(lang)} AS usage_type, u.filepath, CAST(u.lineno AS VARCHAR) AS lineno, trim(line) AS code, name AS src_var, src_file, src_lineno FROM u"


def _traced(lang: str):
    name = "P_" if lang not in SAME_FILE else {"sql": "v_P_", "sh": "V_P_"}[lang]
    task = f"SELECT regexp_extract(code, '({name}[0-9]+)', 1) AS name, keyword, filepath AS src_file, CAST(lineno AS VARCHAR) AS src_lineno, filepath AS def_file, lineno AS def_lineno FROM hit"
    more = ""
    if lang in ("c", "proc"):
        more = r""", edge AS (SELECT alias, arg_max(target, (filepath, lineno)) AS target FROM (SELECT filepath, lineno, regexp_extract(line, '^#\s*define\s+(\w+)\s+(\w+)\s*$', 1) AS alias, regexp_extract(line, '^#\s*define\s+(\w+)\s+(\w+)\s*$', 2) AS target FROM code) e WHERE alias <> '' GROUP BY alias),
        walk(name, alias, depth) AS (SELECT DISTINCT name, name, 0 FROM first_task UNION ALL SELECT w.name, e.alias, w.depth + 1 FROM walk w JOIN edge e ON e.target = w.alias WHERE w.depth < 10 AND e.alias <> w.name),
        task AS (SELECT * FROM first_task UNION ALL SELECT w.alias, keyword, src_file, src_lineno, NULL, 0 FROM first_task JOIN (SELECT DISTINCT name, alias FROM walk WHERE depth > 0) w USING (name))"""
    tasks = f"first_task AS ({task}){more}" if more else f"task AS ({task})"
    token = r"regexp_extract_all(line, '[A-Za-z0-9_]+')" if lang != "sh" else r"regexp_extract_all(line, '\$\{?([A-Za-z0-9_]+)', 1)"
    tok, on = ("lower(tok)", "lower(name)") if lang in ("sql", "plsql") else ("tok", "name")
    if lang in SAME_FILE:
        tokens = f"SELECT DISTINCT filepath, lineno, line, {tok} AS tok FROM (SELECT filepath, lineno, line, unnest({token}) AS tok FROM code) t"
        on = f"tok = {on} AND filepath = def_file"
    else:
        tokens = f"SELECT filepath, lineno, line, {tok} AS tok FROM (SELECT filepath, lineno, line, unnest({token}) AS tok FROM code) t"
        on = f"tok = {on}"
    oracle = f"""WITH RECURSIVE code AS ({corpus(lang)}), hit AS ({_HIT}), {tasks}, tok AS ({tokens}),
      u AS (SELECT tok.filepath, tok.lineno, line, name, keyword, src_file, src_lineno FROM tok JOIN task ON {on} WHERE NOT coalesce(filepath = def_file AND lineno = def_lineno, false))
      {_direct_sql(lang)} UNION ALL {_use_sql(lang)}"""

    @query(f"trace_{lang}", oracle)
    def run(spark, d):
        lines = tree(spark, d, lang)
        return trace(_hits(lines), lines)


for _l in ("kotlin", "ts", "python", "perl", "dotnet", "groovy", "plsql", "c", "proc", "sql", "sh"):
    _traced(_l)

_JAVA = f"""WITH code AS ({corpus('java')}), hit AS ({_HIT}), task AS (SELECT regexp_extract(code, '(P_[0-9]+)', 1) AS name, keyword, filepath AS src_file, CAST(lineno AS VARCHAR) AS src_lineno, lineno AS def_lineno FROM hit),
      u AS (SELECT t.filepath, t.lineno, line, name, keyword, src_file, src_lineno FROM (SELECT filepath, lineno, line, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+\\s*[(]?')) AS tok FROM code) t JOIN task ON tok = name OR rtrim(tok) = name WHERE NOT (filepath = src_file AND lineno = def_lineno))
      {_direct_sql('java')} UNION ALL {_use_sql('java')}"""


@query("trace_java", _JAVA.replace("ON tok = name OR rtrim(tok) = name", "ON rtrim(tok) = name"))
def _trace_java(spark, d):
    lines = tree(spark, d, "java")
    return trace(_hits(lines), lines)


@query("trace_per_line", ORACLES["trace_kotlin"].replace("SELECT filepath, lineno, line, tok AS tok", "SELECT DISTINCT filepath, lineno, line, tok AS tok"))
def _per_line(spark, d):
    lines = tree(spark, d, "kotlin")
    return trace(_hits(lines), lines, per_line=True)


_MIXED = tuple(TEMPLATES)


@query("trace_mixed_tree", "SELECT split_part(filepath, '/', 1) AS tree, ref_type, usage_type, count(*) AS n, count(DISTINCT keyword) AS keywords FROM (" + " UNION ALL ".join(f"SELECT * FROM ({ORACLES[f'trace_{lang}']}) q_{lang}" for lang in _MIXED) + ") a GROUP BY ALL")
def _trace_mixed(spark, d):
    """The corpora of several languages as one tree, traced at once; rows per language, kind and label."""
    # Pro*C looks at C's files and the other way round, so its names are made others than C's here, and the SQL can take the trees one by one
    own = F.when(F.startswith("filepath", F.lit("proc/")), F.regexp_replace("line", r"\b([PAB])_", "$1Q_")).otherwise(F.col("line"))
    lines = written([code(spark, d, x).withColumn("line", own) for x in _MIXED], "tree", **{FAMILY: family(F.col("filepath"))})
    kinds = [F.substring_index("filepath", "/", 1).alias("tree"), "ref_type", "usage_type"]
    parts = summed_up(_hits(lines), lines, lambda records: records.groupBy(*kinds, "keyword").agg(F.count("*").alias("n")))
    return parts.groupBy("tree", "ref_type", "usage_type").agg(F.sum("n").alias("n"), F.countDistinct("keyword").alias("keywords"))


# --- aliases, scopes, accessors -------------------------------------------------------------------------------------

_EDGES = """SELECT 'M' || o_orderkey AS alias, 'M' || (o_orderkey * 7 % (SELECT max(o_orderkey) + 1 FROM orders)) AS target FROM orders"""


@query(
    "define_alias_closure",
    f"""WITH RECURSIVE edge AS ({_EDGES}), walk(name, alias, depth) AS (SELECT DISTINCT target, target, 0 FROM edge
      UNION ALL SELECT w.name, e.alias, w.depth + 1 FROM walk w JOIN edge e ON e.target = w.alias WHERE w.depth < 10 AND e.alias <> w.name)
      SELECT name, alias, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY name, alias""",
)
def _closure(spark, d):
    edges = _sql(spark, d, _EDGES, "orders")
    return aliases.closure(edges.select(F.col("target").alias("name")).distinct(), edges)


_RANGES = r"""s AS (SELECT filepath, lineno AS start_line FROM code WHERE regexp_matches(line, '^int f[0-9]+\(')),
    n AS (SELECT filepath, lineno, len(regexp_replace(line, '[^{]', '', 'g')) - len(regexp_replace(line, '[^}]', '', 'g')) AS net FROM code),
    c AS (SELECT *, sum(net) OVER (PARTITION BY filepath ORDER BY lineno) AS upto FROM n),
    i AS (SELECT s.filepath, s.start_line, c.lineno, c.upto - (b.upto - b.net) AS open FROM s JOIN c b ON b.filepath = s.filepath AND b.lineno = s.start_line JOIN c ON c.filepath = s.filepath AND c.lineno >= s.start_line),
    o AS (SELECT filepath, start_line, min(lineno) FILTER (open > 0) AS opened FROM i GROUP BY ALL),
    r AS (SELECT i.filepath, i.start_line, min(i.lineno) AS end_line FROM i JOIN o ON o.filepath = i.filepath AND o.start_line = i.start_line WHERE i.lineno >= opened AND open <= 0 GROUP BY ALL)"""


def _starts(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(r"^int f[0-9]+\(")).select("filepath", F.col("lineno").alias("start_line"))


@query("method_ranges", f"WITH code AS ({METHODS}), {_RANGES} SELECT filepath, start_line, end_line FROM r")
def _ranges(spark, d):
    lines = _sql(spark, d, METHODS, "orders", "lineitem")
    return scopes.method_ranges(_starts(lines), lines)


@query(
    "uses_within_methods",
    rf"""WITH code AS ({METHODS}), {_RANGES}, def AS (SELECT filepath, lineno AS def_lineno, regexp_extract(line, '^int (v[0-9]+) =', 1) AS name FROM code WHERE regexp_extract(line, '^int (v[0-9]+) =', 1) <> ''),
    a AS (SELECT def.filepath, def_lineno, name, max(start_line) AS start_line FROM def JOIN s ON s.filepath = def.filepath AND start_line <= def_lineno GROUP BY ALL),
    t AS (SELECT DISTINCT filepath, lineno, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS tok FROM code)
    SELECT a.filepath, a.name, a.def_lineno, t.lineno FROM a JOIN r ON r.filepath = a.filepath AND r.start_line = a.start_line JOIN t ON t.filepath = a.filepath AND tok = a.name AND t.lineno BETWEEN a.start_line AND end_line WHERE t.lineno <> a.def_lineno""",
)
def _within(spark, d):
    lines = _sql(spark, d, METHODS, "orders", "lineitem")
    name = F.regexp_extract("line", "^int (v[0-9]+) =", 1)
    defined = lines.where(name != "").select(F.col("filepath").alias("def_file"), F.col("lineno").alias("def_lineno"), name.alias("name"))
    starts = _starts(lines)
    own = scopes.within(scopes.enclosing(defined, starts), scopes.method_ranges(starts, lines))
    toks = tokenizer.tokens(lines).select("filepath", "lineno", "tok").distinct()
    met = toks.join(own, (F.col("filepath") == F.col("def_file")) & (F.col("tok") == F.col("name"))).where("lineno BETWEEN start_line AND end_line AND lineno <> def_lineno")
    return met.select("filepath", "name", "def_lineno", "lineno")


@query(
    "groovy_accessors",
    rf"""WITH code AS ({FIELDS}), hit AS ({_HIT}), field AS (SELECT regexp_extract(code, '(\w+)\s*[=;]', 1) AS f, keyword, filepath AS src_file, CAST(lineno AS VARCHAR) AS src_lineno FROM hit),
    h AS (SELECT filepath, lineno, line, CASE WHEN contains(line, '{{') THEN nullif(regexp_extract(line, '\b(?:def|void|\w+)\s+(\w+)\s*\(', 1), '') END AS m FROM code),
    k AS (SELECT filepath, line, last_value(m IGNORE NULLS) OVER (PARTITION BY filepath ORDER BY lineno) AS method FROM h),
    member AS (SELECT DISTINCT filepath, regexp_extract(line, '\breturn\s+(?:this\.)?(\w+)', 1) AS f, method, '{GETTER}' AS kind FROM k WHERE method IS NOT NULL UNION ALL SELECT DISTINCT filepath, regexp_extract(line, '(?:this\.)?(\w+)\s*=\s*\w+', 1), method, '{SETTER}' FROM k WHERE method IS NOT NULL),
    task AS (SELECT DISTINCT * FROM (SELECT 'get' || upper(f[1]) || f[2:] AS name, '{GETTER}' AS kind, keyword, src_file, src_lineno FROM field UNION ALL SELECT 'set' || upper(f[1]) || f[2:], '{SETTER}', keyword, src_file, src_lineno FROM field
      UNION ALL SELECT method, kind, keyword, src_file, src_lineno FROM field JOIN member ON member.filepath = src_file AND member.f = field.f) x),
    u AS (SELECT filepath, lineno, line, name, kind, keyword, src_file, src_lineno FROM (SELECT filepath, lineno, line, unnest(regexp_extract_all(line, '([A-Za-z0-9_]+)\s*\(', 1)) AS tok FROM code) t JOIN task ON tok = name)
    {_use_sql('groovy', 'kind')}""",
)
def _accessors(spark, d):
    from usage_trace.plans.trace import groovy_accessors

    lines = _sql(spark, d, FIELDS, "supplier", "lineitem")
    return groovy_accessors(direct(parse_hits(_hits(lines)), lines), lines)


# --- tokens, prefilter, sort ----------------------------------------------------------------------------------------

_WORDS = r"[\p{L}\p{N}_]+"


@query("token_counts", f"SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(line, '{_WORDS}')) AS tok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l) t GROUP BY tok")
def _token_counts(spark, d):
    lines = QUERIES["lines_documents"](spark, d)
    return tokenizer.tokens(lines).groupBy("tok").agg(F.count("*").alias("n"), F.countDistinct("filepath").alias("n_docs"))


@query(
    "benchmark_words_in_documents",
    f"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS name FROM benchmark)
    SELECT 'documents/' || doc_id || '.' || lang AS filepath, CAST(count(*) AS BIGINT) AS n, count(DISTINCT tok) AS n_names FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{_WORDS}')) AS tok FROM documents) t JOIN names ON tok = name GROUP BY ALL""",
)
def _benchmark_words(spark, d):
    names = tokenizer.tokens(_tables(spark, d, "benchmark")["benchmark"].select(F.col("item_id").cast("string").alias("filepath"), F.lit(1).alias("lineno"), F.col("text").alias("line")))
    names = names.select(F.col("tok").alias("name")).distinct()
    met = tokenizer.occurrences(QUERIES["lines_documents"](spark, d), names)
    return met.groupBy("filepath").agg(F.count("*").alias("n"), F.countDistinct("tok").alias("n_names"))


@query("file_prefilter", "SELECT DISTINCT 'documents/' || doc_id || '.' || lang AS filepath FROM documents WHERE " + " OR ".join(f"contains(text, '{w}')" for w in ("License", "Apache", "GNU")))
def _prefilter(spark, d):
    names = spark.createDataFrame([("License",), ("Apache",), ("GNU",)], "name string")
    return tokenizer.prefilter(QUERIES["lines_documents"](spark, d), names)


@query("sorted_places", f"SELECT {_NINE}, row_number() OVER (PARTITION BY keyword ORDER BY filepath, CAST(lineno AS BIGINT), ref_type, usage_type, src_file, CAST(nullif(src_lineno, '') AS BIGINT) NULLS FIRST, src_var, code) AS place FROM ({ORACLES['trace_kotlin']}) q")
def _places(spark, d):
    from usage_trace.plans.trace import numbered

    return numbered(QUERIES["trace_kotlin"](spark, d)).withColumn("place", F.col("place").cast("long"))


@query("result_lines", None)
def _result_lines(spark, d):
    """Rows of the result files of all keywords, as they are written."""
    return rendered(QUERIES["trace_kotlin"](spark, d))


# --- quality --------------------------------------------------------------------------------------------------------

_EXPECTED = "SELECT p_brand AS keyword, CASE WHEN p_size % 5 = 0 THEN '{i}' ELSE '{d}' END AS ref_type, '{a}' AS usage_type, 'k/f' || (p_partkey % 97) || '.kt' AS filepath, '' || p_partkey AS lineno, p_name AS code, '' AS src_var, '' AS src_file, '' AS src_lineno FROM part WHERE p_partkey % 10 <> 3"
_EXPECTED = _EXPECTED.format(i=INDIRECT, d=DIRECT, a=labels("kotlin")[0])
_ACTUAL = f"SELECT p_brand AS keyword, CASE WHEN p_size % 5 = 0 THEN '{INDIRECT}' ELSE '{DIRECT}' END AS ref_type, CASE WHEN p_size % 4 = 0 THEN '{labels('kotlin')[1]}' ELSE '{labels('kotlin')[0]}' END AS usage_type, 'k/f' || (p_partkey % 97) || '.kt' AS filepath, '' || p_partkey AS lineno, p_name AS code, '' AS src_var, '' AS src_file, '' AS src_lineno FROM part WHERE p_partkey % 10 <> 7"
_COMPARED = f"""SELECT coalesce(e.filepath, a.filepath) AS filepath, coalesce(e.lineno, a.lineno) AS lineno, coalesce(e.ref_type, a.ref_type) AS ref_type,
    CASE WHEN a.filepath IS NULL THEN 'missing' WHEN e.filepath IS NULL THEN 'false positive' WHEN e.usage_type = a.usage_type THEN 'correct' ELSE 'misclassified' END AS outcome
    FROM ({_EXPECTED}) e FULL JOIN ({_ACTUAL}) a ON e.filepath = a.filepath AND e.lineno = a.lineno AND e.ref_type = a.ref_type"""


def _pair(spark, d):
    return _sql(spark, d, _EXPECTED, "part"), _sql(spark, d, _ACTUAL, "part")


@query("kpi_compared", _COMPARED)
def _kpi_compared(spark, d):
    return quality.compared(*_pair(spark, d)).select("filepath", "lineno", "ref_type", "outcome")


@query(
    "kpi_scores",
    f"""SELECT t AS expected_total, m AS matched, c AS correct, f AS false_positives, CAST(m AS DOUBLE) / t AS coverage, CAST(c AS DOUBLE) / m AS accuracy FROM (
    SELECT count(*) FILTER (outcome IN ('correct', 'misclassified')) AS m, count(*) FILTER (outcome = 'correct') AS c, count(*) FILTER (outcome = 'false positive') AS f, (SELECT count(*) FROM ({_EXPECTED}) e2) AS t FROM ({_COMPARED}) k) s""",
)
def _kpi_scores(spark, d):
    return quality.scores(*_pair(spark, d))


@query(
    "kpi_shortfalls",
    f"""SELECT 'usage_type' AS what, v.name, coalesce(n, 0) AS n, 1 AS least FROM (VALUES {', '.join(f"('{x}')" for x in labels('kotlin'))}) v(name) LEFT JOIN (SELECT usage_type, count(*) AS n FROM ({_EXPECTED}) e GROUP BY 1) c ON c.usage_type = v.name WHERE coalesce(n, 0) < 1
    UNION ALL SELECT 'ref_type', k.name, 0, 1 FROM (VALUES ('{DIRECT}'), ('{INDIRECT}')) k(name) WHERE k.name NOT IN (SELECT ref_type FROM ({_EXPECTED}) e3)""",
)
def _kpi_shortfalls(spark, d):
    return quality.shortfalls(_pair(spark, d)[0], "kotlin")


@query("kind_counts", f"SELECT keyword, count(*) FILTER (ref_type = '{DIRECT}') AS direct, count(*) FILTER (ref_type <> '{DIRECT}') AS indirect FROM ({ORACLES['trace_kotlin']}) q GROUP BY keyword")
def _kinds(spark, d):
    return quality.kind_counts(QUERIES["trace_kotlin"](spark, d))


@query("unpaired_keywords", "SELECT DISTINCT 'k' || p_partkey AS keyword, 'input' AS side FROM part WHERE p_size >= 40 UNION ALL SELECT DISTINCT 'k' || p_partkey, 'expected' FROM part WHERE p_size <= 10")
def _unpaired(spark, d):
    part = _tables(spark, d, "part")["part"].select(F.concat(F.lit("k"), "p_partkey").alias("keyword"), "p_size")
    return quality.unpaired(part.where("p_size > 10").select("keyword"), part.where("p_size < 40").select("keyword"))


# --- beyond SQL -----------------------------------------------------------------------------------------------------


@query("java_structure")
def _structure(spark, d):
    """The structural index of Java files made from the methods' corpus."""
    lines = _sql(spark, d, METHODS, "orders", "lineitem")
    text = lines.groupBy("filepath").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("text"))
    rows = structures(text.select("filepath", F.concat(F.lit("class X {\n"), "text", F.lit("\n}")).alias("text")))
    return rows.select("filepath", "understood", F.size("index").alias("n_index"), F.size("starts").alias("n_starts"))


@query("decoded_documents", "SELECT doc_id, text, false AS failed FROM documents")
def _decoded(spark, d):
    from usage_trace.sources.encoding import decoded

    return _tables(spark, d, "documents")["documents"].select("doc_id", decoded(F.col("text").cast("binary"), "utf-8").alias("d")).select("doc_id", "d.text", "d.failed")
