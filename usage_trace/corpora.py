"""Code-like corpora made from star-schema tables, by SQL that Spark and DuckDB both run.

Every part is a constant, defined in one line that holds its type in quotes (the keyword that was searched for); every
row of lineitem uses its part's constant in one of a language's ways. Files are dealt by part number, lines numbered by key.
"""

from __future__ import annotations

#: Language: suffix, definition of name {n} with value {v}, uses of {n}.
TEMPLATES: dict[str, tuple[str, str, list[str]]] = {
    "kotlin": (".kt", 'const val {n} = "{v}"', ["if (x == {n}) {", "return {n}", "log({n}, 1)", "@Tag({n})", "val y = {n}", "x{n} {n}x plain", "{n} + {n}"]),
    "ts": (".ts", 'export const {n} = "{v}";', ["if (x === {n}) {", "return {n};", "log({n}, 1)", "@Tag({n})", "let y = {n};", "x{n} {n}x plain", "{n} + {n}"]),
    "python": (".py", '{n} = "{v}"', ["if x == {n}:", "return {n}", "log({n}, 1)", "@Tag({n})", "y = {n}", "x{n} {n}x plain", "{n} + {n}"]),
    "perl": (".pl", "use constant {n} => \"{v}\";", ["if ($x == {n}) {", "return {n};", "log({n}, 1);", "print {n};", "my $y = {n};", "x{n} {n}x plain", "use {n};"]),
    "dotnet": (".cs", 'public const string {n} = "{v}";', ["if (x == {n}) {", "return {n};", "log({n}, 1);", "[Tag({n})]", "var y = {n};", "x{n} {n}x plain", "{n} + {n}"]),
    "groovy": (".groovy", 'static final String {n} = "{v}"', ["if (x > {n}) {", "return {n}", "log({n}, 1)", "@Tag({n})", "def y = {n}", "x{n} {n}x plain", "{n} + {n}"]),
    "plsql": (".pks", '{n} CONSTANT VARCHAR2(9) := "{v}";', ["IF x > {n} THEN", "WHEN {n} THEN", "log({n}, 1);", "INSERT INTO t VALUES ({n});", "y := {n};", "WHERE z = {n}", "CURSOR c IS SELECT {n}"]),
    "c": (".c", '#define {n} "{v}"', ["if (x > {n}) {", "return {n};", "log({n}, 1);", "strcmp({n}, y);", "y = {n};", "x{n} {n}x plain", "{n} + {n}"]),
    "proc": (".pc", '#define {n} "{v}"', ["if (x > {n}) {", "return {n};", "log({n}, 1);", "EXEC SQL SELECT 1 INTO :{n};", "y = {n};", "x{n} {n}x plain", "switch {n}"]),
    "java": (".java", 'public static final String {n} = "{v}";', ["if (x == {n}) {", "return {n};", "log({n}, 1);", "@Tag({n})", "String y = {n};", "x{n} {n}x plain", "{n} + {n}"]),
    "sql": (".sql", 'v_{n} VARCHAR2(9) := "{v}";', ["WHERE x = v_{n}", "SELECT V_{n} FROM t", "DECODE(v_{n}, 1)", "INSERT INTO t VALUES (v_{n})", "v_y := v_{n};", "RAISE_APPLICATION_ERROR(v_{n})", "xv_{n} v_{n}x plain"]),
    "sh": (".sh", 'export V_{n}="{v}"', ["if [ $V_{n} = 1 ]; then", "echo ${V_{n}}", "run $V_{n}x", "y=$V_{n}", "case $V_{n} in", "call $V_{n} $V_{n}", "V_{n} plain"]),
}
SAME_FILE = ("sql", "sh")


def _text(template: str, name: str, value: str = "") -> str:
    """SQL that concatenates a template."""
    parts, rest = [], template
    while rest:
        at = min((rest.find(k) for k in ("{n}", "{v}") if k in rest), default=len(rest))
        if at:
            parts.append("'" + rest[:at].replace("'", "''") + "'")
        if at < len(rest):
            parts.append(name if rest[at : at + 3] == "{n}" else value)
        rest = rest[at + 3 :]
    return " || ".join(parts)


def corpus(lang: str, files: int = 97) -> str:
    """SELECT filepath, lineno, line."""
    end, definition, uses = TEMPLATES[lang]
    name = "'P_' || {}"
    ways = " ".join(f"WHEN {i} THEN {_text(u, name.format('l_partkey'))}" for i, u in enumerate(uses))
    path = f"'{lang}/f' || ({{}} % {files}) || '{end}'"
    aliases = ""
    if lang in ("c", "proc"):
        aliases = f"""
    UNION ALL SELECT {path.format('p_partkey')}, 0, p_partkey, 1, '#define A_' || p_partkey || ' P_' || p_partkey FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT {path.format('p_partkey')}, 0, p_partkey, 2, '#define B_' || p_partkey || ' A_' || p_partkey FROM part WHERE p_size % 6 = 0
    UNION ALL SELECT {path.format('p_partkey')}, 2, p_partkey, 0, 'g(A_' || p_partkey || ', B_' || p_partkey || ');' FROM part"""
    return f"""SELECT filepath, CAST(row_number() OVER (PARTITION BY filepath ORDER BY k0, k1, k2, line) AS INT) AS lineno, line FROM (
    SELECT {path.format('p_partkey')} AS filepath, 0 AS k0, p_partkey AS k1, 0 AS k2, {_text(definition, name.format('p_partkey'), 'p_type')} AS line FROM part{aliases}
    UNION ALL SELECT {path.format('l_partkey')}, 1, l_orderkey, l_linenumber, CASE l_linenumber % {len(uses)} {ways} END FROM lineitem
  ) raw"""


METHODS = """SELECT filepath, CAST(row_number() OVER (PARTITION BY filepath ORDER BY k0, k1, line) AS INT) AS lineno, line FROM (
    SELECT 'm/f' || (o_custkey % 97) || '.java' AS filepath, o_orderkey AS k0, 0 AS k1, 'int f' || o_orderkey || '() {' AS line FROM orders
    UNION ALL SELECT 'm/f' || (o_custkey % 97) || '.java', l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'if (v' || l_orderkey || ' > 1) {' WHEN 1 THEN 'int v' || l_orderkey || ' = 2;' ELSE '} g(v' || l_orderkey || '); {' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'm/f' || (o_custkey % 97) || '.java', o_orderkey, 100, '} } } }' FROM orders
  ) raw"""

FIELDS = """SELECT filepath, CAST(row_number() OVER (PARTITION BY filepath ORDER BY k0, k1, line) AS INT) AS lineno, line FROM (
    SELECT 'g/f' || (s_suppkey % 13) || '.groovy' AS filepath, s_suppkey AS k0, 0 AS k1, 'private String a' || s_suppkey || ' = "' || s_name || '"' AS line FROM supplier
    UNION ALL SELECT 'g/f' || (s_suppkey % 13) || '.groovy', s_suppkey, 1, 'String read' || s_suppkey || '() {' FROM supplier
    UNION ALL SELECT 'g/f' || (s_suppkey % 13) || '.groovy', s_suppkey, 2, 'return this.a' || s_suppkey FROM supplier
    UNION ALL SELECT 'g/f' || (s_suppkey % 13) || '.groovy', s_suppkey, 3, 'def write' || s_suppkey || '(v) {' FROM supplier
    UNION ALL SELECT 'g/f' || (s_suppkey % 13) || '.groovy', s_suppkey, 4, 'this.a' || s_suppkey || ' = v' FROM supplier
    UNION ALL SELECT 'g/u' || (l_orderkey % 13) || '.groovy', l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'x.getA' || l_suppkey || '()' WHEN 1 THEN 'x.setA' || l_suppkey || '(1)' WHEN 2 THEN 'y = x.read' || l_suppkey || ' () + z.write' || l_suppkey || '(2)' ELSE 'getA' || l_suppkey || ' plain' END FROM lineitem
  ) raw"""
