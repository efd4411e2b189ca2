"""The whole plan: hits to direct uses, direct uses to tasks, tasks to indirect uses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_trace.functions import extract as x
from usage_trace.functions.classify import usage, usage_by
from usage_trace.functions.text import suffix
from usage_trace.operators.accessors import accessor_tasks, line_accessors
from usage_trace.operators.aliases import alias_edges, closure
from usage_trace.operators.scopes import enclosing, method_ranges
from usage_trace.operators.track import TASK, Rule, by_suffix, placed, uses
from usage_trace.plans.languages import SPECS, LanguageSpec, Seed
from usage_trace.plans.languages import by_shebang as shebangs
from usage_trace.plans.languages import by_suffix as suffixes
from usage_trace.plans.languages import families
from usage_trace.schema import DIRECT, GETTER, SETTER
from usage_trace.sources.files import resolve
from usage_trace.sources.hits import parse_hits
from usage_trace.sources.scratch import drop, written

#: Column of lines: the number of their file's family, see family().
FAMILY = "__ut_family"
SHEBANG = r"^#!\s*(?:.*/)?(?:env\s+)?(\S+)"


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in sorted(table.items()) for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit("none")) if pairs else F.lit("none")


def language(filepath: Column, first_line: Column | None = None, specs: tuple[LanguageSpec, ...] = SPECS) -> Column:
    """A path's language by its suffix; without one, by the interpreter that the file's first line names; else "none"."""
    end = suffix(filepath)
    named = _looked_up(F.lower(F.regexp_extract(first_line, SHEBANG, 1)), shebangs(specs)) if first_line is not None else F.lit("none")
    return F.when(end == "", F.coalesce(named, F.lit("none"))).otherwise(_looked_up(end, suffixes(specs)))


def direct(hits: DataFrame, lines: DataFrame | None = None, roots: tuple[str, ...] = (), specs: tuple[LanguageSpec, ...] = SPECS, only: str | None = None, structure: DataFrame | None = None) -> DataFrame:
    """keyword, filepath, lineno, code, resolved, lang, usage_type, scope of parsed hits.

    only: one language whose rules label every hit, whatever its suffix (tracing still goes by suffix).
    """
    rows = hits.select("keyword", "filepath", "lineno", "code")
    if lines is None:
        rows = rows.withColumn("resolved", F.lit(None).cast("string")).withColumn("lang", language(F.col("filepath"), None, specs))
    else:
        rows = resolve(rows, lines.select("filepath"), roots)
        heads = lines.where("lineno = 1").where(suffix(F.col("filepath")) == "").select(F.col("filepath").alias("resolved"), F.col("line").alias("first_line"))
        rows = rows.join(heads, "resolved", "left").withColumn("lang", language(F.col("filepath"), F.col("first_line"), specs)).drop("first_line")
    label = usage(F.col("code"), only) if only else usage_by(F.col("code"), F.col("lang"))
    rows = rows.withColumn("usage_type", label).withColumn("scope", F.lit(None).cast("string"))
    if structure is not None:
        index = structure.select(F.col("filepath").alias("resolved"), F.explode("index").alias("i")).select("resolved", F.col("i.lineno").cast("string").alias("lineno"), F.col("i.usage").alias("i_usage"), F.col("i.scope").alias("i_scope"))
        java = F.lit(True) if only == "java" else F.col("lang") == "java"
        rows = rows.drop("scope").join(index, ["resolved", "lineno"], "left").withColumn("usage_type", F.when(java, F.coalesce("i_usage", "usage_type")).otherwise(F.col("usage_type"))).withColumn("scope", F.when(java, F.col("i_scope"))).drop("i_usage", "i_scope")
    return rows.select("keyword", "filepath", "lineno", "code", "resolved", "lang", "usage_type", "scope")


def direct_records(rows: DataFrame) -> DataFrame:
    empty = F.lit("")
    return rows.select("keyword", F.lit(DIRECT).alias("ref_type"), "usage_type", "filepath", "lineno", "code", empty.alias("src_var"), empty.alias("src_file"), empty.alias("src_lineno"))


def tasks(rows: DataFrame, seed: Seed, lang: str) -> DataFrame:
    """TASK rows of one seed: what its extractor finds in direct uses of its labels."""
    own = rows.where((F.col("lang") == lang) & F.col("usage_type").isin(*seed.labels))
    if seed.only is not None:
        own = own.where(seed.only(F.col("code")))
    names = seed.names(F.col("code"))
    own = own.withColumn("name", names)
    if dict(own.dtypes)["name"].startswith("array"):
        own = own.withColumn("name", F.explode("name"))
    return own.where("name IS NOT NULL").select("name", "keyword", F.col("filepath").alias("src_file"), F.col("lineno").alias("src_lineno"), F.col("resolved").alias("def_file"), F.expr("try_cast(lineno AS int)").alias("def_lineno"))


def with_aliases(own: DataFrame, lines: DataFrame) -> DataFrame:
    """Tasks, and one for each alias of their names; lines that define aliases are uses like others."""
    names = closure(own.select("name"), alias_edges(lines))
    more = own.join(names.select("name", "alias"), "name").select(F.col("alias").alias("name"), "keyword", "src_file", "src_lineno", F.lit(None).cast("string").alias("def_file"), F.lit(0).alias("def_lineno"))
    return own.unionByName(more)


def _seed_tasks(rows: DataFrame, lines: DataFrame, spec: LanguageSpec, seed: Seed, rules: list[Rule]) -> DataFrame:
    """Placed tasks of one seed; its rule is added to rules."""
    own, n = tasks(rows, seed, spec.name), len(rules)
    if seed.scope == "file":
        rules.append(Rule((*spec.extensions, ""), spec.name, file=True, ignore_case=seed.ignore_case, variable=seed.variable))
        return placed(own.where("def_file IS NOT NULL"), n, in_file=F.col("def_file"))
    if seed.aliases:
        own = with_aliases(own, by_suffix(lines, seed.probe))
    by = seed.rules(suffix(F.col("filepath"))) if seed.rules else spec.name
    rules.append(Rule(seed.probe, by, ("c", "proc") if seed.rules else (), ignore_case=seed.ignore_case, sigil=seed.sigil))
    return placed(own, n)


def _groovy_tasks(rows: DataFrame, lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Calls of the getters and setters of Groovy fields; a name that is both gives both kinds of rows."""
    seed = next(s for spec in SPECS if spec.name == "groovy" for s in spec.seeds if s.kind == "field")
    fields = tasks(rows, seed, "groovy").where("def_file IS NOT NULL")
    calls = accessor_tasks(fields, line_accessors(by_suffix(lines, (".groovy", ".gvy")))).withColumn("def_file", F.lit(None).cast("string"))
    rules.append(Rule((".groovy", ".gvy"), "groovy", paren=True))
    return placed(calls, len(rules) - 1, F.col("ref_type"))


def groovy_accessors(rows: DataFrame, lines: DataFrame) -> DataFrame:
    rules: list[Rule] = []
    return uses(_groovy_tasks(rows, lines, rules), rules, lines)


def _java_tasks(rows: DataFrame, lines: DataFrame, structure: DataFrame | None, rules: list[Rule], combined: bool = True) -> DataFrame:
    """Constants (looked for everywhere), fields (in their file), locals (in their method), and calls of accessors of Java.

    A constant's name followed by "(" isn't a use of it, unless constants are scanned for apart (combined is false).
    A method name that is a getter and a setter counts as a getter.
    """
    java, n = (".java",), len(rules)
    probed = by_suffix(lines, java)
    own = rows.where((F.col("lang") == "java") & F.col("usage_type").isin("定数定義", "変数代入")).withColumn("name", x.java_name(F.col("code"))).where("name IS NOT NULL")
    below = F.when(F.startswith("filepath", F.lit("/")) | (F.regexp_replace("filepath", r"^(\./)+", "") == F.col("resolved")), F.col("resolved"))
    scope = F.when(F.col("usage_type") == "定数定義", F.lit("project")).otherwise(F.coalesce("scope", F.when(x.java_is_field(F.col("code")), F.lit("class")).otherwise(F.lit("method"))))
    all_ = own.select("name", "keyword", F.col("filepath").alias("src_file"), F.col("lineno").alias("src_lineno"), below.alias("def_file"), F.expr("try_cast(lineno AS int)").alias("def_lineno"), scope.alias("where"))
    # a definition is skipped where its path is written the way it was in the hit
    as_written = F.when(F.col("src_file") == F.col("def_file"), F.col("def_file"))
    rules += [Rule(java, "java", paren=False if combined else None), Rule(java, "java", file=True), Rule(java, "java", paren=True)]
    found = [placed(all_.where("where = 'project'").withColumn("def_file", as_written), n)]
    fields = all_.where("where = 'class' AND def_file IS NOT NULL").drop("where")
    in_file = lambda own, span=None: placed(own.withColumn("in_file", F.col("def_file")).withColumn("def_file", as_written), n + 1, in_file=F.col("in_file"), lines=span)
    found.append(in_file(fields))
    if structure is not None:
        members = structure.select("filepath", F.explode("returns").alias("m"), F.lit(GETTER).alias("ref_type")).unionByName(structure.select("filepath", F.explode("assigns").alias("m"), F.lit(SETTER).alias("ref_type"))).select("filepath", "m.method", "m.member", "ref_type")
        starts = structure.select("filepath", F.explode("starts").alias("start_line"))
        local = enclosing(all_.where("where = 'method' AND def_file IS NOT NULL").drop("where"), starts)
        ranges = method_ranges(local.select(F.col("def_file").alias("filepath"), "start_line").distinct(), probed)
        found.append(in_file(local.join(ranges.withColumnRenamed("filepath", "def_file"), ["def_file", "start_line"]), ("start_line", "end_line")))
    else:
        members = fields.sparkSession.createDataFrame([], "filepath string, method string, member string, ref_type string")
    calls = accessor_tasks(fields, members).withColumn("def_file", F.lit(None).cast("string"))
    getters = calls.where(F.col("ref_type") == GETTER).select("name").distinct()
    calls = calls.where(F.col("ref_type") == GETTER).unionByName(calls.where(F.col("ref_type") == SETTER).join(getters, "name", "left_anti").select(*calls.columns))
    found.append(placed(calls, n + 2, F.col("ref_type")))
    return reduce(DataFrame.unionByName, found)


def indirect(rows: DataFrame, lines: DataFrame, structure: DataFrame | None = None, specs: tuple[LanguageSpec, ...] = SPECS, per_line: bool = False, combined: bool = True, kept: list[DataFrame] | None = None) -> DataFrame:
    """Records of uses through names. Languages without a seed among rows are left out of the plan.

    kept: gets the tables that were written on the way.
    """
    present = {(r["lang"], r["usage_type"]) for r in rows.select("lang", "usage_type").distinct().collect()}  # a few labels
    rules: list[Rule] = []
    found = []
    for spec in specs:
        for seed in spec.seeds:
            if any((spec.name, label) in present for label in seed.labels):
                found.append(_seed_tasks(rows, lines, spec, seed, rules))
        if spec.name == "groovy" and ("groovy", "変数代入") in present:
            found.append(_groovy_tasks(rows, lines, rules))
        if spec.name == "java" and {("java", "定数定義"), ("java", "変数代入")} & present:
            found.append(_java_tasks(rows, lines, structure, rules, combined))
        if spec.seek and any(lang == spec.name for lang, _ in present):
            rules.append(Rule(spec.extensions, spec.name))
            found.append(placed(spec.seek(rows.where(F.col("lang") == spec.name), lines), len(rules) - 1))
    if not found:
        return direct_records(rows).limit(0)
    own = written(reduce(DataFrame.unionByName, found), "tasks")
    if kept is not None:
        kept.append(own)
    return uses(own, rules, lines, per_line)


def trace(hits: DataFrame, lines: DataFrame, roots: tuple[str, ...] = (), structure: DataFrame | None = None, specs: tuple[LanguageSpec, ...] = SPECS, only: str | None = None, per_line: bool = False, combined: bool = True) -> DataFrame:
    """All records, direct and indirect, unsorted: a bag, as a line is reported once for each name and origin.

    hits: keyword, value (see sources.hits); lines: filepath, lineno, line (see sources.files).
    structure: operators.java_structure.structures of the Java files; without it Java is labelled by regular expressions,
    and locals aren't followed. combined: names of all kinds are one scan, in which a constant followed by "(" is no use of it.
    """
    rows = direct(parse_hits(hits), lines, roots, specs, only, structure)
    rows = written(rows, "direct")
    kept = [rows]
    records = direct_records(rows).unionByName(indirect(rows, lines, structure, specs, per_line, combined, kept))
    records._ut_kept = kept
    return records


def family(filepath: Column, specs: tuple[LanguageSpec, ...] = SPECS) -> Column:
    """The place in families() of those who look at a file; -1 for files without a suffix, -2 if nobody looks."""
    end, groups = suffix(filepath), families(specs)
    if not groups[0][1]:
        return F.lit(0)
    chain = F.when(end == "", -1)
    for k, (_, ends) in enumerate(groups):
        chain = chain.when(end.isin(*sorted(ends)), k)
    return chain.otherwise(-2)


def summed_up(hits: DataFrame, lines: DataFrame, by: Callable[[DataFrame], DataFrame], roots: tuple[str, ...] = (), structure: DataFrame | None = None, specs: tuple[LanguageSpec, ...] = SPECS) -> DataFrame:
    """by(records) of trace()'s records, one family of languages after the other, each written: a table of sums of parts.

    Disk holds the shuffles of one family at a time. Uses of a family's names are in its files alone (and in those without a
    suffix), so all parts together are the records of the whole tree. lines that are written by FAMILY are read once in all.
    """
    rows = written(direct(parse_hits(hits), lines, roots, specs, None, structure), "direct")
    lines = lines if FAMILY in lines.columns else lines.withColumn(FAMILY, family(F.col("filepath"), specs))
    groups, parts = families(specs), []
    for k, (own, ends) in enumerate(groups):
        kept: list[DataFrame] = []
        met = rows.where(F.col("lang").isin(*(s.name for s in own)))
        within = lines.where(F.col(FAMILY).isin(k, -1)) if ends else lines
        records = direct_records(met).unionByName(indirect(met, within.drop(FAMILY), structure, own, kept=kept))
        parts.append(written(by(records), "sums"))
        drop(*kept)
    rest = rows.where(~F.col("lang").isin(*(s.name for s in specs)))
    parts.append(written(by(direct_records(rest)), "sums"))
    drop(rows)
    return reduce(DataFrame.unionByName, parts)


def release(records: DataFrame) -> None:
    """Deletes what trace() wrote for its records (direct uses and tasks), when they are needed no more; else the application's end does."""
    drop(*getattr(records, "_ut_kept", []))


def single_name(name: str, origin: dict, lines: DataFrame, lang: str, extensions: tuple[str, ...] = (), **how) -> DataFrame:
    """Uses of one name, a row per line: origin has keyword, src_file, src_lineno, def_file, def_lineno."""
    row = {"name": name} | {c: origin.get(c) for c in TASK[1:]}
    one = lines.sparkSession.createDataFrame([tuple(row[c] for c in TASK)], "name string, keyword string, src_file string, src_lineno string, def_file string, def_lineno int")
    return uses(placed(one, 0), [Rule(extensions, lang, **how)], lines, per_line=True)


def numbered(records: DataFrame) -> DataFrame:
    """Adds place: a record's place in its keyword's sorted result."""
    from usage_trace.sources.results import sort_keys

    return records.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy(*sort_keys()[1:])))
