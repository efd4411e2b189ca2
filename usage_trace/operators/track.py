"""From names to their uses: joins of tasks (a name, where it was defined, where to look) with the words of lines.

Tasks of all languages are one relation, each with the number of its Rule, and the words of a tree are read once for the tasks
of one kind (by case, by file, by sort of word). While tasks are FEW or fewer they are broadcast, and a line's text goes with its
words through that join, so no line is shuffled. Beyond that, a broadcast bitmap of the names' hashes drops nearly all words that are no
name; the others are labelled and then dealt by key, with their line, which Spark leaves out where a caller wants no code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_trace.functions.classify import usage, usage_by
from usage_trace.functions.text import strip, suffix
from usage_trace.operators.tokens import line_words, tokens
from usage_trace.schema import INDIRECT, OTHER, RECORD_COLUMNS

#: Columns of tasks: name as declared, keyword and origin (src_file, src_lineno), the definition's resolved file and line.
TASK = ["name", "keyword", "src_file", "src_lineno", "def_file", "def_lineno"]
#: Those of tasks with a place: the only file looked at (null: all), its lines (null: all), the kind of use, the number of a rule.
PLACED = [*TASK, "in_file", "from_line", "to_line", "ref_type", "rule"]
#: Tasks (rows) that are broadcast.
FEW = 200_000
#: Longs of the bitmap of more tasks' names, at most.
BITMAP = 1 << 20


@dataclass(frozen=True)
class Rule:
    """How uses of a name are looked for, and by the rules of which language they are labelled."""

    probe: tuple[str, ...]  # suffixes of the files looked at; none: all files
    by: Column | str  # a language, or one by file
    langs: tuple[str, ...] = ()  # those that by may be, if it is a column
    file: bool = False  # in the task's in_file alone, a row per line
    ignore_case: bool = False
    sigil: bool = False  # the name must follow "$"
    variable: bool = False  # shell: $NAME, ${NAME
    paren: bool | None = None  # must, or must not, be followed by "("

    @property
    def kind(self) -> tuple[bool, bool, bool]:
        return self.file, self.ignore_case, self.variable


def placed(tasks: DataFrame, rule: int, ref_type: Column | str = INDIRECT, in_file: Column | None = None, lines: tuple[str, str] | None = None) -> DataFrame:
    """PLACED of TASK rows; lines: columns with the first and last line of their range."""
    no = F.lit(None)
    ends = [F.col(c) for c in lines] if lines else [no, no]
    kind = F.lit(ref_type) if isinstance(ref_type, str) else ref_type
    more = [(no if in_file is None else in_file).cast("string"), ends[0].cast("int"), ends[1].cast("int"), kind, F.lit(rule)]
    return tasks.select(*TASK, *[c.alias(n) for c, n in zip(more, PLACED[len(TASK) :])])


def record(ref_type: Column | str, usage_type: Column, file: str = "filepath") -> list[Column]:
    """The nine columns of a use, from columns of tasks and lines."""
    kind = F.lit(ref_type) if isinstance(ref_type, str) else ref_type
    made = {
        "keyword": F.col("keyword"),
        "ref_type": kind,
        "usage_type": usage_type,
        "filepath": F.col(file),
        "lineno": F.col("lineno").cast("string"),
        "code": strip(F.col("line")),
        "src_var": F.col("name"),
        "src_file": F.col("src_file"),
        "src_lineno": F.col("src_lineno"),
    }
    return [made[c].alias(c) for c in RECORD_COLUMNS]


def not_definition() -> Column:
    """The line isn't the task's own definition, as far as that is known."""
    return ~F.coalesce((F.col("filepath") == F.col("def_file")) & (F.col("lineno") == F.col("def_lineno")), F.lit(False))


def _by_rule(rules: dict[int, Rule], value) -> Column:
    """value(rule) for each row's rule; a plain value if all agree."""
    values = {i: value(r) for i, r in rules.items()}
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values.values()]
    chain = F
    for i, c in zip(values, columns):
        chain = chain.when(F.col("rule") == i, c)
    return chain


def _named(words: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """words (__ut_key) without nearly all of those that are not in names; n: how many these are, about."""
    bits = min(BITMAP, max(64, n // 4)).bit_length() - 1
    place, bit = F.shiftrightunsigned(F.xxhash64("__ut_key"), 64 - bits), F.xxhash64("__ut_key").bitwiseAND(63).cast("int")
    marks = names.select(place.alias("__ut_place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    bitmap = marks.groupBy("__ut_place").agg(F.bit_or("bit").alias("__ut_bits"))
    held = words.withColumn("__ut_place", place).join(F.broadcast(bitmap), "__ut_place").where(F.getbit("__ut_bits", bit) == 1)
    return held.drop("__ut_place", "__ut_bits")


def _met(tasks: DataFrame, rules: dict[int, Rule], lines: DataFrame, per_line: bool, n: int, most: int) -> DataFrame:
    """Columns of tasks with filepath, lineno, line, usage_type, for rules of one kind; n: the number of tasks."""
    file, ignore_case, variable = next(iter(rules.values())).kind
    probes, few = [r.probe for r in rules.values()], n <= most
    probed = by_suffix(lines, tuple(sorted({e for p in probes for e in p})) if all(probes) else ())
    side = F.broadcast if few else lambda df: df.hint("merge")  # else Spark may broadcast them by the size of their files
    key = F.lower if ignore_case else lambda c: c
    own = tasks.where(F.col("rule").isin(*rules)).withColumn("__ut_key", key(F.col("name")))
    langs = sorted({x for r in rules.values() for x in (r.langs or (r.by,))})
    label = usage_by(F.col("line"), _by_rule(rules, lambda r: r.by), langs)
    if file:
        probed = probed.join(side(own.select(F.col("in_file").alias("filepath")).distinct()), "filepath", "left_semi")
        words = line_words(probed, ignore_case, variable, ["line"]).withColumnRenamed("tok", "__ut_key")
    else:
        words = tokens(probed, ["line"]).withColumn("__ut_key", key(F.col("tok"))).drop("tok", "pos")
    if not few:
        words = _named(words, own, n)
        for by, lang in enumerate(langs):  # the labels by each language whose rules may look at the file
            ends = {e for r in rules.values() if lang in (r.langs or (r.by,)) for e in r.probe}
            own_label = usage(F.col("line"), lang)
            words = words.withColumn(f"__ut_label{by}", F.when(suffix(F.col("filepath")).isin(*ends), own_label) if all(probes) and len(langs) > 1 else own_label)
        which = _by_rule(rules, lambda r: r.by)
        label = F.coalesce(*[F.when(which == lang, F.col(f"__ut_label{by}")) for by, lang in enumerate(langs)], F.lit(OTHER))
    if file:
        hits = words.join(side(own), (words["__ut_key"] == own["__ut_key"]) & (words["filepath"] == own["in_file"])).drop("__ut_key")
        inside = F.coalesce(F.col("lineno") >= F.col("from_line"), F.lit(True)) & F.coalesce(F.col("lineno") <= F.col("to_line"), F.lit(True))
        hits = hits.where(not_definition() & inside)
    else:
        hits = words.join(side(own), "__ut_key").where(not_definition())
        wanted = lambda r: reduce(Column.__and__, [F.lit(True), *([suffix(F.col("filepath")).isin(*r.probe)] if r.probe and len(rules) > 1 else []), *([F.col("sigil")] if r.sigil else []), *([F.col("paren") == r.paren] if r.paren is not None else [])])
        hits = hits.where(_by_rule(rules, wanted)).drop("__ut_key", "sigil", "paren")
        if per_line:
            hits = hits.dropDuplicates([*PLACED, "filepath", "lineno"])
    return hits.select(*PLACED, "filepath", "lineno", "line", label.alias("usage_type"))


def uses(tasks: DataFrame, rules: list[Rule], lines: DataFrame, per_line: bool = False, most: int = FEW) -> DataFrame:
    """Records of the uses of placed tasks: a row per occurrence (or per line), or per line and task where a rule is for one file.

    tasks are counted, and read once for each kind of rule, so they are best kept.
    """
    n, found = tasks.count(), []
    for kind in sorted({r.kind for r in rules}):
        found.append(_met(tasks, {i: r for i, r in enumerate(rules) if r.kind == kind}, lines, per_line, n, most))
    return reduce(DataFrame.unionByName, found).select(*record(F.col("ref_type"), F.col("usage_type")))


def by_suffix(lines: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    return lines.where(suffix(F.col("filepath")).isin(*extensions)) if extensions else lines
