"""Counters, and the comparison of results with expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.functions.classify import RULES, labels
from usage_trace.schema import DIRECT, GETTER, INDIRECT, RECORD_COLUMNS, SETTER

COVERAGE, ACCURACY = 1.0, 0.9
KEY = ["filepath", "lineno", "ref_type"]


def kind_counts(records: DataFrame) -> DataFrame:
    """keyword, direct, indirect."""
    return records.groupBy("keyword").agg(F.count_if(F.col("ref_type") == DIRECT).alias("direct"), F.count_if(F.col("ref_type") != DIRECT).alias("indirect"))


def unread_files(files: DataFrame, structure: DataFrame | None = None) -> DataFrame:
    """filepath, what: a row for each file that couldn't be decoded ("encoding_errors") or whose structure wasn't understood ("fallback_files")."""
    failed = files.where("failed").select("filepath", F.lit("encoding_errors").alias("what"))
    if structure is None:
        return failed.distinct()
    return failed.unionByName(structure.where(~F.col("understood")).select("filepath", F.lit("fallback_files").alias("what"))).distinct()


def _last(records: DataFrame, order: str | None, value: str) -> DataFrame:
    """One row per key: the last in the given order (of equal rows, or without an order, the greatest)."""
    rank = F.struct(*([order] if order else []), *[c for c in RECORD_COLUMNS if c not in KEY])
    return records.groupBy(*KEY).agg(F.max_by(F.struct("usage_type", "code"), rank).alias(value))


def compared(expected: DataFrame, actual: DataFrame, order: str | None = None) -> DataFrame:
    """filepath, lineno, ref_type, expected, actual (structs of usage_type and code, null where there is none), outcome."""
    both = _last(expected, order, "expected").join(_last(actual, order, "actual"), KEY, "full")
    outcome = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "false positive").when(F.col("expected.usage_type") == F.col("actual.usage_type"), "correct").otherwise("misclassified")
    return both.withColumn("outcome", outcome)


def scores(expected: DataFrame, actual: DataFrame, order: str | None = None) -> DataFrame:
    """expected_total, matched, correct, false_positives, coverage, accuracy: one row.

    Rows are compared by key, but expected_total counts all expected rows.
    """
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    rows = compared(expected, actual, order).agg(n("correct", "misclassified").alias("matched"), n("correct").alias("correct"), n("false positive").alias("false_positives"))
    rows = rows.join(expected.agg(F.count("*").alias("expected_total")))
    ratio = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return rows.select("expected_total", "matched", "correct", "false_positives", ratio("matched", "expected_total", 1.0).alias("coverage"), ratio("correct", "matched", 0.0).alias("accuracy"))


def pooled(all_scores: DataFrame, by: str | None = None) -> DataFrame:
    """scores of several comparisons as one (of each value of by)."""
    own = [F.sum(c).alias(c) for c in ("expected_total", "matched", "correct", "false_positives")]
    rows = (all_scores.groupBy(by) if by else all_scores).agg(*own)
    return rows.withColumn("coverage", F.when(F.col("expected_total") > 0, F.col("matched") / F.col("expected_total")).otherwise(1.0)).withColumn("accuracy", F.when(F.col("matched") > 0, F.col("correct") / F.col("matched")).otherwise(0.0))


def requirements(spark: SparkSession) -> DataFrame:
    """lang, usage_type, least: how many rows of each label a set of expected results should have."""
    rows = [(lang, label, 10 if lang == "java" else 1) for lang in RULES if lang != "none" for label in labels(lang)]
    return spark.createDataFrame(rows, "lang string, usage_type string, least int")


def shortfalls(expected: DataFrame, lang: str) -> DataFrame:
    """what, name, n, least: labels that are too rare and kinds of reference that are absent from expected results."""
    need = requirements(expected.sparkSession).where(F.col("lang") == lang).select("usage_type", "least")
    counts = expected.groupBy("usage_type").agg(F.count("*").alias("n"))
    rare = need.join(counts, "usage_type", "left").select(F.lit("usage_type").alias("what"), F.col("usage_type").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), "least").where("n < least")
    kinds = [DIRECT, INDIRECT, *([GETTER, SETTER] if lang in ("java", "groovy") else [])]
    wanted = expected.sparkSession.createDataFrame([(k,) for k in kinds], "name string")
    absent = wanted.join(expected.select(F.col("ref_type").alias("name")).distinct(), "name", "left_anti").select(F.lit("ref_type").alias("what"), "name", F.lit(0).cast("long").alias("n"), F.lit(1).alias("least"))
    return rare.unionByName(absent)


def unpaired(inputs: DataFrame, expected: DataFrame, column: str = "keyword") -> DataFrame:
    """keyword, side: keywords with an input but no expected result, or the other way."""
    a, b = inputs.select(column).distinct(), expected.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("input")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))


def summary(score: dict) -> str:
    """The lines that stand at the head of a report; score: a row of scores()."""
    # The lines' words, here and in report().
    mark = lambda x, least: "OK" if x >= least else "WARN"
    missing, wrong = score["expected_total"] - score["matched"], score["matched"] - score["correct"]
    lines = [
        f"網羅率: {score['matched']}/{score['expected_total']} ({score['coverage'] * 100:.1f}%) [{mark(score['coverage'], COVERAGE)}]",
        f"分類精度: {score['correct']}/{score['matched']} ({score['accuracy'] * 100:.1f}%) [{mark(score['accuracy'], ACCURACY)}]",
        f"false positive: {score['false_positives']}件 (KPI算入なし)",
    ]
    return "\n".join(lines + ([f"取りこぼし: {missing}件"] if missing > 0 else []) + ([f"誤分類: {wrong}件"] if wrong else []))


def report(expected: DataFrame, actual: DataFrame, lang: str = "", timestamp: str = "") -> str:
    """A Markdown report of one comparison. Rows stream to it, a section at a time; it is as long as what went wrong."""
    score = scores(expected, actual).first().asDict()
    wrong = compared(expected, actual).orderBy("filepath", F.expr("coalesce(try_cast(lineno AS bigint), 0)"), "ref_type")
    of = lambda o: wrong.where(F.col("outcome") == o).toLocalIterator()
    title = "# KPI 計測レポート" + (f" ({lang})" if lang else "") + (f" — {timestamp}" if timestamp else "")

    def section(head, columns, cells, none="（なし）"):
        body = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(c) + " |" for c in cells)] if cells else [none]
        return [head, *body, ""]

    out = [title, "", "## サマリ", "", summary(score), ""]
    out += section("## 取りこぼし行（網羅率を下げている要因）", ["ファイルパス", "行番号", "期待コード行", "期待使用タイプ"], [(r["filepath"], r["lineno"], r["expected"]["code"], r["expected"]["usage_type"]) for r in of("missing")])
    out += section("## 誤分類行（分類精度を下げている要因）", ["ファイル", "行", "期待", "実際"], [(r["filepath"], r["lineno"], f"{r['ref_type']}/{r['expected']['usage_type']}", f"{r['ref_type']}/{r['actual']['usage_type']}") for r in of("misclassified")])
    out += section("## false positive（参考、KPI算入なし）", ["ファイル", "行", "実際の使用タイプ"], [(r["filepath"], r["lineno"], r["actual"]["usage_type"]) for r in of("false positive")])
    notes = []
    if lang:
        for r in shortfalls(expected, lang).orderBy(F.desc("what"), "name").collect():
            notes.append(f"- 使用タイプ「{r['name']}」: {r['n']} 件 (要 {r['least']} 件以上)" if r["what"] == "usage_type" else f"- 参照種別「{r['name']}」のサンプルが1件もない")
    return "\n".join([*out, "## サンプル分布チェック警告", *(notes or ["（警告なし）"])]) + "\n"
