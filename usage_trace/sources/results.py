"""Result files: one tab-separated file per keyword, in UTF-8 with a byte-order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.schema import HEADERS, RECORD, RECORD_COLUMNS


def sort_keys() -> list:
    """keyword, path, line as a number (0 if it isn't one), kind, label; then all else, for one order of all rows."""
    number = F.coalesce(F.when(F.col("lineno").rlike("^[0-9]+$"), F.expr("try_cast(lineno AS bigint)")), F.lit(0))
    return [F.col("keyword"), F.col("filepath"), number, F.col("ref_type"), F.col("usage_type"), F.col("src_file"), F.expr("coalesce(try_cast(src_lineno AS bigint), 0)"), F.col("src_var"), F.col("code")]


def sorted_records(records: DataFrame) -> DataFrame:
    return records.orderBy(*sort_keys())


def _quoted(c):
    return F.when(F.col(c).rlike('[\t\r\n"]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))


def rendered(records: DataFrame) -> DataFrame:
    """keyword, value: the rows of result files, quoted where need be, in order."""
    return sorted_records(records).select("keyword", F.concat_ws("\t", *map(_quoted, RECORD_COLUMNS)).alias("value"))


def write_results(records: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """folder/keyword=.../part files: header first, rows in order, ended by CRLF.

    Rows are dealt by range of the sort keys, so a keyword with very many rows is several files in order, each
    with a header; nothing passes through the driver.
    """
    order = sort_keys()
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    body = ranged.select("keyword", F.concat_ws("\t", *map(_quoted, RECORD_COLUMNS)).alias("line"), *[c.alias(f"k{i}") for i, c in enumerate(order)])
    first = F.monotonically_increasing_id()
    numbered = body.withColumn("n", first).withColumn("part", F.spark_partition_id())
    from pyspark.sql import Window

    head = F.row_number().over(Window.partitionBy("part", "keyword").orderBy("n")) == 1
    value = F.when(head, F.concat(F.lit("\ufeff" + "\t".join(HEADERS) + "\r\n"), F.col("line"))).otherwise(F.col("line"))
    out = numbered.withColumn("value", value).sortWithinPartitions("part", "keyword", "n").select("keyword", "value")
    out.write.mode(mode).partitionBy("keyword").option("lineSep", "\r\n").text(folder)


def write_result_file(records: DataFrame, path: str) -> int:
    """One file on the driver's disk, for a keyword's result that a person reads; rows stream through, one partition at a time."""
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write("\t".join(HEADERS) + "\r\n")
        for row in rendered(records).select("value").toLocalIterator():
            f.write(row["value"] + "\r\n")
            n += 1
    return n


def write_keyword_files(records: DataFrame, keywords: DataFrame, folder: str) -> int:
    """folder/KEYWORD.tsv for each keyword (column keyword), with the header alone if it has no rows; the rows written.

    For results that people read, on the driver's disk: all rows stream through once, in order, one partition at a time.
    """
    import os

    os.makedirs(folder, exist_ok=True)
    head, n, name, file = "\t".join(HEADERS) + "\r\n", 0, None, None

    def begun(keyword: str):
        f = open(os.path.join(folder, f"{keyword}.tsv"), "w", encoding="utf-8-sig", newline="")
        f.write(head)
        return f

    for row in keywords.select("keyword").distinct().toLocalIterator():
        begun(row["keyword"]).close()
    try:
        for row in rendered(records).toLocalIterator():
            if row["keyword"] != name:
                if file:
                    file.close()
                name, file = row["keyword"], begun(row["keyword"])
            file.write(row["value"] + "\r\n")
            n += 1
    finally:
        if file:
            file.close()
    return n


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of result files; the header is skipped, missing fields are empty."""
    rows = spark.read.schema(RECORD).option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("enforceSchema", "true").csv(path)
    return rows.na.fill("")
