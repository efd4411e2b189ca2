"""Traces of hit files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usage_trace.functions.text import stem
from usage_trace.plans.trace import trace
from usage_trace.sources.hits import LONGEST_LINE


def read_hit_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """keyword, value of *.grep files under path as they appear (UTF-8)."""
    rows = spark.readStream.option("pathGlobFilter", "*.grep").option("maxFilesPerTrigger", files_per_batch).text(path)
    return rows.select(stem(F.col("_metadata.file_name")).alias("keyword"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value")).where(F.length("value") <= LONGEST_LINE)


def trace_stream(hits: DataFrame, lines: DataFrame, out: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, **options) -> StreamingQuery:
    """Each batch's keywords are traced against static lines and written below out as Parquet, by batch and keyword.

    Rows of a keyword come from one file, so a batch needs no state of earlier ones. A batch that runs again after a
    failure replaces its own folder, so each record is there once. Ends when all files there are done.
    """

    def each(batch: DataFrame, number: int) -> None:
        records = trace(batch, lines, **options)
        if write:
            write(records, number)
        else:
            records.write.mode("overwrite").partitionBy("keyword").parquet(f"{out.rstrip('/')}/batch={number}")

    return hits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
