"""Scopes as relations: which method a line is in, where a block ends, uses within a range of lines.

All of them are windows over the lines or braces of a file, so their cost grows with a file's length and not with its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usage_trace.functions.text import regex


def sticky_method(lines: DataFrame, pattern: str = r"\b(?:def|void|\w+)\s+(\w+)\s*\(") -> DataFrame:
    """Adds method: the last one whose header (a match, with "{" in its line) was seen in the file so far."""
    so_far = Window.partitionBy("filepath").orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.contains("line", F.lit("{")), F.nullif(F.regexp_extract("line", regex(pattern), 1), F.lit("")))
    return lines.withColumn("method", F.last(header, ignorenulls=True).over(so_far))


def method_ranges(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """filepath, start_line, end_line for starts (filepath, start_line): to the first line at which as many braces are closed as opened.

    One running sum of braces per file serves all of its methods. A line that takes the sum from p up to u opens the levels
    p ... u-1, one that takes it from p down to u closes the levels u ... p-1. A method whose sum before it is b ends at the next
    closing of level b after the next opening of it. A method that never closes has no range.
    """
    upto = Window.partitionBy("filepath").orderBy("lineno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    files = lines.join(starts.select("filepath").distinct(), "filepath", "left_semi")
    sums = files.select("filepath", "lineno", net.alias("net")).withColumn("upto", F.sum("net").over(upto)).withColumn("base", F.col("upto") - F.col("net"))
    crossed = sums.where("net <> 0").select("filepath", "lineno", (F.col("net") > 0).alias("opens"), F.explode(F.sequence(F.least("upto", "base"), F.greatest("upto", "base") - 1)).alias("level"))
    ordered = Window.partitionBy("filepath", "level").orderBy("lineno", "kind")
    ahead = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    begun = starts.select("filepath", F.col("start_line").alias("lineno")).distinct().join(sums.select("filepath", "lineno", F.col("base").alias("level")), ["filepath", "lineno"])
    events = begun.select("filepath", "level", "lineno", F.lit(0).alias("kind")).unionByName(crossed.select("filepath", "level", "lineno", F.when(F.col("opens"), 1).otherwise(2).alias("kind")))
    closing = F.first(F.when(F.col("kind") == 2, F.col("lineno")), ignorenulls=True).over(ahead)
    opening = F.first(F.when(F.col("kind") == 1, F.struct("end_line")), ignorenulls=True).over(ahead)
    ends = events.withColumn("end_line", closing).withColumn("opened", opening).where("kind = 0")
    return ends.select("filepath", F.col("lineno").alias("start_line"), F.col("opened.end_line").alias("end_line")).where("end_line IS NOT NULL")


def enclosing(rows: DataFrame, starts: DataFrame, lineno: str = "def_lineno", file: str = "def_file") -> DataFrame:
    """Adds start_line: the last start at or before the row's line (an as-of join); rows without one go."""
    at = lambda f, n, start, row, kind: [F.col(f).alias("__ut_f"), F.col(n).cast("int").alias("__ut_n"), start.cast("int").alias("start_line"), row.alias("__ut_held"), F.lit(kind).alias("__ut_kind")]
    held = F.struct(*rows.columns)
    none = F.when(F.lit(False), F.lit(None)).cast(rows.select(held.alias("h")).schema["h"].dataType)
    both = starts.select(*at("filepath", "start_line", F.col("start_line"), none, 0)).unionByName(rows.select(*at(file, lineno, F.lit(None), held, 1)))
    so_far = Window.partitionBy("__ut_f").orderBy("__ut_n", "__ut_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("start_line", F.last("start_line", ignorenulls=True).over(so_far)).where("__ut_kind = 1 AND start_line IS NOT NULL")
    return found.select("__ut_held.*", "start_line")


def within(tasks: DataFrame, ranges: DataFrame) -> DataFrame:
    """tasks with start_line, and end_line of its range; a range join then takes uses with start_line <= lineno <= end_line."""
    return tasks.join(ranges.withColumnRenamed("filepath", "def_file"), ["def_file", "start_line"])
