"""Search hits: lines of "path:line number:text", one file per keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.functions.text import SPACE, stem, strip
from usage_trace.sources.encoding import decoded

LONGEST_LINE, LONGEST_PATH = 1 << 20, 4096
_HIT = r"(?s)^(.*?):([\p{Nd}]+):(.*)$"


def read_hits(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """keyword (the file's stem), value: the lines of all *.grep files under path, without those that are too long.

    UTF-8 files are read as text, a line per row and file by splits. Files in which that gives characters that can't be read, zero
    bytes or the escapes of ISO-2022-JP are found by one look at all lines, and are read whole, each in the encoding that its
    first bytes show; so are all files if another encoding is named.
    """
    plain = encoding is not None and encoding.lower().replace("-", "") in ("utf8", "utf8sig")
    if plain or encoding is None:
        raw = spark.read.option("pathGlobFilter", "*.grep").option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
        other = None
        if not plain:
            bad = raw.where(F.col("value").rlike("[\ufffd\u0000]|\u001b\\$[@B]|\u001b\\([JI]")).select("path").distinct()
            if not bad.isEmpty():
                other = _whole(spark, path, None, bad)
                raw = raw.join(bad, "path", "left_anti")
        rows = raw.select("file", F.explode(F.split(F.regexp_replace("value", "^\ufeff|\r$", ""), "\r")).alias("value"))
        rows = rows if other is None else rows.unionByName(other)
    else:
        rows = _whole(spark, path, encoding, None)
    return rows.where(F.length("value") <= LONGEST_LINE).select(stem(F.col("file")).alias("keyword"), "value")


def _whole(spark: SparkSession, path: str, encoding: str | None, only: DataFrame | None) -> DataFrame:
    """file, value of files that are read whole; only: paths of those that are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.grep").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "content")
    files = files if only is None else files.join(only, "path", "left_semi")
    text = F.regexp_replace(decoded(F.col("content"), encoding)["text"], "^\ufeff", "")
    return files.select("file", F.explode(F.split(F.regexp_replace(text, "(\r\n|\r|\n)$", ""), "\r\n|\r|\n")).alias("value"))


def parsed(value: Column) -> Column:
    """struct(filepath, lineno, code) of a hit; null for a line that isn't one.

    It is cut at the first ":digits:"; blank lines, notes on binary files, empty paths, paths with NUL and too long ones are none.
    """
    line = F.regexp_replace(value, "[\r\n]+$", "")
    path = F.regexp_extract(line, _HIT, 1)
    good = line.rlike(f"(?!{SPACE})(?s:.)") & ~line.rlike("^Binary file .+ matches$") & (path != "") & (F.instr(path, "\0") == 0) & (F.length(path) <= LONGEST_PATH)
    return F.when(good, F.struct(path.alias("filepath"), F.regexp_extract(line, _HIT, 2).alias("lineno"), strip(F.regexp_extract(line, _HIT, 3)).alias("code")))


def parse_hits(hits: DataFrame) -> DataFrame:
    """keyword, filepath, lineno, code of the hits among keyword, value."""
    return hits.select("keyword", parsed(F.col("value")).alias("h")).where("h IS NOT NULL").select("keyword", "h.*")


def count_hits(hits: DataFrame) -> DataFrame:
    """keyword, total, valid, skipped."""
    valid = parsed(F.col("value")).isNotNull()
    return hits.groupBy("keyword").agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("skipped"))
