"""Source trees as relations of files and of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.functions.text import lines, suffix
from usage_trace.sources.encoding import decoded


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), encoding: str | None = None) -> DataFrame:
    """filepath (relative to root), suffix, encoding, text, failed: files below root, by suffix in any case."""
    glob = "" if not extensions else "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in extensions) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    relative = F.when(F.startswith(path, F.lit(where)), F.substring(path, len(where) + 1, 1 << 30)).otherwise(path)
    return files.select(relative.alias("filepath"), suffix(relative).alias("suffix"), decoded(F.col("content"), encoding).alias("d")).select("filepath", "suffix", "d.*")


def file_lines(files: DataFrame, text: str = "text", filepath: str = "filepath") -> DataFrame:
    """filepath, lineno (from 1), line."""
    return files.select(F.col(filepath).alias("filepath"), F.posexplode(lines(F.col(text))).alias("n", "line")).select("filepath", (F.col("n") + 1).alias("lineno"), "line")


def resolve(hits: DataFrame, files: DataFrame, roots: tuple[str, ...] = (), column: str = "filepath", within: bool = True) -> DataFrame:
    """Adds resolved: the file (its path in files) that a hit's path means, or null.

    A path may be absolute, below a root as given (seen from the working folder; not if within is false), or relative
    to the root. The longest root that the path begins with is cut off; the result must be a file.
    """
    path = F.regexp_replace(F.col(column), r"^(\./)+", "")
    cut: Column = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        if within or root.startswith("/"):
            clean = root.rstrip("/") + "/"
            clean = clean[2:] if clean.startswith("./") else clean
            cut = F.when(F.startswith(path, F.lit(clean)), F.substring(path, len(clean) + 1, 1 << 30)).otherwise(cut)
    known = files.select(F.col("filepath").alias("__ut_file")).distinct()
    candidates = hits.withColumn("__ut_cut", cut).withColumn("__ut_path", path)
    first = known.withColumnRenamed("__ut_file", "__ut_a")
    second = known.withColumnRenamed("__ut_file", "__ut_b")
    joined = candidates.join(first, F.col("__ut_cut") == F.col("__ut_a"), "left").join(second, F.col("__ut_path") == F.col("__ut_b"), "left")
    return joined.withColumn("resolved", F.coalesce("__ut_a", "__ut_b")).drop("__ut_cut", "__ut_path", "__ut_a", "__ut_b")
