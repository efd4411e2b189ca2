"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.sources.scratch import shuffles_deleted

#: Runs of anything but ASCII white space; Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: The number of a row, by which operators tell rows apart, as ids may be null or repeat. Names that start with __ut_ are reserved.
ROW = "__ut_row"

#: Rows of texts that a Python worker holds as objects at once.
SLICE = 256

_roots: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session in one JVM (local[...]) may leave it unset; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="usage-trace-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/usage_trace-{sc.applicationId}"
    if folder not in _roots:
        _roots[folder] = (spark,)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    """Scratch tables live as long as the application, for results that are read from them lazily."""
    for folder, (spark,) in _roots.items():
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


_blocks: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch():
    """Tables staged within are deleted when the block ends, but those that are to outlive it.

    Nothing that is read later may be computed from the others.
    """
    _blocks.append([])
    try:
        yield
    finally:
        for spark, path in _blocks.pop():
            delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._ut_path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """df, written once to the shared folder and read from there; outlives: the innermost scratch block that it is in.

    This cuts the lineage: later jobs don't repeat the work, and a lost executor takes nothing with it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    within = _blocks[:-1] if outlives else _blocks
    if within:
        within[-1].append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._ut_path = path
    return made


def numbered(docs: DataFrame, name: str = "rows") -> DataFrame:
    """docs with ROW, written once, so that every read of a row has the same number whatever tasks are lost or dealt anew."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def rank(doc_id: str = "doc_id") -> Column:
    """(d, row): rows by doc_id, null last, then by number; d is a null id's as the largest long."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.col(ROW).alias("row"))


def sliced(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """All rows in order, at most so many at once: Spark's batches have 10,000 rows, whose objects and results a worker would hold together and keep as its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
