"""Tables that a plan writes on its way, in the folder that driver and executors share.

Writing cuts the lineage: what reads the table plans and computes nothing again, and a lost executor takes nothing with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir. Only a session in one JVM (local[...]) may leave that unset; it gets a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="usage-trace-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/usage_trace-{sc.applicationId}"
    _folders.setdefault(folder, spark)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for folder, spark in _folders.items():
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


#: Spark then deletes an action's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a table takes in memory for each byte of its files, as joins are planned. Lines that look alike are packed some hundred times smaller,
#: so by the size of its files a table of any size would be broadcast. Joins start as shuffles, and what is small then is broadcast after all.
_PACKED = "spark.sql.sources.fileCompressionFactor"
PACKED = "1000.0"


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_deleted(spark: SparkSession):
    """For writes alone, of which each has a plan of its own, so nothing reads their shuffle files again."""
    return _set(spark, _CLEANUP, "true")


def written(df: DataFrame | list[DataFrame], name: str, **by: Column) -> DataFrame:
    """df, written once and read from there until drop() or the application's end.

    Of several tables of the same columns, one after the other is written to one. by: a further column, by which it is written in parts.
    """
    parts = df if isinstance(df, list) else [df]
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark), _set(spark, _PACKED, PACKED):
        for part in parts:
            part.withColumns(by).write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    made = spark.read.schema(parts[0].withColumns(by).schema).parquet(path)
    made._ut_path = path
    return made


def drop(*tables: DataFrame) -> None:
    for df in tables:
        _delete(df.sparkSession, df._ut_path)
