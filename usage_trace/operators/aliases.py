"""Macro aliases: "#define A B" makes A another name of B. The closure is a recursive join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_trace.functions.text import regex, strip
from usage_trace.sources.scratch import written

DEEPEST = 10


def alias_edges(lines: DataFrame) -> DataFrame:
    """alias, target: of several definitions of an alias the last counts, in order of path and line."""
    code = strip(F.col("line"))
    pattern = regex(r"^#\s*define\s+(\w+)\s+(\w+)\s*$")
    found = lines.select("filepath", "lineno", F.regexp_extract(code, pattern, 1).alias("alias"), F.regexp_extract(code, pattern, 2).alias("target")).where("alias <> ''")
    return found.groupBy("alias").agg(F.max_by("target", F.struct("filepath", "lineno")).alias("target"))


def closure(names: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """name, alias, depth: every other name that leads to name in at most deepest steps, each once.

    Each step joins the last one's new pairs only, and is written, so a step isn't made again for the next; the walk ends at
    the first step without pairs. An alias has one target, so a pair is reached along one path, and cycles end where they
    come back to the name.
    """
    step, found = names.select(F.col("name"), F.col("name").alias("alias")).distinct(), None
    edges = written(edges.select(F.col("alias").alias("__ut_next"), "target"), "alias-edges")
    for depth in range(1, deepest + 1):
        step = written(step.join(edges, F.col("alias") == F.col("target")).select("name", F.col("__ut_next").alias("alias")).where("alias <> name"), "aliases")
        rows = step.withColumn("depth", F.lit(depth))
        found = rows if found is None else found.unionByName(rows)
        if step.isEmpty():
            break
    return found.groupBy("name", "alias").agg(F.min("depth").alias("depth"))


def closure_sql(names: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """The same as one recursive query."""
    return names.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(name, alias, depth) AS (
          SELECT DISTINCT name, name, 0 FROM {{names}}
          UNION ALL
          SELECT w.name, e.alias, w.depth + 1 FROM walk w JOIN {{edges}} e ON e.target = w.alias WHERE w.depth < {deepest} AND e.alias <> w.name
        )
        SELECT name, alias, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY name, alias
        """,
        names=names,
        edges=edges,
    )
