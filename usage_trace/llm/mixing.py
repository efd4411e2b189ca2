"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies. Within its source the documents stand in order of
(size, doc_id); the expected copies are summed up along that order, a random offset is added, and a
document is emitted once for every integer that its stretch of the sum crosses. Expected copies are
whole numbers of 1/UNIT, so sums are exact whatever the order of addition.

Ordering by size makes neighbours alike, so the words taken from a source differ from its target by
about one of its largest documents at most.

Edge cases: a null text has size 0; a null source is a source of its own, after all others; an empty
table gives an empty result; rows that repeat a doc_id, or have none, count as rows of their own; other
columns of the input are not read (query) or carried along (`emit`, which tells rows apart by a number
that is written with them).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usage_trace.llm.common import ROW, numbered, staged, words

#: Parts of a copy. With 3 copies at most, a source may hold 2**37 documents before a sum overflows.
UNIT = 1 << 24
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, ROW (0 if docs aren't numbered), source, size."""
    row = F.col(ROW) if ROW in docs.columns else F.lit(0).cast("long").alias(ROW)
    return docs.select(F.col("doc_id").cast("long"), row, F.col("source").cast("string"), F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target.

    Water level: with the sources in order of cap / weight, those before the first one that its share
    doesn't fill up stay at their caps, and the others share the rest by weight. The window runs over
    one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    name_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = by_source.withColumn("rank", F.row_number().over(name_order) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    exact = lambda c: c.cast("decimal(19,0)")
    levels = (
        ranked.withColumn("place", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "rank")))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", exact(F.col("left")) * exact(F.col("weight")) <= exact(F.col("cap")) * exact(F.col("rest")))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("place"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("first_open"), F.col("left").cast("double") / F.col("rest").cast("double"))).over(everything))
    )
    return levels.select("source", "source_size", F.when(F.col("place") < F.col("first_open"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def _prefix_sums(batches):
    """Adds to sorted rows the sum of units before them within their source and this task."""
    part, source, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        units, names = batch.column("units"), batch.column("source")
        before, start = [], 0
        runs = pc.run_end_encode(names.fill_null("\0null")) if names.null_count else pc.run_end_encode(names)
        for end, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            if name != source:
                source, total = name, 0
            run = units.slice(start, end - start)
            sums = pc.add(pc.cumulative_sum(run), total)
            before.append(pc.subtract(sums, run))
            total, start = sums[-1].as_py(), end
        columns = {n: batch.column(n) for n in ("doc_id", ROW, "source", "size", "source_size", "target", "units")}
        yield pa.RecordBatch.from_pydict(columns | {"before": pa.concat_arrays(before), "part": pa.array([part] * batch.num_rows, pa.int32())})


def systematic_sample(expected: DataFrame, seed: int = 0) -> DataFrame:
    """Adds copies to rows of doc_id, ROW, source, size, source_size, target, units (expected copies x UNIT).

    One sort by range deals even a source with a third of all rows over many tasks; each task sums up
    its own rows, and the totals of the earlier tasks (a row per task and source) are added after it.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col(ROW)]
    rows = expected.select("doc_id", ROW, "source", "size", "source_size", "target", "units").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"doc_id long, {ROW} long, source string, size long, source_size long, target double, units long, before long, part int"
    local = staged(rows.mapInArrow(_prefix_sums, schema), "mix")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    offsets = local.groupBy("source", "part").agg(F.sum("units").alias("sum")).select(F.col("source").alias("s"), F.col("part").alias("p"), (F.coalesce(F.sum("sum").over(earlier), F.lit(0)) + start).alias("offset"))
    at = F.col("before") + F.col("offset")
    crossed = lambda x: F.shiftright(x, UNIT.bit_length() - 1)
    return local.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", ROW, "source", "size", "source_size", "target", (crossed(at + F.col("units")) - crossed(at)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """doc_id, ROW, source, size, source_size, target, copies of every document."""
    sized = staged(sizes(docs), "sizes")
    goal = targets(sized, weights, most).withColumnRenamed("source", "s")
    share = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") * F.lit(float(UNIT)) / F.greatest(F.col("source_size"), F.lit(1)).cast("double"))).cast("long")
    units = F.least(share, F.lit(most * UNIT).cast("long"))
    return systematic_sample(sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("units", units), seed)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, once per copy, with the number of the copy as copy.

    If docs has a column copy (in any case), the number is in the first of copy_2, copy_3, ... that docs hasn't.
    """
    rows, held = numbered(docs), {c.lower() for c in docs.columns}
    name = next(n for n in ("copy", *(f"copy_{i}" for i in range(2, len(held) + 3))) if n not in held)
    taken = mix(rows, **options).where("copies > 0").select(ROW, F.col("copies").cast("int").alias("__ut_copies"))
    return rows.join(taken, ROW).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__ut_copies"))).alias(name))


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM by_source
), weighted AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS place,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM weighted
), level AS (
  SELECT min(place) AS first_open, arg_min(CAST(remaining AS DOUBLE) / CAST(rest AS DOUBLE), place) AS share FROM levels WHERE remaining * weight <= cap * rest
), goal AS (
  SELECT source, source_size, CASE WHEN place < first_open THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target FROM levels, level
), units AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
    CASE WHEN g.source_size = 0 THEN 0 ELSE least(CAST(floor(g.target * {UNIT}.0::DOUBLE / CAST(greatest(g.source_size, 1) AS DOUBLE)) AS BIGINT), {MOST_COPIES * UNIT}) END AS units,
    CAST('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 6) AS BIGINT) AS start
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), summed AS (
  SELECT *, sum(units) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + start AS upto FROM units
)
SELECT doc_id, size, source_size, target, CAST((upto // {UNIT} - (upto - units) // {UNIT}) * size AS BIGINT) AS taken FROM summed
"""
