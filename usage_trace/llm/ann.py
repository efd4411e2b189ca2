"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search of it.

The graph starts from the nearest neighbours within stretches of vectors sorted along random lines. In each of
ITERATIONS rounds a node's neighbours, and nodes whose neighbour it is (SAMPLE of either, drawn by a hash), are
joined to it and compared with each other: neighbours of neighbours are likely neighbours. What is nearer than a
node's farthest neighbour replaces it. Vectors travel as bytes (one scale, then a byte for each number), as the
graph needs no exact distances. A search keeps the BEAM nearest nodes met so far for each query, and expands those
not yet expanded (STEP at a time), all queries of a block together, by joins to the graph and then to the vectors,
which gives distances in double precision; it ends when all of the beam are expanded.

Equal vectors are one node, for which their smallest ids stand (as many as a result may need), so a vector that a
third of all rows share is one node. A node has WIDTH neighbours, is in at most 2 * SAMPLE comparisons of its own, and
its candidates are merged with map-side limits. Queries are QUERIES at a time; only their vectors are broadcast.

Edge cases: vectors that are null, empty, zero, hold null or non-finite numbers, or have another length than most
take no part, as queries or candidates; rows that repeat a vec_id are candidates of their own, and one query each
with the results of each under one query_id, but no row of a query's own vec_id is its candidate; equal rows are one;
with fewer candidates than asked for all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usage_trace.llm.common import staged

WIDTH, SAMPLE, ITERATIONS, LINES, STRETCH = 24, 12, 6, 2, 1024
BEAM, STEP, ENTRIES, QUERIES, MOST_ROUNDS = 320, 128, 256, 4096, 400
#: Candidates that a comparison passes on for each of its members.
BEST = 4
PAIR = "array<struct<d:float,u:long>>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), of all vectors that take part."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = F.size("e").__gt__(0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(good)
    rows = staged(rows.select("vec_id", F.col("e").alias("embedding")), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; Spark drops the others before it shuffles."""
    return df.withColumn("__ut_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__ut_rank") <= most).drop("__ut_rank")


def _encoded(length: int, lines: int):
    def encode(batches):
        directions = np.random.default_rng(17).standard_normal((length, lines))
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, length)
            scale = np.maximum(np.abs(x).max(1), 1e-300)
            codes = np.rint(x / scale[:, None] * 127).astype(np.int8)
            blobs = [np.float32(np.clip(s, 1e-37, 3e38)).tobytes() + c.tobytes() for s, c in zip(scale, codes)]
            at = x @ directions
            yield pa.RecordBatch.from_pydict({"v": batch.column("vec_id"), "code": pa.array(blobs, pa.binary())} | {f"line{i}": pa.array(at[:, i]) for i in range(lines)})

    return encode


def _decoded(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    scale = raw[:, :4].copy().view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * (scale / 127)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances within the last axis but one."""
    n = (x**2).sum(-1)
    return np.maximum(n[..., :, None] + n[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2), 0)


def _near(ids: np.ndarray, d: np.ndarray, k: int) -> pa.Array:
    """PAIR arrays of the k nearest of each row of d."""
    k = min(k, d.shape[1] - 1)
    if k <= 0:
        return pa.array([[] for _ in range(len(d))], pa.list_(pa.struct([("d", pa.float32()), ("u", pa.int64())])))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    pairs = pa.StructArray.from_arrays([pa.array(np.take_along_axis(d, near, 1).ravel(), pa.float32()), pa.array(ids[near].ravel(), pa.int64())], ["d", "u"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * k, pa.int32()), pairs)


def _stretches(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, STRETCH):
            part = batch.slice(a, STRETCH)
            ids = np.asarray(part.column("v"))
            d = _distances(_decoded(part.column("code").to_pylist()))
            np.fill_diagonal(d, np.inf)
            yield pa.RecordBatch.from_pydict({"v": part.column("v"), "near": _near(ids, d, WIDTH)})


def _compare(batches):
    """Of the members of each center: the nearest others, where they are nearer than a member's farthest neighbour."""
    for batch in batches:
        out = ([], [], [])
        for members in batch.column("members").to_pylist():
            if len(members) < 2:
                continue
            ids = np.array([m["u"] for m in members])
            limit = np.array([m["limit"] for m in members], np.float32)
            d = _distances(_decoded([m["code"] for m in members]))
            d[ids[:, None] == ids] = np.inf
            k = min(BEST, len(ids) - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dist = np.take_along_axis(d, near, 1)
            better = dist < limit[:, None]
            for x, y in zip(out, (np.repeat(ids, k)[better.ravel()], ids[near][better], dist[better])):
                x.append(y)
        if out[0]:
            v, u, d = map(np.concatenate, out)
            yield pa.RecordBatch.from_pydict({"v": pa.array(v, pa.int64()), "u": pa.array(u, pa.int64()), "d": pa.array(d, pa.float32())})


def _best(near: Column, k: int = WIDTH) -> Column:
    """The k nearest of an array of (d, u), each u once (bytes give a pair of nodes one distance)."""
    return F.slice(F.array_sort(F.array_distinct(near)), 1, k)


def _sampled(graph: DataFrame, salt: int, most: int) -> DataFrame:
    """center, u: neighbours and reverse neighbours of each node, most of either."""
    draw = F.xxhash64("v", "u", F.lit(salt))
    edges = graph.select("v", F.explode("near.u").alias("u")).withColumn("draw", draw)
    forward = _ranked(edges, ["v"], ["draw"], most).select(F.col("v").alias("center"), "u")
    reverse = _ranked(edges, ["u"], ["draw"], most).select(F.col("u").alias("center"), F.col("v").alias("u"))
    return forward.unionByName(reverse).distinct()


def neighbour_graph(nodes: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """v, near (its neighbours, array of (squared distance, node)) for rows of vec_id and embedding, no two of them equal."""
    length = nodes.select(F.size("embedding")).first()[0]
    lines = "".join(f", line{i} double" for i in range(LINES))
    coded = staged(nodes.select("vec_id", "embedding").mapInArrow(_encoded(length, LINES), f"v long, code binary{lines}"), "codes")
    starts = [coded.select("v", "code", f"line{i}").repartitionByRange(f"line{i}").sortWithinPartitions(f"line{i}").select("v", "code").mapInArrow(_stretches, f"v long, near {PAIR}") for i in range(LINES)]
    start = starts[0]
    for x in starts[1:]:
        start = start.unionByName(x)
    start = start.groupBy("v").agg(F.flatten(F.collect_list("near")).alias("near"))
    graph = staged(coded.select("v", "code").join(start, "v").select("v", "code", _best(F.col("near")).alias("near")), "graph")
    farthest = F.when(F.size("near") >= WIDTH, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf"))).cast("float")
    for k in range(iterations):
        members = graph.select(F.col("v").alias("u"), farthest.alias("limit"), "code")
        met = _sampled(graph, k, SAMPLE).join(members, "u").groupBy("center").agg(F.collect_list(F.struct("u", "limit", "code")).alias("members"))
        found = met.select("members").mapInArrow(_compare, "v long, u long, d float").groupBy("v", "u").agg(F.min("d").alias("d"))
        found = _ranked(found, ["v"], ["d", "u"], WIDTH).groupBy("v").agg(F.collect_list(F.struct("d", "u")).alias("more"))
        near = F.when(F.col("more").isNull(), F.col("near")).otherwise(_best(F.concat("near", "more")))
        graph = staged(graph.join(found, "v", "left").select("v", "code", near.alias("near")), "graph")
    return graph.select("v", "near")


def _measure(shared, length: int):
    def measure(batches):
        queries = shared.value
        for batch in batches:
            x = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, length)
            lists = batch.column("qs")
            q = np.asarray(lists.flatten())
            which = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            for a in range(0, max(1, len(q)), 1 << 15):
                i, w = q[a : a + (1 << 15)], which[a : a + (1 << 15)]
                d = np.sqrt(((queries[i] - x[w]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({"q": pa.array(i, pa.int32()), "node": pa.array(np.asarray(batch.column("vec_id"))[w], pa.int64()), "d": pa.array(d, pa.float64())})

    return measure


def search(nodes: DataFrame, graph: DataFrame, queries: np.ndarray, k: int, beam: int = BEAM) -> DataFrame:
    """q (row of queries), node, d: the k nearest nodes that greedy search from ENTRIES nodes meets.

    It goes on until each query's beam is expanded; a round takes STEP of a beam, so MOST_ROUNDS are far more than any needs.
    """
    length = queries.shape[1]
    shared = nodes.sparkSession.sparkContext.broadcast(queries)
    measured = lambda pairs, name: staged(pairs.mapInArrow(_measure(shared, length), "q int, node long, d double"), name)
    entries = nodes.orderBy("h1", "h2").limit(ENTRIES)
    new = measured(entries.select("vec_id", "embedding", F.sequence(F.lit(0), F.lit(len(queries) - 1)).alias("qs")), "met")
    met, pool = new, new.withColumn("expanded", F.lit(False))
    for round_ in range(MOST_ROUNDS):
        pool = staged(_ranked(pool, ["q"], ["d", "node"], beam), "pool")
        front = _ranked(pool.where(~F.col("expanded")), ["q"], ["d", "node"], STEP).select("q", "node", F.lit(True).alias("now"))
        reached = front.join(graph, front["node"] == graph["v"]).select("q", F.explode("links").alias("node")).distinct()
        fresh = reached.join(met, ["q", "node"], "left_anti").groupBy("node").agg(F.collect_list("q").alias("qs"))
        new = measured(nodes.join(fresh, nodes["vec_id"] == fresh["node"]).select("vec_id", "embedding", "qs"), "met")
        met = met.unionByName(new)
        pool = pool.join(front, ["q", "node"], "left").select("q", "node", "d", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        if pool.where(~F.col("expanded")).isEmpty() and new.isEmpty():
            break
        if round_ == MOST_ROUNDS - 1:
            raise RuntimeError(f"a search wasn't done after {MOST_ROUNDS} rounds")
        pool = pool.unionByName(new.withColumn("expanded", F.lit(False)))
    return _ranked(pool.select("q", "node", "d"), ["q"], ["d", "node"], k)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for queries whose vec_id is a multiple of every, the k nearest other rows found."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    keys = F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")
    rows = usable(vectors).select("vec_id", *keys, "embedding")
    nodes = rows.groupBy("h1", "h2").agg(F.any_value("embedding").alias("embedding")).sortWithinPartitions("h1", "h2")
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("vec_id"), "h1", "h2", "embedding"), "nodes")
    members = _ranked(rows.select("vec_id", "h1", "h2").distinct(), ["h1", "h2"], ["vec_id"], k + 1)
    members = staged(members.join(nodes.select("h1", "h2", F.col("vec_id").alias("node")), ["h1", "h2"]).select("node", "vec_id"), "members")
    place = F.struct("vec_id", "h1", "h2")
    asked = staged(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", place), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], out)
    graph = neighbour_graph(nodes)
    linked = _sampled(graph, -1, WIDTH).groupBy("center").agg(F.collect_set("u").alias("links"))
    linked = staged(linked.select(F.col("center").alias("v"), "links"), "links")
    own = asked.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # rows of one id, which are nearest to each other and don't count
    found, last, number = None, None, 0
    while True:
        after = asked if last is None else asked.where(F.col("place") > F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in ("vec_id", "h1", "h2")]))
        block = after.orderBy("place").limit(QUERIES).collect()
        if not block:
            break
        last = block[-1]["place"]
        ids = spark.createDataFrame([(i, number + i, r["vec_id"]) for i, r in enumerate(block)], "q int, number long, query_id long")
        near = search(nodes, linked, np.array([r["embedding"] for r in block]), k + own, BEAM + own - 1).join(F.broadcast(ids), "q")  # of QUERIES rows at most
        number += len(block)
        found = near if found is None else found.unionByName(near)
    rows = found.join(members, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("number").orderBy("d", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", F.col("d").alias("score"))


def query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
