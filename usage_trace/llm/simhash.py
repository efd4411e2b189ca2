"""SimHash near-duplicates: a binary-trie self-join of fingerprints, then connected components.

Pairs of trie nodes are traversed together, from the root down. Each pair carries how many bits its two
prefixes differ in, and goes no further once that is over the budget. The first levels are Spark rows:
a fingerprint goes to its own node and, as a visitor, to each node of smaller prefix within the budget;
nodes that still hold too many rows go down further levels, until every block fits a task however the
fingerprints cluster. The levels below are traversed in the block, in numpy, in slices of bounded size.

Equal fingerprints are one trie leaf, with their smallest doc_id, so exact copies cost nothing here. A
block passes on the edges of a spanning forest, at most one per fingerprint, and no list of pairs.

Edge cases: a text with fewer than 3 words is one shingle; null, empty and blank texts have fingerprint
zero and are linked like others; a null doc_id has a fingerprint and links, and is the least of no component
but one of null ids alone, whose component_id is null; repeated rows each give a row (`keep_one` keeps one of
them, by a number that is written with the rows); an empty table gives an empty result; further columns are
ignored, or carried along by `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_trace.llm.common import ROW, drop, numbered, rank, scratch, staged

SHINGLE = 3
BUDGET = 2
#: Fingerprints that a block should have of its own, and rows (visitors too) beyond which it is split.
BLOCK, MOST = 1 << 14, 1 << 20
#: Bits by which a block that is too large goes down at once.
STEP = 6
#: Pairs of nodes that are traversed at once.
SLICE = 1 << 19


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text: a bit is 1 if set in over half of their XXH64."""
    tokens = (text or b"").lower().split()  # of bytes: A-Z alone, ASCII white space alone
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(tokens))
    firsts, lasts = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(firsts, lasts)), np.uint64, len(firsts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), ROW: batch.column(ROW), "fp": pa.array(found.view(np.int64), pa.int64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, ROW (0 if docs aren't numbered), fp (the bits as a signed long) of whole texts."""
    row = F.col(ROW) if ROW in docs.columns else F.lit(0).cast("long").alias(ROW)
    return docs.select(F.col("doc_id").cast("long"), row, F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id long, {ROW} long, fp long")


def _masks(bits: int, budget: int) -> list[int]:
    """All numbers of so many bits with at most budget ones."""
    out = [0]
    for _ in range(budget):
        out += [m | 1 << i for m in out for i in range(bits) if m >> i == 0]
    return sorted(set(out))


def _children(bits: int, budget: int):
    return F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("cost")) for m in _masks(bits, budget)]))


def blocks(fps: DataFrame, n: int, budget: int = BUDGET, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """depth, node, fp, own: what each block of the trie gets; n is the number of fingerprints (unique).

    Two fingerprints within the budget meet in one block exactly, as own and own or as own and visitor.
    """
    depth = max(0, (max(n, 1) - 1) // block).bit_length()
    prefix = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
    rows = fps.select("fp", prefix(depth).alias("key"), _children(depth, budget).alias("to"))
    rows = rows.select("fp", "key", F.col("key").bitwiseXOR(F.col("to.mask")).alias("node"), F.col("to.cost").alias("spent")).where("node <= key")
    rows, done = rows.select("node", "fp", "spent", (F.col("spent") == 0).alias("own")), None
    while True:
        if n > block:
            rows = staged(rows, f"trie-{depth}")
        large = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).select("node")
        split = n > most and depth < 64 and not large.isEmpty()
        ready = (rows.join(large, "node", "left_anti") if split else rows).select(F.lit(depth).alias("depth"), "node", "fp", "own")
        done = ready if done is None else done.unionByName(ready)
        if not split:
            return done
        step = min(STEP, 64 - depth)
        depth += step
        low = F.shiftrightunsigned("fp", 64 - depth).bitwiseAND(F.lit((1 << step) - 1))
        below = rows.join(large, "node", "left_semi").select("*", low.alias("key"), _children(step, budget).alias("to"))
        below = below.select("fp", "own", "key", (F.col("spent") + F.col("to.cost")).alias("spent"), F.col("key").bitwiseXOR(F.col("to.mask")).alias("child"), F.shiftleft("node", step).alias("above"), F.col("to.cost").alias("cost"))
        below = below.where((F.col("spent") <= budget) & (~F.col("own") | (F.col("child") <= F.col("key"))))
        below = staged(below.select(F.col("above").bitwiseOR(F.col("child")).alias("node"), "fp", "spent", (F.col("own") & (F.col("cost") == 0)).alias("own")), f"below-{depth}")
        rows = below.join(below.where("own").select("node").distinct(), "node", "left_semi")


def close_pairs(a: np.ndarray, b: np.ndarray | None = None, budget: int = BUDGET, top: int = 64, most: int = SLICE):
    """Yields index arrays (i, j) of all pairs within the budget: of sorted unique a with itself (i < j), or with b.

    The traversal of node pairs: a node is a range of the sorted array, found by its next bit.
    """
    own, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    one = np.array
    todo = [(top - 1, one([0]), one([len(a)]), one([0]), one([len(b)]), one([0]))]
    while todo:
        bit, a0, a1, b0, b1, spent = todo.pop()
        if len(a0) > most:
            todo += [(bit, *(x[k : k + most] for x in (a0, a1, b0, b1, spent))) for k in range(0, len(a0), most)]
            continue
        na, nb = a1 - a0, b1 - b0
        few = (na * nb <= 16) | (bit < 0)
        if few.any():
            n = (na * nb)[few]
            pair = np.repeat(np.flatnonzero(few), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[pair] + k // nb[pair], b0[pair] + k % nb[pair]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            near &= (i < j) if own else True
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, spent = (x[~few] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        shift, ones = np.uint64(bit), ~np.uint64(0)
        low = ones >> np.uint64(63 - bit)
        middle = lambda x, x0: np.searchsorted(x, (x[x0] & ~low) | (np.uint64(1) << shift))
        am, bm = np.clip(middle(a, a0), a0, a1), np.clip(middle(b, b0), b0, b1)
        same = own & (a0 == b0) & (a1 == b1)
        made = []
        for x0, x1, y0, y1, cost, mirrored in ((a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, True)):
            keep = (x0 < x1) & (y0 < y1) & (spent + cost <= budget)
            if mirrored:
                keep &= ~same
            made.append([x0[keep], x1[keep], y0[keep], y1[keep], spent[keep] + cost])
        made = [np.concatenate(x) for x in zip(*made)]
        if len(made[0]):
            todo.append((bit - 1, *made))


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; parent stays flat, with the smallest index of each tree as its root."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _forest(budget: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["own"].to_numpy(bool)
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own, guests = np.unique(fp[mine]), np.unique(fp[~mine])
        nodes, parent = np.concatenate([own, guests]), np.arange(len(own) + len(guests))
        for i, j in close_pairs(own, budget=budget):
            unite(parent, i, j)
        for i, j in close_pairs(own, guests, budget=budget):
            unite(parent, i, j + len(own))
        tied = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"a": nodes[tied].view(np.int64), "b": nodes[parent[tied]].view(np.int64)})

    return block


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges a, b (long).

    Large-star and small-star by turns: each node's larger neighbours, then its smaller ones, are tied to
    the least of them all. Only minima are aggregated, so a hub needs no list of its neighbours.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, edges = edges, staged(tied.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "small")
        drop(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components of {now[0]} edges weren't found in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, ROW, fp, and least: the rank (see common.rank) of the first row that links of at most budget differing bits lead to."""
    made = staged(fingerprints(docs), "fingerprints")
    with scratch():
        leaves = staged(made.groupBy("fp").agg(F.min(rank()).alias("least")), "leaves")
        met = blocks(leaves.select("fp"), leaves.count(), budget)
        roots = staged(components(met.groupBy("depth", "node").applyInPandas(_forest(budget), "a long, b long")), "roots")
        of_root = roots.join(leaves, roots["node"] == leaves["fp"]).groupBy("root").agg(F.min("least").alias("component"))
        named = leaves.join(roots.join(of_root, "root").select(F.col("node").alias("fp"), "component"), "fp", "left")
        named = staged(named.select("fp", F.coalesce("component", "least").alias("least")), "named", outlives=True)
    return made.join(named, "fp").select("doc_id", ROW, "fp", "least")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first row of each component: the one of the smallest doc_id (null last), of equal ids that of the smallest number."""
    rows = numbered(docs)
    gone = near_duplicates(rows, budget).where(F.col(ROW) != F.col("least.row")).select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    d = F.col("least.d")
    component = F.when(d != F.lit((1 << 63) - 1), d).otherwise(F.col("doc_id"))  # only null ids, or the largest
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
