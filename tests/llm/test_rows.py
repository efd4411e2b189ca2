"""Rows that repeat a doc_id, or have none, are documents of their own: nothing unique goes, copies go, and the mix takes the rows that it counted."""

import gc
import random
import tracemalloc
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usage_trace.llm import language_id, mixing, near_copies, simhash, substring_dedup
from usage_trace.llm.common import SLICE, numbered
from usage_trace.llm.simhash import components

r = random.Random(31)
VOCABULARY = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9))) for _ in range(500)]


def prose(n):
    return " ".join(" ".join(r.choice(VOCABULARY) for _ in range(12)).capitalize() + "." for _ in range(n))


T, U, V, W, P, B = (prose(6) for _ in range(6))
IDS = [(1, T), (2, T), (2, U), (3, V), (3, V), (None, T), (None, W), (None, W), (4, None), (5, "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "c", 2, 3) for i, t in rows], "doc_id long, text string, source string, copies int, copy string, node int, least int")


@pytest.mark.parametrize("keep", [near_copies.keep_one, simhash.keep_one])
def test_one_row_of_each_text_stays(spark, keep):
    docs = frame(spark, IDS)
    kept = keep(docs)
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(1, T), (2, U), (3, V), (None, W), (4, None)], key=str)
    assert kept.columns == docs.columns and keep(docs.limit(0)).count() == 0


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("chunk", [1 << 21, 300])
def test_components_against_all_pairs(spark, chunk):
    texts = []
    for base in (prose(8) for _ in range(6)):
        for _ in range(12):  # near copies of near copies
            texts.append(base)
            w = base.split()
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            base = " ".join(w)
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    got = near_copies.labelled(numbered(frame(spark, list(enumerate(texts)))), chunk=chunk).collect()
    assert {x.doc_id: x.least.d for x in got} == dict(enumerate(label))


def test_candidates_are_simhash_ties(spark):
    """Bits are majorities; blocks of any depth, exact copies and large groups give the components of all pairs within the budgets."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    assert (near_copies.fingerprints_of(one := draw(1)) == near_copies.fingerprints_of(np.concatenate([one] * 301))).all()
    pair = draw(2)
    both = [np.unpackbits(near_copies.fingerprints_of(x)).astype(bool) for x in (pair[:1], pair[1:], pair)]
    assert (both[2] == both[0] & both[1]).all() and 0.4 < both[0].mean() < 0.6
    sets = []
    for n in (40, 300, 700):
        base = draw(n)
        sets += [np.concatenate([base[k:], draw(k)]) for k in rng.integers(0, n // 6, 20)]
    bits = np.stack([near_copies.fingerprints_of(x) for x in sets])
    ones = np.unpackbits(bits, axis=1, bitorder="little").reshape(len(sets), near_copies.TABLES, near_copies.BITS)
    label = np.arange(len(sets))
    for i, j in combinations(range(len(sets)), 2):
        apart = ones[i] != ones[j]
        if apart.sum(1).min() <= near_copies.BUDGET and apart.reshape(-1)[: near_copies.CHECKED].sum() <= near_copies.FAR and label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    assert len(set(label)) < 30
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(bits)], "node long, bits binary")
    for depth in (0, 5):
        met = nodes.mapInArrow(near_copies._dealt(depth), "table int, block int, entries binary").groupBy("table", "block").applyInPandas(near_copies._tied, "a long, b long")
        found = {x.node: x.root for x in components(met).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == label.tolist()
    entries = np.zeros(3000, near_copies._ENTRY)  # of one fingerprint and those next to it, with two checks
    entries["fp"], entries["own"], entries["check"] = np.sort(np.arange(3000) % 3), True, np.repeat(np.array([0, 2**64 - 1], np.uint64)[(np.arange(3000) % 7 == 0).astype(int)][:, None], 3, axis=1)
    assert near_copies.ties(entries).tolist() == [0 if i % 7 == 0 else 1 for i in range(3000)]


@pytest.mark.parametrize("n", [300, 900])
@pytest.mark.parametrize("depth", [0, 3])
def test_links_of_a_large_group(n, depth):
    """The tables name the same pairs where they can, so a group of near copies has a few links a node, not one for each table (39 a node and more), and they still hold it together."""
    rng = np.random.default_rng(5)
    base, bits = rng.integers(0, 1 << 64, 300, np.uint64), []
    for _ in range(n):
        one, k = base.copy(), rng.integers(1, 40)
        one[rng.choice(300, k, replace=False)] = rng.integers(0, 1 << 64, k, np.uint64)
        bits.append(near_copies.fingerprints_of(one).tobytes())
    nodes = pa.RecordBatch.from_pydict({"node": pa.array(rng.permutation(n), pa.int64()), "bits": pa.array(bits, pa.binary())})
    dealt = next(near_copies._dealt(depth)([nodes])).to_pandas()
    links = {tuple(x) for _, block in dealt.groupby(["table", "block"]) for x in near_copies._tied(block).to_numpy().tolist()}
    simhash.unite(parent := np.arange(n), *np.array(sorted(links)).T)
    assert not parent.any() and len(links) <= 4 * n * (1 + depth)


@pytest.mark.parametrize("block", [4, 1 << 19])
def test_near_copies_in_small_blocks(spark, block):
    texts = [" ".join(f"w{i}x{k}" for k in range(90)) for i in range(15)]
    texts += [t.replace("x44 ", "y44 ") for t in texts[:10]] + texts[:3]
    got = near_copies.labelled(numbered(frame(spark, list(enumerate(texts)))), block=block).collect()
    assert {x.doc_id: x.least.d for x in got} == dict(enumerate([*range(15), *range(10), *range(3)]))


def test_texts_of_their_own_are_no_candidates(spark):
    """Chance meetings of fingerprints grow with the square of their number, so only texts that share shingles get any; pairs at a similarity of 0.8 always do."""
    rng = np.random.default_rng(8)
    own, n = [prose(20) for _ in range(200)], 40
    near = [t.replace(t.split()[30], "changed", 1) for t in own[:n]]
    texts = own + near + [own[0], "", None, "one two"]
    rows = numbered(frame(spark, list(enumerate(texts)))).select("doc_id", near_copies.ROW, F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(near_copies._nodes, f"doc_id long, {near_copies.ROW} long, node long, size long, bits binary, low array<long>")
    leaves = made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("low").alias("low"))
    got = near_copies.sharing(leaves).join(leaves.select("node", "doc_id"), "node").collect()
    assert sorted(x.doc_id for x in got) == [*range(n), *range(200, 200 + n)]
    for both, a, b in ((4, 0, 1), (16, 4, 0), (16, 2, 2), (40, 5, 5), (400, 100, 0), (800, 100, 100)):
        for _ in range(300):
            drawn = rng.integers(0, 1 << 64, both + a + b, np.uint64)
            low = [set(np.sort(x)[: near_copies.LOWEST].tolist()) for x in (drawn[: both + a], np.concatenate([drawn[:both], drawn[both + a :]]))]
            assert len(low[0] & low[1]) >= near_copies.SHARED


def test_repeats_by_row(spark):
    docs = frame(spark, [(1, P), (2, P), (2, B), (None, P), (None, U), (7, B + "\n" + U), (4, None)])
    got = [(x.doc_id, x.text) for x in substring_dedup.query(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, P), (2, ""), (2, B), (None, ""), (None, ""), (7, U), (4, None)], key=str)
    kept = substring_dedup.keep_rest(docs.select("doc_id", "text"))  # no n_chars
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(1, P), (2, B), (7, U), (4, None)], key=str)


def test_mix_emits_the_rows_it_counted(spark):
    rows = [(r.choice([1, 2, 3, None]), " ".join(["w"] * n), r.choice(["a", "b", "c", None])) for n in r.sample(range(1, 400), 60)]
    docs = spark.createDataFrame([(*x, 5, "old") for x in rows], "doc_id long, text string, source string, copies int, Copy string")
    taken = Counter({(x.doc_id, x.size): x.copies for x in mixing.mix(docs).collect() if x.copies})
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "copy_2"]
    found = out.select("doc_id", F.size(F.split("text", " ")).alias("size"), "Copy", "copies", "copy_2").collect()
    assert Counter((x.doc_id, x.size) for x in found) == taken and {(x.Copy, x.copies) for x in found} == {("old", 5)}
    assert Counter((x.doc_id, x.size, x.copy_2) for x in found) == Counter((*k, i) for k, n in taken.items() for i in range(1, n + 1))
    assert mixing.emit(docs.drop("Copy")).columns[-1] == "copy"


def held(function, batches):
    """What the function yields for batches as rows, the most rows at once, and the most MB of Python and numpy at a time."""
    out, most = [], 0
    for b in function(iter(batches)):
        most = max(most, b.num_rows)
        del b
    gc.collect()
    tracemalloc.start()
    for b in function(iter(batches)):
        del b
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    for b in function(iter(batches)):
        out += b.to_pylist()
    return out, most, peak


def test_workers_hold_few_texts_at_once():
    """A batch of Spark's has 10,000 texts, and a worker is to hold the objects of a few hundred at most."""
    long = "".join(r.choice("abcdefgh") for _ in range(20_000))
    texts = [None, "", "short one"] + [" ".join(long[k * 7 + i * 200 :][:200] for i in range(70)) + "." for k in range(900)] + ["a b c"]
    ids = pa.array(range(len(texts)), pa.int64())
    columns = {"doc_id": ids, near_copies.ROW: ids}
    model = SimpleNamespace(value=SimpleNamespace(predict=lambda t: (str(len(t or "")), 1.0)))
    repeated = pa.array([None] * len(texts), pa.list_(pa.int32()))
    cases = [
        (near_copies._nodes, columns | {"text": pa.array([t and t.encode() for t in texts], pa.binary())}),
        (substring_dedup._hashes(2, 20), columns | {"text": pa.array([t or "" for t in texts])}),
        (substring_dedup._cuts(2, 20), columns | {"text": pa.array(texts), "__ut_repeated": repeated}),
        (language_id._predictor(model), columns | {"text": pa.array(texts)}),
    ]
    for function, data in cases:
        batch = pa.RecordBatch.from_pydict(data)
        whole, most, peak = held(function, [batch.slice(0, 0), batch])
        assert peak < 11, (function, peak)  # the texts have 12.7 MB
        assert whole == held(function, [batch.slice(i, 1) for i in range(batch.num_rows)])[0]
        if function.__name__ != "hashes":
            assert len(whole) == len(texts) and most <= SLICE
    nodes = pa.RecordBatch.from_pydict({"node": pa.array(range(5000), pa.int64()), "bits": pa.array([r.randbytes(144) for _ in range(5000)], pa.binary())})
    dealt, _, peak = held(near_copies._dealt(0), [nodes])
    entries = Counter((x["table"], n) for x in dealt for n in np.frombuffer(x["entries"], near_copies._ENTRY)["node"].tolist())
    assert len(entries) == near_copies.TABLES * 5000 and set(entries.values()) == {1}
    assert peak < 9, peak  # all entries have 9.8 MB
