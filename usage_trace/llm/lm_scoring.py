"""Scores of texts under a log-bilinear language model, beside those of a smoothed unigram model.

The model predicts a token from the two before it: r = x[w1] * c1 + x[w2] * c2, and the logit of token v is
r . q[v] + b[v]. Its outputs are the WORDS most frequent tokens and CLASSES classes of all others, by a hash
of their last three bytes; a token of a class then has its share of the class's smoothed counts, so every
token has a probability and they sum to one. It is trained in numpy by noise-contrastive estimation: each
task trains from the same parameters on its own windows, which are one in EVERY positions of all training
texts, and the results are averaged, ROUNDS times. As exp(a + b) = exp(a) exp(b), one matrix product of
the two positions' exponentials gives the normaliser of every pair of context tokens, and a token's exact
log-probability is then read from three tables.

Counts are of all training tokens. Those of the HEAD most frequent ones (none over 64 bytes) go to every
task, a table whose size is bounded by these two numbers; the counts of all rarer tokens reach the texts that
hold them by a join, after each text has summed up its own.

Edge cases: a null text is the empty one (its end is its only token); a null doc_id is neither held out nor
learned from; with nothing to learn from, every token is unseen and base_score is 0; repeated rows each give a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_trace.llm.common import crc_mod, drop, staged

WORDS, CLASSES, HEAD, LONGEST = 1024, 512, 1 << 17, 64
WIDTH, BATCH, NOISE = 32, 512, 64
#: Of SHARES parts of the windows, up to which each round trains; windows of a row of the table of windows.
SHARES, ROUNDS, ROW_WINDOWS = 8, (1, 2, 4, 8), 1 << 16
ALPHA = 0.1
END = b""  # no word is empty


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def _counts(batches):
    found: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.binary()), "n": pa.array(found.values(), pa.int64())})
        found.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            found.update(tokens(text))
            if len(found) > 500_000:
                yield rows()
    yield rows()


class Vocabulary:
    """The head of the counts, and the sums that stand for the rest."""

    def __init__(self, head: list[tuple[bytes, int]], by_class: dict[int, tuple[int, int]], n: int, v: int):
        """head: most frequent first; by_class: tokens and types of all, by class."""
        words = head[:WORDS]
        self.n, self.outputs = n, len(words) + CLASSES
        total, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (a, b) in by_class.items():
            total[k], types[k] = a, b
        for token, c in words:
            total[class_of(token)] -= c
            types[class_of(token)] -= 1
        mass = total + ALPHA * types + ALPHA  # the last is for tokens never seen
        self.first_class = len(words)
        self.log_mass = np.log10(mass)
        self.log_all = math.log10(n + ALPHA * (v + 1))
        self.index = {token: i for i, (token, _) in enumerate(head)}
        counts = np.array([c for _, c in head], float)
        self.ids = np.array([i if i < len(words) else self.first_class + class_of(t) for i, (t, _) in enumerate(head)], np.int16)
        self.base = np.log10(counts + ALPHA) - self.log_all
        self.share = np.zeros(len(head))
        self.share[len(words) :] = np.log10(counts + ALPHA)[len(words) :] - self.log_mass[self.ids[len(words) :] - self.first_class]
        self.unigram = np.concatenate([counts[: len(words)], mass])
        self.unigram /= self.unigram.sum()

    def look_up(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Outputs of a text's tokens; their places in the head, -1 if not there; those not there."""
        found = tokens(text)
        places = np.fromiter(map(self.index.get, found, repeat(-1)), np.int32, len(found))
        rare = np.flatnonzero(places < 0)
        ids = self.ids[places] if len(self.ids) else np.zeros(len(found), np.int16)
        others = [found[i] for i in rare.tolist()]
        ids[rare] = [self.first_class + class_of(t) for t in others]
        return ids, places, others

    def before(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(2, self.outputs, np.int16)
        padded = np.concatenate([start, ids])
        return padded[1:-1], padded[:-2]


def _windows(shared):
    def windows(batches):
        vocabulary, held, size = shared.value, [], 0

        def rows(upto: int):
            """Whole rows of the windows held, and the rest."""
            all_ = np.concatenate(held)
            blobs = [all_[k : k + ROW_WINDOWS].tobytes() for k in range(0, upto, ROW_WINDOWS)]
            return pa.RecordBatch.from_pydict({"ids": pa.array(blobs, pa.binary())}), all_[upto:]

        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids, _, _ = vocabulary.look_up(text)
                w1, w2 = vocabulary.before(ids)
                held.append(np.stack([w2, w1, ids], axis=1))
                size += len(ids)
                if size >= 8 * ROW_WINDOWS:
                    made, rest = rows(size - size % ROW_WINDOWS)
                    held, size = [rest], len(rest)
                    yield made
        if size:
            yield rows(size)[0]

    return windows


class Parameters:
    NAMES = ("x", "q", "b", "c")

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        r, k = np.random.default_rng(seed), len(unigram)
        self.x = (r.standard_normal((k + 1, WIDTH)) * 0.1).astype(np.float32)
        self.q = (r.standard_normal((k, WIDTH)) * 0.1).astype(np.float32)
        self.b = np.log(unigram).astype(np.float32)
        self.c = np.stack([np.ones(WIDTH), np.full(WIDTH, 0.5)]).astype(np.float32)
        self.noise, self.log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
        self.squares = None

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def _step(self, value: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate) -> None:
        """AdaGrad; rows may repeat."""
        order = np.argsort(rows, kind="stable")  # of short integers, so by radix
        sorted_ = rows.take(order)
        firsts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        own = sorted_.take(firsts)
        pairs = np.ascontiguousarray(gradient).view(np.complex64).take(order, axis=0)  # two columns an addition
        sums = np.add.reduceat(pairs, firsts, axis=0).view(np.float32)
        more = squares.take(own, axis=0)
        more += sums * sums
        squares[own] = more
        np.sqrt(more, out=more)
        np.divide(sums, more, out=sums)
        sums *= rate
        sums += value.take(own, axis=0)
        value[own] = sums

    def train(self, windows: np.ndarray, r: np.random.Generator, rate: float) -> None:
        """Noise-contrastive steps: each batch shares its noise tokens."""
        if self.squares is None:
            self.squares = [np.full((len(self.q), WIDTH + 2), 1e-2, np.float32), np.full_like(self.x, 1e-2), np.full_like(self.c, 1e-2)]
        sq, sx, sc = self.squares
        qb = np.concatenate([self.q, self.b[:, None], np.zeros_like(self.b)[:, None]], axis=1)  # the bias is the weight of a constant; an even number of columns
        rates = np.full(WIDTH + 2, rate, np.float32)
        rates[WIDTH] *= 0.5
        scale, windows = np.float32(1 / 64), windows.take(r.permutation(len(windows)), axis=0)
        context = np.ones((BATCH, WIDTH + 2), np.float32)
        context[:, -1] = 0
        for k in range(0, len(windows), BATCH):
            w2, w1, w = windows[k : k + BATCH].T.copy()
            noise = np.minimum(np.searchsorted(self.noise, r.random(NOISE)), len(self.b) - 1).astype(np.int16)
            x1, x2, q, qn = self.x.take(w1, axis=0), self.x.take(w2, axis=0), qb.take(w, axis=0), qb.take(noise, axis=0)
            h = context[: len(w)]
            np.multiply(x1, self.c[0], out=h[:, :WIDTH])
            h[:, :WIDTH] += x2 * self.c[1]
            true = scale / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, q) - self.log_noise.take(w), -30, 30)))  # 1 - P(data)
            against = -qn
            against[:, WIDTH] += self.log_noise.take(noise)
            false = h @ against.T
            with np.errstate(over="ignore"):  # beyond the largest number, 1 / exp is 0
                np.exp(false, out=false)
            false += 1
            np.divide(scale, false, out=false)  # P(data)
            towards = true[:, None] * h
            dh = true[:, None] * q[:, :WIDTH]
            dh -= false @ qn[:, :WIDTH]
            self._step(qb, sq, np.concatenate([w, noise]), np.concatenate([towards, -(h.T @ false).T]), rates)
            dc = np.stack([np.einsum("ij,ij->j", dh, x1), np.einsum("ij,ij->j", dh, x2)])
            self._step(self.x, sx, np.concatenate([w1, w2]), np.concatenate([dh * self.c[0], dh * self.c[1]]), rate)
            sc += dc**2
            self.c += np.float32(rate * 0.1) * dc / np.sqrt(sc)
        self.q, self.b = qb[:, :WIDTH].copy(), qb[:, WIDTH].copy()

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 factors of (w1, w) and (w2, w), and log10 normalisers of (w1, w2)."""
        a, b = (self.x * self.c[0]) @ self.q.T, (self.x * self.c[1]) @ self.q.T + self.b
        at, bt = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(a - at) @ np.exp(b - bt).T, 1e-37)) + at + bt.T
        e = np.float32(1 / math.log(10))
        return a * e, b * e, z.astype(np.float32) * e


def _trainer(shared, number: int):
    first, last = ([0, *ROUNDS][number : number + 2])

    def train(batches):
        from pyspark import TaskContext

        parameters, rate = shared.value
        part = TaskContext.get().partitionId()
        r, n = np.random.default_rng([number, part]), 0
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                rows = np.frombuffer(blob, np.int16).reshape(-1, 3)
                rows = rows[len(rows) * first // SHARES : len(rows) * last // SHARES]
                parameters.train(rows, r, rate)
                n += len(rows)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "flat": pa.array([parameters.flat().tobytes()], pa.binary())})

    return train


def _average(batches):
    total, n, least = None, 0, None
    for batch in batches:
        for part, k, flat in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "flat"))):
            own = np.frombuffer(flat, np.float32).astype(np.float64) * k
            total, n, least = own if total is None else total + own, n + k, part if least is None else least
    if n:
        yield pa.RecordBatch.from_pydict({"part": pa.array([least], pa.int32()), "n": pa.array([n], pa.int64()), "flat": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})


def train(windows: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Trains once on every window, in rounds of growing parts of them.

    Of so many tasks the square root average the others' results, in order of their numbers; their averages go to the driver.
    """
    sc = windows.sparkSession.sparkContext
    parameters, schema = Parameters(vocabulary.unigram), "part int, n long, flat binary"
    groups = max(1, math.isqrt(windows.rdd.getNumPartitions()))
    for k in range(len(ROUNDS)):
        shared = sc.broadcast((parameters, 0.3 / (1 + k)))
        trained = windows.mapInArrow(_trainer(shared, k), schema).repartition(groups, F.pmod("part", F.lit(groups))).sortWithinPartitions("part")
        averaged = sorted(trained.mapInArrow(_average, schema).collect(), key=lambda x: x["part"])
        shared.unpersist()
        n = sum(x["n"] for x in averaged)
        if n:
            parameters.set(sum(np.frombuffer(x["flat"], np.float32).astype(np.float64) * (x["n"] / n) for x in averaged))
    return parameters


def _scorer(shared):
    def score(batches):
        vocabulary, (a, b, z) = shared.value
        for batch in batches:
            rows = {k: [] for k in ("n_tokens", "known", "base", "score", "rare", "times")}
            for text in batch.column("text").to_pylist():
                ids, places, others = vocabulary.look_up(text)
                w1, w2 = vocabulary.before(ids)
                head = places[places >= 0]
                rare = Counter(others)
                lost = sum(vocabulary.log_mass[class_of(t)] * k for t, k in rare.items())
                score = (a[w1, ids] + b[w2, ids] - z[w1, w2]).sum(dtype=np.float64)
                for k, v in zip(rows, (len(ids), len(head), vocabulary.base[head].sum() - vocabulary.log_all * len(others), score + vocabulary.share[head].sum() - lost, list(rare), list(rare.values()))):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})

    return score


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Parameters]:
    """Counts (token, c), vocabulary and parameters, from the documents whose crc32(doc_id) mod 10 is not 0."""
    sc = docs.sparkSession.sparkContext
    learned = docs.where(crc_mod(F.col("doc_id"), 10) != 0).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counts = staged(learned.select("text").mapInArrow(_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    first = counts.where(F.octet_length("token") <= LONGEST).orderBy(F.desc("c"), "token").limit(HEAD).select("token", "c").toArrow()
    head = list(zip(first.column("token").to_pylist(), first.column("c").to_pylist()))
    kind = F.crc32(F.when(F.octet_length("token") > 3, F.substring("token", -3, 3)).otherwise(F.col("token"))) % CLASSES
    by_class = {r["k"]: (r["c"], r["types"]) for r in counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()}
    vocabulary = Vocabulary(head, by_class, n, v)
    shared = sc.broadcast(vocabulary)
    windows = staged(learned.mapInArrow(_windows(shared), "ids binary"), "windows")
    shared.unpersist()
    parameters = train(windows, vocabulary)
    drop(windows)
    return counts, vocabulary, parameters


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, parameters: Parameters) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parameters.tables()))
    schema = "doc_id long, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_scorer(shared), schema)
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = made.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("token"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + ALPHA)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return made.drop("rare", "times").join(sums, "row", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def query(docs: DataFrame) -> DataFrame:
    counts, vocabulary, parameters = fit(docs)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))
    return score(docs, counts, vocabulary, parameters).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")
