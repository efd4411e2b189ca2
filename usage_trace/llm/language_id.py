"""Language ID in two steps: the family first, then one-versus-one linear SVMs within it.

A text is its counts of hashed letter n-grams (2 and 3 bytes of lower-cased UTF-8, anything but letters in
ASCII being a space), divided by their number. Families are told apart by one SVM each, the languages of a
family by one SVM for each pair. All are fitted in numpy on the driver, to PER_LANGUAGE labelled rows of each
language at most (about; the rows are drawn by a hash of doc_id) with texts of LONGEST characters at most;
prediction reads whole texts. Every SVM's margins are calibrated to probabilities on the rows it was fitted to.

Edge cases: a null text, or one without a letter, is `und` with score 0; a null doc_id is not held out (and
nothing is learned from it); where no row is labelled all rows are `und`; with one label all others get it;
rows that repeat a doc_id each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_trace.llm.common import crc_mod, sliced

PER_LANGUAGE, LONGEST, BUCKETS = 400, 20_000, 4096
UNKNOWN = "und"
#: Families of languages by their ISO 639-1 codes. A code that isn't here is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "celtic": "cy ga gd",
    "semitic": "ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PIECE = 1 << 20


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams over their number."""
    data = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), _PIECE):
        x = np.frombuffer(data[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        pairs = x[:-1] << np.uint32(8) | x[1:]
        triples = pairs[:-1] << np.uint32(8) | x[2:]
        new = pairs[:_PIECE] if at + _PIECE + 2 <= len(data) else pairs
        for grams in (new | np.uint32(1 << 24), triples):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return counts / max(1, counts.sum())


class Svm:
    """Linear SVM with squared hinge loss, fitted by accelerated gradient steps, and a sigmoid over its margins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 80):
        """x: features; y: 1 or -1. Both sides weigh the same, however many rows they have."""
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
        self.mean = x.mean(0)
        self.scale = 1 / np.sqrt((x**2).mean(0) + 1e-8)
        z = (x - self.mean) * self.scale
        norm = np.sqrt((z**2).sum(1).mean()) or 1.0
        z /= norm
        w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
        rate = 0.25
        for k in range(steps):
            slack = np.maximum(0, 1 - y * (z @ v + vb)) * y * weight * 2
            w1, b1 = v + rate * (slack @ z - l2 * v), vb + rate * slack.sum()
            m = k / (k + 3)
            v, vb, w, b = w1 + m * (w1 - w), b1 + m * (b1 - b), w1, b1
        self.w = (w * self.scale / norm).astype(np.float64)
        self.b = float(b - self.mean @ self.w)
        self.slope, self.shift = self._calibrate(x @ self.w + self.b, y, weight)

    @staticmethod
    def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
        """Newton steps for the logistic regression of y on the margin, with soft targets and a small penalty."""
        goal, a, c = np.where(y > 0, 0.99, 0.01), 1.0, 0.0
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
            g, h = weight * (goal - p), weight * p * (1 - p)
            grad = np.array([(g * margin).sum() - 1e-4 * (a - 1), g.sum()])
            hess = np.array([[(h * margin**2).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, c = a + np.clip(step[0], -2, 2), c + np.clip(step[1], -2, 2)
        return float(max(a, 0.1)), float(c)


class Model:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (text, lang)."""
        langs = sorted({lang for _, lang in rows})
        self.families: dict[str, list[str]] = {}
        for lang in langs:
            self.families.setdefault(family(lang), []).append(lang)
        self.names = sorted(self.families)
        x = np.array([features(t) for t, _ in rows], np.float32).reshape(len(rows), BUCKETS)
        y = np.array([lang for _, lang in rows])
        of = np.array([family(lang) for lang in y])
        svms: list[Svm] = []
        self.pairs: dict[str, list[tuple[int, int]]] = {}
        heads = self.names if len(self.names) > 2 else self.names[:1] if len(self.names) == 2 else []
        for name in heads:
            svms.append(Svm(x, np.where(of == name, 1.0, -1.0).astype(np.float32)))
        for name, members in self.families.items():
            self.pairs[name] = list(combinations(range(len(members)), 2))
            for i, j in self.pairs[name]:
                rows_ = (y == members[i]) | (y == members[j])
                svms.append(Svm(x[rows_], np.where(y[rows_] == members[i], 1.0, -1.0).astype(np.float32)))
        self.heads = len(heads)
        self.w = np.array([s.slope * s.w for s in svms]).reshape(len(svms), BUCKETS).T.copy()
        self.b = np.array([s.slope * s.b + s.shift for s in svms])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        p = 1 / (1 + np.exp(-np.clip(features(text) @ self.w + self.b, -30, 30)))
        if self.heads > 1:
            of_family = p[: self.heads] / p[: self.heads].sum()
        else:
            of_family = np.array([p[0], 1 - p[0]]) if self.heads else np.ones(1)
        best = int(of_family.argmax())
        name, at = self.names[best], self.heads
        for other, pairs in self.pairs.items():
            if other == name:
                break
            at += len(pairs)
        members, wins = self.families[name], np.zeros(len(self.families[name]))
        votes = np.zeros(len(members))
        for k, (i, j) in enumerate(self.pairs[name]):
            q = p[at + k]
            wins += np.bincount([i, j], [q, 1 - q], len(members))
            votes[i if q >= 0.5 else j] += 1
        chosen = max(range(len(members)), key=lambda i: (votes[i], wins[i]))
        within = wins[chosen] / (len(members) - 1) if len(members) > 1 else 1.0
        return members[chosen], float(min(1.0, of_family[best] * within))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From text and lang of the documents whose crc32(doc_id) mod 4 is not 2."""
    rows = docs.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()]
    if not counts:
        return Model([])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, per_language / n)))) for lang, n in sorted(counts)])
    drawn = rows.where(draw < share).select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "text", "lang"])
    return Model(list(zip(drawn["text"], drawn["lang"])))


def _predictor(shared):
    def predict(batches):
        model = shared.value
        for batch in sliced(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            kept = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(kept | {"__ut_lang": pa.array([x for x, _ in found], pa.string()), "__ut_score": pa.array([s for _, s in found], pa.float64())})

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __ut_lang and __ut_score (names that start with __ut_ are reserved). The model has BUCKETS numbers for each family and pair of languages."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("__ut_lang", StringType()).add("__ut_score", DoubleType())
    return docs.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without those that are in no language."""
    return predict(docs, fit(docs)).where(F.col("__ut_lang") != UNKNOWN).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("__ut_lang").alias("lang_pred"), F.col("__ut_score").alias("score"))
