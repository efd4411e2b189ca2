"""Exact substring dedup over sliding spans of sentences.

A run of whole sentences counts if it has RUN sentences and WORDS words, or LONG words in however few. From
each sentence a span goes forward, and from each one backward, over as few sentences as make a run. So a
passage gives the same spans wherever it stands, and those within any run cover all of it: forward spans from
its first sentence on, backward ones up to its last. Spans are hashed (96 bits over lower-cased words), joined
over the whole corpus, and the sentences of every span that is not the first of its hash are removed. The first
is the one of the smallest doc_id (a null one after all others), and there the leftmost. Parts of sentences at a
passage's ends stay.

A document sends each of its hashes once, whatever its own repeats, and hashes are aggregated to their first
document and their number before and after the shuffle, so a passage that a third of all documents share is one
row per task. Texts are joined only to the positions that go.

Edge cases: documents are rows, by a number that is written with them, so rows that repeat a doc_id, or have
none, are documents of their own: of equal ids the row with the smallest number is the first; null and blank
texts have no sentences and stay as they are; an empty table gives an empty result; further columns are carried
along. Text without sentence ends is one sentence per line, of any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from usage_trace.llm.common import ROW, numbered, rank, scratch, sliced, staged

RUN, WORDS, LONG = 2, 20, 50
#: Up to a stop before white space or a wide stop, or to the line's end.
SENTENCE = re.compile(r"[^\s。！？](?:[^.!?\n。！？]|[.!?](?=[^\s]))*[.!?。！？]*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text or "")]


def spans(text: str | None, run: int = RUN, least: int = WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, hash) of each span, by places."""
    tokens = [text[a:b].lower().split() for a, b in sentences(text)]
    norm, upto = [" ".join(t).encode() for t in tokens], [0]
    for t in tokens:
        upto.append(upto[-1] + len(t))
    n = len(norm)

    def enough(i: int, j: int) -> bool:
        held = upto[j] - upto[i]
        return held >= LONG or (j - i >= run and held >= least)

    found, i, j = set(), 0, 0
    while i < n:
        while j < n and not enough(i, j):
            j += 1
        if not enough(i, j):
            break
        found.add((i, j))
        i += 1
    i = 0
    for j in range(1, n + 1):
        if enough(i, j):
            while enough(i + 1, j):
                i += 1
            found.add((i, j))
    return [(i, j, xxhash.xxh3_128_digest(b" ".join(norm[i:j]))) for i, j in sorted(found)]


def places(found: list[tuple[int, int, bytes]]) -> list[int]:
    """A number for each span of a text: its first sentence, or if a shorter span starts there, ~ the sentence after its last."""
    return [~j if k and found[k - 1][0] == i else i for k, (i, j, _) in enumerate(found)]


def cut(text: str, found: list[tuple[int, int, bytes]], repeated: set[int]) -> tuple[str, int, int]:
    """The text without the sentences of spans in repeated (places) or repeated within the text; sentences, and how many of them went."""
    ends = sentences(text)
    gone, seen = [False] * len(ends), {}
    for p, (i, j, h) in zip(places(found), found):
        if seen.setdefault(h, p) != p or seen[h] in repeated:
            gone[i:j] = [True] * (j - i)
    if not any(gone):
        return text, len(ends), 0
    out, at = [], 0
    for k, (a, _) in enumerate(ends):
        if gone[k]:
            out.append(text[at:a])
            at = ends[k + 1][0] if k + 1 < len(ends) else len(text)
    return "".join([*out, text[at:]]).rstrip(), len(ends), sum(gone)


def _hashes(run: int, least: int):
    def hashes(batches):
        for batch in sliced(batches):
            of, at, h = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                first: dict[bytes, int] = {}
                found = spans(text, run, least)
                for p, (_, _, x) in zip(places(found), found):
                    first.setdefault(x, p)
                of += [k] * len(first)
                at += first.values()
                h += first
            x = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            ids = {c: batch.column(c).take(pa.array(of, pa.int32())) for c in (ROW, "doc_id")}
            yield pa.RecordBatch.from_pydict({"h1": pa.array(x[:, 0].copy()), "h2": pa.array(x[:, 1].astype(np.int32)), **ids, "at": pa.array(at, pa.int32())})

    return hashes


def _cuts(run: int, least: int):
    def cuts(batches):
        for batch in sliced(batches):
            rows = [cut(t, spans(t, run, least), set(r or ())) if t else (t, 0, 0) for t, r in zip(batch.column("text").to_pylist(), batch.column("__ut_repeated").to_pylist())]
            texts, n, gone = zip(*rows) if rows else ((), (), ())
            kept = {c: batch.column(c) for c in batch.schema.names if c != "__ut_repeated"}
            yield pa.RecordBatch.from_pydict(kept | {"text": pa.array(texts, pa.string()), "__ut_sentences": pa.array(n, pa.int32()), "__ut_removed": pa.array(gone, pa.int32())})

    return cuts


def remove_repeats(docs: DataFrame, run: int = RUN, least: int = WORDS) -> DataFrame:
    """docs with their texts cut, and __ut_sentences and __ut_removed: how many there were, and how many went."""
    rows = numbered(docs)
    made = rows.where("text IS NOT NULL").select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(_hashes(run, least), f"h1 long, h2 int, {ROW} long, doc_id long, at int")
    with scratch():
        made = staged(made, "spans")
        shared = made.groupBy("h1", "h2").agg(F.min(rank()).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", F.col("first.row").alias("first"))
        shared = staged(shared, "shared")  # its size is known then; where few spans repeat, it is broadcast
        repeated = made.select("h1", "h2", ROW, "at").join(shared, ["h1", "h2"]).where(F.col(ROW) != F.col("first")).groupBy(ROW).agg(F.collect_set("at").alias("__ut_repeated"))
        repeated = staged(repeated, "repeated", outlives=True)
    joined = rows.join(repeated, ROW, "left").select(*docs.columns, "__ut_repeated")
    schema = StructType(list(docs.schema.fields)).add("__ut_sentences", IntegerType()).add("__ut_removed", IntegerType())
    return joined.mapInArrow(_cuts(run, least), schema)


def keep_rest(docs: DataFrame) -> DataFrame:
    """docs with cut texts and their n_chars (if docs has it), without those of which nothing is left."""
    kept = remove_repeats(docs).where("__ut_removed = 0 OR text <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__ut_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """Per document: what is left of its text, and how many of its sentences went."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "text", F.col("__ut_sentences").alias("n_sentences"), F.col("__ut_removed").alias("n_removed"))
