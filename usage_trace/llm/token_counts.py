"""Token counts with a cache by content digest.

The cache is a table of (version, digest, n_tokens): version is a digest of the tokenizer's file and
library, digest one of the content as the tokenizer sees it (a null text is the empty one; nothing else is
normalised, as that would change counts). A run joins the input's digests to the cache, encodes each
missing text once, appends the counts, and reads all counts from the cache.

Of the rows that share a missing text, the one of the smallest doc_id stands for it, so texts are joined by
doc_id, of which no value is frequent, and not by content. Where few are missing, Spark sends their digests to
the texts; where many are, each text moves once.

Edge cases: null and empty texts have 0 bytes and 0 tokens; rows that repeat a doc_id each give a row; an
empty table gives none. Special tokens' strings in a text are special tokens, as the library's default has it.
"""

from __future__ import annotations

import functools
import hashlib
import os

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usage_trace.llm.common import new_path, staged

LIMIT = 512
CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_first(path: str, version: str, at_once: int = 64):
    def encode(batches):
        count, seen = _counter(path), set()
        for batch in batches:
            digests, texts = batch.column("digest").to_pylist(), batch.column("text")
            new = []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            for k in range(0, len(new), at_once):
                rows = new[k : k + at_once]
                counts = count(texts.take(pa.array(rows)).to_pylist())
                yield pa.RecordBatch.from_pydict({"version": pa.array([version] * len(rows), pa.string()), "digest": pa.array([digests[i] for i in rows], pa.binary()), "n_tokens": pa.array(counts, pa.int64())})

    return encode


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The counts of one tokenizer. Two runs at once may append the same digest, so it is made unique here."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; cache is the path of a table that is made if it isn't there."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    missing = rows.groupBy("digest").agg(F.min("doc_id").alias("owner")).join(read_cache(spark, cache, version), "digest", "left_anti")
    missing = staged(missing, "misses").withColumnRenamed("digest", "missed")
    texts = docs.select("doc_id", digest.alias("digest"), text.alias("text"))
    texts = texts.join(missing, texts["doc_id"].eqNullSafe(missing["owner"]) & (F.col("digest") == F.col("missed"))).select("digest", "text")
    texts.mapInArrow(_encode_first(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    return rows.join(read_cache(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(docs: DataFrame) -> DataFrame:
    """Starts from an empty cache of its own, so that every distinct text is encoded."""
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(docs.sparkSession, "token-cache"))
