"""Token counts from a cache keyed by content and tokenizer version.

A text's digest is joined to stored counts; only texts without one are encoded, each distinct one once, and their
counts are appended. Copies are dropped within a task before the texts are dealt out by digest, so a text that makes
up a third of all rows travels once per task. The tokenizer never looks across white space: a text's count is the
sum over its blank-separated pieces, and a task encodes each distinct piece once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curascore.llm.base import query, table
from curascore.llm.words import Words, blank_separated, byte_texts, chunks
from curascore.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
MEMO = 1_000_000  # pieces that a task remembers; beyond that it starts anew

_SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another one are never used."""
    digest = hashlib.sha256(importlib.metadata.version("tokenizers").encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of a text normalised so far as no count can change: ASCII letters in lower case, where the text is
    ASCII and holds no mark of a special token (those are found before the tokenizer folds case)."""
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("<|"))
    return F.unhex(F.md5(F.when(plain, F.lower(text)).otherwise(text)))


class PieceCounter:
    """Counts of texts by summing over blank-separated pieces, each distinct one encoded once."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = memo
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        parts = [self._chunk(texts[a:b]) for a, b in chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        words = Words(texts, blank_separated())
        values, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
        known = self.keys[at] == values if len(self.keys) else np.zeros(len(values), bool)
        counts = np.zeros(len(values), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = words.data.tobytes()
            pieces = [data[words.starts[i] : words.ends[i]].decode("utf-8", "replace") for i in first[new]]
            counts[new] = [len(x) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            if len(self.keys) + len(new) > self.memo:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
            keys = np.concatenate([self.keys, values[new]])
            order = np.argsort(keys)
            self.keys, self.counts = keys[order], np.concatenate([self.counts, counts[new]])[order]
        total = np.concatenate([[0], np.cumsum(counts[inverse])])
        return total[words.bounds[1:]] - total[words.bounds[:-1]]


def _once(batches):
    """Rows whose content the task has not passed on yet."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """Counts of the distinct contents of ``misses(content, text)``, as rows of the cache."""

    def encode(batches):
        count = PieceCounter(path)
        for batch in _once(batches):
            n = count(byte_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=["content", "tokenizer", "n_tokens"])

    local = misses.select("content", "text").mapInArrow(_once, "content binary, text string")
    return local.repartition("content").mapInArrow(encode, _SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``; new counts go to ``cache_dir``.

    A null text counts as empty: no bytes, no tokens. Rows with a repeated or null id are counted one by one. A
    cache may hold a count more than once (two runs at a time); equal keys have equal counts. Other columns of
    ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("content"), text.alias("text"))
    stored = read_cache(spark, cache_dir, version)
    misses = rows if stored is None else rows.join(stored.select("content"), "content", "left_anti")
    encode_misses(misses, tokenizer_path, version).write.mode("append").parquet(cache_dir)
    return rows.drop("text").join(read_cache(spark, cache_dir, version), "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame | None:
    """Stored counts of this tokenizer version, one row per content; none where nothing has been stored yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    kept = spark.read.schema(_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version)
    return kept.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch_path(spark, "token-cache"))
