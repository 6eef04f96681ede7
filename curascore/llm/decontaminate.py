"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of all benchmark items. A shift table over blocks of words tells how far the search may jump
without missing a window's end; where it says zero, the bucket of windows with that last block is tested, first by
word hashes, then byte by byte. Many texts are searched side by side: one cursor per stretch of a text, all cursors
jumping at once.

The benchmark is read in blocks of bounded bytes; each block is one pass over the texts that adds to the marks of the
passes before, so neither the driver nor a task holds more than one block's tables at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curascore.llm.base import query, stored, table
from curascore.llm.words import Words, alphanumeric, byte_texts, chunks, lowered, mix, runs_of

WINDOW_WORDS = 13
BLOCK_BYTES = 8_000_000  # benchmark text per pass
STRETCH = 512  # words that one cursor covers
SHARE = 20  # contaminated from one hit word in so many words on
_PAIRS = 500_000  # candidate tests at a time


def item_words(texts: list[bytes]) -> list[list[bytes]]:
    words = Words(texts, alphanumeric(), lowered())
    data = words.data.tobytes()
    spans = list(zip(words.starts.tolist(), words.ends.tolist(), strict=True))
    return [[data[a:b] for a, b in spans[i:j]] for i, j in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


class Patterns:
    """Shift and bucket tables for all windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.strings = list(windows)
        self.items = [sorted(windows[x]) for x in self.strings]
        self.length = len(self.strings[0])
        self.block = min(2, self.length)
        flat = Words([b" ".join(x) for x in self.strings], alphanumeric())
        self.words = flat.hashes.reshape(len(self.strings), self.length)
        bits = max(12, int(np.ceil(np.log2(4 * self.words.size))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.length - self.block + 1, np.int32)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, (self._blocks(self.words, end) & self.mask).astype(np.int64), self.length - 1 - end)
        last = self._blocks(self.words, self.length - 1)
        order = np.argsort(last, kind="stable")
        self.bucket, self.order = last[order], order

    def _blocks(self, words: np.ndarray, end: int) -> np.ndarray:
        x = words[:, end]
        return mix(x + words[:, end - 1] * np.uint64(3)) if self.block == 2 else mix(x)

    def _block_at(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = words[at]
        return mix(x + words[at - 1] * np.uint64(3)) if self.block == 2 else mix(x)

    def _stops(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Positions of a last word where the shift table lets no window be skipped."""
        first, end = bounds[:-1] + self.length - 1, bounds[1:]
        count = np.maximum(0, -((first - end) // STRETCH))
        doc = np.repeat(np.arange(len(first)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = first[doc] + nth * STRETCH
        stop = np.minimum(at + STRETCH, end[doc])
        found = []
        while len(at):
            jump = self.shift[(self._block_at(words, at) & self.mask).astype(np.int64)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, text: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position of the first word, window number)."""
        stops = self._stops(hashes, text.bounds)
        last = self._block_at(hashes, stops) if len(stops) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.bucket, last, "left"), np.searchsorted(self.bucket, last, "right")
        stops, low, high = stops[high > low], low[high > low], high[high > low]
        data = text.data.tobytes() if len(stops) else b""
        size = np.cumsum(high - low)
        start = 0
        while start < len(stops):
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + _PAIRS, "right")))
            k = high[start:end] - low[start:end]
            at = np.repeat(stops[start:end], k)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            which = self.order[np.repeat(low[start:end], k) + nth]
            start = end
            for j in range(self.length):
                same = hashes[at - self.length + 1 + j] == self.words[which, j]
                at, which = at[same], which[same]
            at = at - self.length + 1
            exact = np.fromiter(
                (all(data[text.starts[a + j] : text.ends[a + j]] == w for j, w in enumerate(self.strings[p]))
                 for a, p in zip(at.tolist(), which.tolist(), strict=True)), bool, len(at))
            yield at[exact], which[exact]


def tables(items: list[tuple[str, bytes]], window: int = WINDOW_WORDS) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for (name, _), words in zip(items, item_words([t for _, t in items]), strict=True):
        size = min(len(words), window)
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(name)
    return [Patterns(by_length[n]) for n in sorted(by_length)]


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of about ``limit`` bytes of text at most (or one item), read one after the other."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        text = row[1].encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((row[0], text))
        size += len(text) + 64
    if held:
        yield held


_MARKS = "n_words long, n_hit long, hits binary, items array<string>"


def _search(batches, shared, keep: list[str]):
    patterns = shared.value if shared is not None else []
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        before = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        n_words, n_hit, hits, items = [], [], [], []
        for start, end in chunks(texts):
            text = Words(texts[start:end], alphanumeric(), lowered())
            hashes = text.hashes
            edge = np.zeros(len(hashes) + 1, np.int64)
            named: dict[int, set[str]] = {}
            for group in patterns:
                for at, which in group.occurrences(text, hashes):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + group.length, -1)
                    docs = np.searchsorted(text.bounds, at, "right") - 1
                    for doc, pattern in np.unique(np.stack([docs, which], 1), axis=0).tolist() if len(at) else ():
                        named.setdefault(doc, set()).update(group.items[pattern])
            mark = np.cumsum(edge[:-1]) > 0
            for i, (a, b) in enumerate(zip(text.bounds[:-1], text.bounds[1:], strict=True)):
                own, old = mark[a:b], before[0][start + i]
                if old:
                    own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=b - a).astype(bool)
                found = int(own.sum())
                n_words.append(b - a)
                n_hit.append(found)
                hits.append(np.packbits(own).tobytes() if found else b"")
                items.append(sorted(named.get(i, set()) | set(before[1][start + i] or ())))
        columns = {k: batch.column(k) for k in keep}
        columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(hits, pa.binary()),
                    "items": pa.array(items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_pydict(columns)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, share: int = SHARE,
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (with ``text``): the columns of ``carry``, ``n_words, n_hit, items, contaminated``.

    Words are runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z. A window is ``window`` consecutive
    words of a benchmark text, or the whole text if it has fewer (but any) words. A word inside an occurrence is hit;
    ``items`` are the ids of items with an occurring window; contaminated: ``n_hit > 0 and share * n_hit >= n_words``.
    A null or empty text has no words. Benchmark rows without id or text take no part; repeated ids count once. An
    empty benchmark leaves every row clean. Columns not in
    ``carry`` are not looked at; those in it must not be named like the results.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*(F.col(c) for c in dict.fromkeys((*carry, "text"))), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    shared = None
    for block in blocks(benchmark, block_bytes):
        if shared is not None:
            # The marks so far are written, so that a task has one worker with one block's tables at a time.
            rows = stored(_pass(rows, shared, list(dict.fromkeys((*carry, "text")))).drop("n_words", "n_hit"), "marks")
            shared.unpersist()
        shared = sc.broadcast(tables(block, window))
    rows = _pass(rows, shared, list(carry))
    return rows.select(*carry, "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def _pass(rows: DataFrame, shared, keep: list[str]) -> DataFrame:
    schema = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(_MARKS).fields)
    return rows.mapInArrow(lambda x: _search(x, shared, keep), schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce({_WORDS}, []) as ws from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark where item_id is not null and text is not null),
bw as (select distinct item, n, array_to_string(ws[i:i+n-1], ' ') as win from (
  select item, ws, least(len(ws), 13) as n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as i from b where len(ws) > 0)),
lens as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(ws[i:i+n-1], ' ') as win from (
  select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d cross join lens where len(ws) >= n)),
m as (select rid, i, n, item from dw join bw using (win, n)),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
it as (select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha from (select distinct rid, item from m) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (rid) left join it using (rid)"""


@query("op6_benchmark_decontamination", SQL)
def op6_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
