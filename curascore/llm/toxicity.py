"""Toxicity from class-conditional Kneser-Ney bigram models, one of toxic and one of ordinary labelled texts.

Per class c, with word counts n and numbers of distinct neighbours N over the texts to learn from, and discounts D, E:

    p(w | v)  = (max(n(v, w) - D, 0) + R(v) * q(w)) / n(v .)        q(w) where v is unknown to the class
    q(w)      = (max(N(. w) - E, 0) + S * s(w)) / N(. .)            s(w) where the class has no text
    s(w)      = (M(. w) + 1) / (M(. .) + W + 1)

R(v) and S are what the discounts take off: the sums of min(n(v, .), D) and of min(N(. w), E) over all words w. M and W
are the contexts and the words of both classes together: expressions too rare for a class are judged by the shared
counts, alike in either, hence whole numbers for D and E that take rare ones off altogether. A text is described by the length-normalised difference of its
two log-likelihoods, under p and under the lower order q, and by its most telling words; a logistic fit on rows kept out of the counts makes that a score.

1. Texts become blocks of about ``BLOCK_TOKENS`` words, a table bucketed by block, so what is joined to it later moves
   and the blocks do not. Labels meet the document ids of the blocks.
2. A block sends each of its distinct bigrams once, with its counts per class, to the part of the hash range that the
   bigram belongs to. The part answers with the totals and names one block as the owner of each learned bigram.
3. Owners add what the discount takes off a bigram to its first word and a context to its second; the sums per word are
   gathered in the same way.
4. Each block meets its answers and describes its texts. Counts stay in tables that grow with the input; the driver
   holds the totals over all words and the rows of the fit only.

Words and bigrams are told apart by as many bits of a 64-bit hash as the bytes of the texts have, and 16 more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table
from curascore.llm.language_id import held_out
from curascore.llm.packing import pack, unpack
from curascore.llm.words import Words, alphanumeric, byte_texts, chunks, lowered, mix
from curascore.session import scratch_path

DISCOUNT, CONTINUED = 1, 2  # D and E
BLOCK_TOKENS = 1_000_000
BUCKET_BYTES = 12_000_000  # bytes of text in one bucket of blocks, on average
PART_BYTES = 24_000_000  # bytes of text whose bigrams form one part, on average
SPARE_BITS = 16
TOP, TELLING = 6, 3.0
FEATURES = 10
CALIBRATION_ROWS = 20_000  # rows of the logistic fit, at most
CALIBRATION_SHARE = 0.25  # of the labelled rows, at most
_START = mix(np.array([0x5EED], np.uint64))[0]
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHARES = 1_000_000
_GRAMS, _WORDS, _OWNED = 0, 1, 2  # what parts are asked for, and what owners are told

_BLOCK_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("doc_id", "none", "fold", "sizes", "words", "at"))])
_BLOCK = "block long, doc_id binary, none binary, fold binary, sizes binary, words binary, at binary"


def _packs(arrays: list[np.ndarray]) -> bytes:
    return b"".join(len(p := pack(a)).to_bytes(8, "little") + p for a in arrays)


def _unpacks(data: bytes) -> list[np.ndarray]:
    out = []
    while data:
        size = int.from_bytes(data[:8], "little")
        out.append(unpack(data[8 : 8 + size]).astype(np.int64))
        data = data[8 + size :]
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _blocks(batches, tokens: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``(doc_id, text)`` as blocks of about so many words: ids, share places, numbers of words, distinct words and their places."""
    held: list[tuple] = []
    made = 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        none, ids, fold, size, hashes = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        words, at, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # small places for frequent words
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        name = TaskContext.get().partitionId() << 32 | made
        made += 1
        parts = [pack(ids.view(np.uint64)), pack(none), pack(fold), pack(size), pack(words[order]), pack(rank[at])]
        return _table([(name, *parts)], _BLOCK_ARROW).to_batches()[0]

    total = 0
    member, fold = alphanumeric(), lowered()
    for batch in batches:
        texts, ids = byte_texts(batch.column("text")), batch.column("doc_id")
        for a, b in chunks(texts):
            words, part = Words(texts[a:b], member, fold), ids.slice(a, b - a)
            share = np.fromiter((zlib.crc32(t) % _SHARES for t in texts[a:b]), np.uint64, b - a)
            held.append((part.is_null().to_numpy(zero_copy_only=False).astype(np.uint64), part.fill_null(0).to_numpy().astype(np.int64), share,
                         np.diff(words.bounds).astype(np.uint64), words.hashes >> np.uint64(64 - bits)))
            total += len(words.hashes) + b - a
            if total >= tokens:
                yield flush()
                total = 0
    if held:
        yield flush()


class Block:
    """The words of a block's texts (``word``, with 0 the start of a text), their contexts, and its distinct bigrams."""

    def __init__(self, row: dict, bits: int, toxic: np.ndarray | None = None):
        self.null, self.ids = unpack(row["none"]).astype(bool), unpack(row["doc_id"]).view(np.int64)
        self.sizes, self.fold = unpack(row["sizes"]).astype(np.int64), unpack(row["fold"]).astype(np.int64)
        self.words = np.concatenate([[_START >> np.uint64(64 - bits)], unpack(row["words"])])
        self.word = unpack(row["at"]).astype(np.int64) + 1
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.context = np.concatenate([[0], self.word[:-1]])[: len(self.word)]
        self.context[self.bounds[:-1][self.sizes > 0]] = 0
        key = mix(self.words[self.word] * _STEP + self.words[self.context]) >> np.uint64(64 - bits)
        self.grams, first, self.gram = np.unique(key, return_index=True, return_inverse=True)
        #: The words of each distinct bigram.
        self.left, self.right = self.context[first], self.word[first]
        self.toxic = toxic  # per text: 0 and 1 as labelled and learned from, -1 neither

    def counts(self) -> list[np.ndarray]:
        label = self.toxic[self.doc]
        return [np.bincount(self.gram[label == c], minlength=len(self.grams)) for c in (0, 1)]


def _labels(block: Block, rows: list[dict], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Per text the label it is learned by, and the one it enters the logistic fit by; -1 for none."""
    toxic = np.full(len(block.sizes), -1)
    for r in rows:
        toxic[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["toxic"], np.int8)
    kept = block.fold < share * _SHARES
    return np.where(kept, -1, toxic), np.where(kept, toxic, -1)


def _ids(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, ids, none in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "none")), strict=True):
            known = np.flatnonzero(unpack(none) == 0).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(known), name)), "at": pa.array(known), "doc_id": pa.array(unpack(ids).view(np.int64)[known])})


_ASKED = "part int, kind int, block long, first int, keys binary, counts binary"
_ASKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("first", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = "block long, kind int, first int, at binary, toxic binary, counts binary, totals array<long>"
_TOLD_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("first", pa.int32()), ("at", pa.binary()), ("toxic", pa.binary()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64()))])


def _asked(kind: int, block: int, keys: np.ndarray, counts: list[np.ndarray], bits: int, parts: int) -> list[tuple]:
    """Ascending ``keys`` cut at the edges of ``parts`` equal ranges of hashes of so many bits."""
    part = ((keys >> np.uint64(max(bits - 32, 0))) * np.uint64(parts) >> np.uint64(min(bits, 32))).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    if not len(keys):
        return []
    return [(int(part[a]), kind, block, int(a), pack(keys[a:b], ascending=True), _packs([c[a:b] for c in counts]))
            for a, b in zip(first, [*first[1:], len(part)], strict=True)]


def _tell(group: pa.Table, discount: int, continued: int) -> pa.Table:
    """Sums of the counts in one range for each block that asked, and once per range of words their totals. Apart from the
    sums of bigrams the first block to ask for one, its owner, is told what the discount takes off it, others 0."""
    rows = group.to_pylist()
    kind = rows[0]["kind"]
    keys = [unpack(r["keys"], ascending=True) for r in rows]
    edges = np.cumsum([0, *map(len, keys)])
    values, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    width = 2 if kind == _GRAMS else 7
    total = np.zeros((width, len(values)), np.int64)
    for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
        for k, c in enumerate(_unpacks(r["counts"])):
            total[k, inverse[a:b]] += c  # a block asks for a key once
    own = np.zeros(edges[-1], np.int64)
    if kind == _GRAMS:
        own[first[total.any(0)]] = 1
    out = []
    for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
        told = [t[inverse[a:b]] for t in total]
        out.append((r["block"], kind, r["first"], None, None, _packs(told), None))
        if kind == _GRAMS:
            out.append((r["block"], _OWNED, r["first"], None, None, _packs([np.minimum(t, discount) * own[a:b] for t in told]), None))
    if kind == _WORDS:
        # Contexts per class and shared, what the discount takes off them per class, and the words that have some.
        sums = [*total[4:7].sum(1).tolist(), *np.minimum(total[4:6], continued).sum(1).tolist(), int((total[6] > 0).sum())]
        out.append((None, kind, None, None, None, None, sums))
    return _table(out, _TOLD_ARROW)


def _answers(right: pa.Table, kind: int, size: int, width: int) -> np.ndarray:
    found = np.zeros((width, size), np.int64)
    for r in right.select(["kind", "first", "counts"]).to_pylist():
        if r["kind"] == kind:
            for k, c in enumerate(_unpacks(r["counts"])):
                found[k, r["first"] : r["first"] + len(c)] = c
    return found


def log_likelihoods(grams: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, totals: list[int], discount: int, continued: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms ``(classes, bigrams)`` of the Kneser-Ney estimates p and q of the module's docstring.

    ``grams`` (2, bigrams) counts bigrams by class, ``words`` (7, words) has per word, by class, how often it is a
    context, what the discount takes off that, its distinct contexts, and last those of either class. ``left`` and
    ``right`` are the words of the bigrams, ``totals`` what :func:`_tell` adds up.
    """
    shared = (words[6, right] + 1) / (totals[2] + totals[5] + 1)
    out, lower = np.zeros((2, len(left))), np.zeros((2, len(left)))
    for c in (0, 1):
        q = shared
        if totals[c]:
            q = (np.maximum(words[4 + c, right] - continued, 0) + totals[3 + c] * shared) / totals[c]
        n = words[c, left]
        p = (np.maximum(grams[c] - discount, 0) + words[2 + c, left] * q) / np.maximum(n, 1)
        out[c], lower[c] = np.log(np.where(n > 0, p, q)), np.log(q)
    return out, lower


def describe(gains: list[np.ndarray], known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, for the differences of both orders: their mean over its words, the largest one, the sum of the ``TOP``
    largest, and what all words have above ``TELLING`` by the root of the length; then the logarithm of the length, and
    the share of learned bigrams."""
    out = np.zeros((len(bounds) - 1, FEATURES))
    out[:, 8] = np.log(10)
    for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if n := high - low:
            for k, gain in enumerate(gains):
                own = gain[low:high]
                top = np.partition(own, n - TOP)[n - TOP :] if n > TOP else own
                out[i, 4 * k : 4 * k + 4] = own.mean(), top.max(), top.sum(), np.maximum(own - TELLING, 0).sum() / np.sqrt(n + 20)
            out[i, 8:] = np.log(n + 10), known[low:high].mean()
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) of a penalised logistic regression; a fixed rule where one class is missing."""
    if len(set(y.tolist())) < 2:
        return np.array([-6.0, 0.0, 1.0, *[0.0] * (FEATURES - 2)])
    middle, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    w = np.zeros(z.shape[1])
    ridge = np.array([1e-6, *[penalty] * x.shape[1]])  # the constant is as good as free
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return np.concatenate([[w[0] - slope @ middle], slope])


_DESCRIBED = "doc_id long, toxic int, x array<double>, loglik array<double>"
_DESCRIBED_ARROW = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64())), ("loglik", pa.list_(pa.float64()))])


def described(docs: DataFrame, labels: DataFrame, discount: int = DISCOUNT, continued: int = CONTINUED, calibration: int = CALIBRATION_ROWS, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, ``toxic`` of rows kept for the fit (else null), the features ``x``
    and ``loglik``, the natural log-likelihoods of the text in the ordinary and the toxic model."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts, bits = max(6, -(-size // PART_BYTES)), min(64, max(32, int(size).bit_length() + SPARE_BITS))
    path = scratch_path(spark, "texts")
    name = f"texts_{path[-32:]}"
    rows.mapInArrow(lambda b: _blocks(b, tokens, bits), _BLOCK).write.bucketBy(max(6, -(-size // BUCKET_BYTES)), "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)

    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("byte").alias("toxic"))
    labels = stored(labels, "labels")
    share = min(CALIBRATION_SHARE, calibration / max(labels.count(), 1))
    # Labels grow with the documents: one join strategy at every size.
    met = blocks.select("block", "doc_id", "none").mapInArrow(_ids, "block long, at int, doc_id long").join(labels.hint("merge"), "doc_id")

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at, toxic = (group.column(c).to_numpy() for c in ("at", "toxic"))
        return _table([(group.column("block")[0].as_py(), None, None, at.astype(np.int32).tobytes(), toxic.astype(np.int8).tobytes(), None, None)], _TOLD_ARROW)

    known = stored(met.select("block", "at", "toxic").groupBy("block").applyInArrow(lambda g: gather(g), _TOLD), "known")

    def opened(left: pa.Table, right: pa.Table) -> tuple[int, Block, np.ndarray]:
        row = {c: left.column(c)[0].as_py() for c in left.schema.names}
        block = Block(row, bits)
        block.toxic, fit = _labels(block, [r for r in right.select(["at", "toxic"]).to_pylist() if r["at"] is not None], share)
        return row["block"], block, fit

    def ask_grams(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _ASKED_ARROW)
        at, block, _ = opened(left, right)
        return _table(_asked(_GRAMS, at, block.grams, block.counts(), bits, parts), _ASKED_ARROW)

    def ask_words(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _ASKED_ARROW)
        at, block, _ = opened(left, right)
        owned = _answers(right, _OWNED, len(block.grams), 2)
        add = lambda place, weight: np.bincount(place, weight, len(block.words)).astype(np.int64)
        sums = [*(add(block.left, c) for c in block.counts()), *(add(block.left, c) for c in owned), *(add(block.right, c > 0) for c in owned),
                add(block.right, owned.any(0))]
        order = np.argsort(block.words)
        return _table(_asked(_WORDS, at, block.words[order], [s[order] for s in sums], bits, parts), _ASKED_ARROW)

    def meet(told: DataFrame, ask, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, schema)

    def answered(told: DataFrame, ask, tag: str) -> DataFrame:
        return stored(meet(told, ask, _ASKED).groupBy("kind", "part").applyInArrow(lambda g: _tell(g, discount, continued), _TOLD), tag)

    grams = answered(known, ask_grams, "bigrams")
    words = answered(known.union(grams.where(F.col("kind") == _OWNED)), ask_words, "words")
    sums = words.where("block is null").select(*(F.sum(F.get("totals", F.lit(k))).alias(str(k)) for k in range(6))).first()
    totals = [s or 0 for s in sums]

    def tell_texts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _DESCRIBED_ARROW)
        _, block, fit = opened(left, right)
        of_grams, by_hash = _answers(right, _GRAMS, len(block.grams), 2), _answers(right, _WORDS, len(block.words), 7)
        of_words = np.empty_like(by_hash)
        of_words[:, np.argsort(block.words)] = by_hash
        logs, lower = (x[:, block.gram] for x in log_likelihoods(of_grams, of_words, block.left, block.right, totals, discount, continued))
        x = describe([logs[1] - logs[0], lower[1] - lower[0]], of_grams.any(0)[block.gram], block.bounds)
        both = np.stack([np.bincount(block.doc, v, len(block.sizes)) for v in logs], 1)
        return pa.Table.from_arrays([pa.array(block.ids, mask=block.null), pa.array(fit, pa.int32(), mask=fit < 0), pa.array(list(x), pa.list_(pa.float64())),
                                     pa.array(list(both), pa.list_(pa.float64()))], schema=_DESCRIBED_ARROW)

    return stored(meet(known.union(grams.where(F.col("kind") == _GRAMS)).union(words.where("block is not null")), tell_texts, _DESCRIBED), "described")


def toxicity(docs: DataFrame, labels: DataFrame, discount: int = DISCOUNT, continued: int = CONTINUED) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, score``, learned from the rows whose id is in ``labels(doc_id, toxic)``.

    Ids without a label of 0 or 1 and rows without an id are not learned from; an id with both labels is toxic. Of the
    labelled rows a share of ``CALIBRATION_ROWS`` by their number (``CALIBRATION_SHARE`` at most), chosen by the text,
    serves only for the logistic fit; all others are counted. A null or empty text has no words and gets the score of no
    evidence. Without labels of both kinds all scores follow a fixed rule. Repeated and null ids are scored row by row.
    Other columns are not looked at.
    """
    found = described(docs, labels, discount, continued)
    drawn = found.where("toxic is not null").select("x", "toxic").orderBy(F.xxhash64("x", "toxic"), "x", "toxic").limit(CALIBRATION_ROWS)
    rows = drawn.collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    constant, *weights = logistic(x, np.array([r["toxic"] for r in rows])).tolist()
    raw = sum((F.lit(w) * F.get("x", F.lit(k)) for k, w in enumerate(weights)), F.lit(constant))
    return found.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))).alias("score"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity(docs, labels.where(~held_out("doc_id", 5, 0)))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
