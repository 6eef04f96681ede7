"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context-frequency buckets.

1. Texts become token streams (words and one end), packed in blocks of about a million tokens that are written once.
   A block sends each of its distinct n-grams of every order once, with its count among the texts to learn from, to the
   part of the hash range that the n-gram belongs to. However frequent an n-gram is, a part hears of it once per block.
2. A part adds up the counts and answers each block in the order of its question. Blocks and answers meet, so that each
   token has the counts of its n-grams and of their contexts.
3. Held-out counts: every text to learn from is held out in turn, its own counts taken off all counts its tokens meet
   (deleted estimation with one text at a time). What is left gives the estimates of each order; equal ones are gathered
   on a logarithmic grid in a written table, over all texts. Expectation-maximisation passes over that table learn one
   weight per order and bucket, a bucket being the longest context that is known and the power of two of its count.
4. All texts are scored with the full counts and those weights.

N-grams are told apart by 64-bit hashes. A text is never cut; one longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.llm import sums
from curascore.llm.base import query, stored, table
from curascore.llm.packing import pack, unpack
from curascore.llm.words import Words, blank_separated, byte_texts, chunks, lowered, mix

ORDER = 2  # of the registered query; each further order ships about six bytes per token once more
BLOCK_TOKENS = 1_000_000
PART_BYTES = 24_000_000  # bytes of text whose n-grams form one part, on average
BUCKETS = 40  # powers of two of a context's count
GRID = 8  # cells of the logarithmic grid per power of two
ROUNDS, SETTLED = 40, 1e-4
_START, _END = (mix(np.array([x], np.uint64))[0] for x in (0x5EED, 0xE11D))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)

_BLOCK = "block string, rows int, doc_id binary, none binary, out binary, sizes binary, words binary, at binary"
_BLOCK_ARROW = pa.schema([("block", pa.string()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("doc_id", "none", "out", "sizes", "words", "at"))])


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows of ``(doc_id, text, out)`` as blocks: ids, which texts are held out, token counts, words and their places."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        ids, out, size, hashes = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        none = np.concatenate([h[0] for h in held])
        held.clear()
        words, at, often = np.unique(hashes, return_inverse=True, return_counts=True)
        # Frequent words come first: small places pack well.
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        parts = [pack(ids.view(np.uint64)), pack(none), pack(out), pack(size), pack(words[order]), pack(rank[at])]
        name = hashlib.blake2b(b"".join(parts), digest_size=16).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], schema=_BLOCK_ARROW)

    total = 0
    member, fold = blank_separated(), lowered()
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        ids, out = batch.column("doc_id"), np.array(batch.column("out").to_pylist(), np.uint64)
        for a, b in chunks(texts):
            words = Words(texts[a:b], member, fold)
            part = ids.slice(a, b - a)
            held.append((part.is_null().to_numpy(zero_copy_only=False).astype(np.uint64), part.fill_null(0).to_numpy().astype(np.int64), out[a:b],
                         np.diff(words.bounds).astype(np.uint64), words.hashes))
            total += len(words.hashes)
            if total >= BLOCK_TOKENS:
                yield flush()
                total = 0
    if held:
        yield flush()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, so that only one block is unpacked."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class Block:
    """The token streams of a block and, for each order, the distinct n-grams and which of them ends at each token."""

    def __init__(self, row: dict, order: int):
        self.null = unpack(row["none"]).astype(bool)
        self.ids = unpack(row["doc_id"]).view(np.int64)
        self.out = unpack(row["out"]).astype(bool)
        size = unpack(row["sizes"]).astype(np.int64)
        plain = unpack(row["words"])[unpack(row["at"]).astype(np.int64)]
        # One end after each text's words.
        self.sizes = size + 1
        self.ends = np.cumsum(self.sizes) - 1
        self.starts = self.ends - size
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), self.sizes)
        tokens = np.empty(len(plain) + len(size), np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[self.ends] = False
        tokens[inside], tokens[self.ends] = plain, _END
        self.place = (np.arange(len(tokens)) - self.starts[self.doc]).astype(np.int32)
        learn = ~self.out[self.doc]
        #: Per order the sorted distinct n-grams, each token's one, and their counts among the texts to learn from.
        self.grams, self.at, self.own = [], [], []
        key = tokens
        for k in range(order):
            if k:
                # The token k places before, or the start.
                before = np.full(len(tokens), _START, np.uint64)
                before[k:][self.place[k:] >= k] = tokens[:-k][self.place[k:] >= k]
                key = mix(key * _STEP + before + np.uint64(k))
                del before
            grams, at = np.unique(key, return_inverse=True)
            self.grams.append(grams)
            self.at.append(at.astype(np.int32))
            self.own.append(np.bincount(at[learn], minlength=len(grams)))

    def asked(self, k: int, parts: int) -> Iterator[tuple[int, int, int]]:
        """``(part, from, to)``: the ranges of this order's n-grams that fall to each part."""
        part = _part_of(self.grams[k], parts)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of hashes, so that ascending n-grams have ascending parts."""
    return (((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


_ASKED = "part int, block string, k int, first int, grams binary, counts binary"
_ASKED_ARROW = pa.schema([("part", pa.int32()), ("block", pa.string()), ("k", pa.int32()), ("first", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_TOLD = "block string, k int, first int, counts binary, tokens long, types long"
_TOLD_ARROW = pa.schema([("block", pa.string()), ("k", pa.int32()), ("first", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _ask(order: int, parts: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                block = Block(row, order)
                for k in range(order):
                    rows = [(part, row["block"], k, a, pack(block.grams[k][a:b], ascending=True), pack(block.own[k][a:b])) for part, a, b in block.asked(k, parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ASKED_ARROW.types)], schema=_ASKED_ARROW)

    return run


def _tell(group: pa.Table) -> pa.Table:
    """The sums of one order's counts in one range, for every block that asked; tokens and types once per range."""
    rows = group.to_pylist()
    asked = [unpack(r["grams"], ascending=True) for r in rows]
    edges = np.cumsum([0, *map(len, asked)])
    values, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
        counts[inverse[a:b]] += unpack(r["counts"]).astype(np.int64)  # a block asks for an n-gram once
    made = [(r["block"], r["k"], r["first"], pack(counts[inverse[a:b]]), 0, 0) for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True)]
    made.append((None, rows[0]["k"], None, None, int(counts.sum()), int((counts > 0).sum())))
    return pa.Table.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(_TOLD_ARROW.types)], schema=_TOLD_ARROW)


class Counts:
    """For every token of a block, per order, the count of its n-gram and of that n-gram's context."""

    def __init__(self, block: Block, told: list[np.ndarray], n: int, texts: int):
        self.block, self.n, self.texts = block, n, texts
        self.gram = [t[at] for t, at in zip(told, block.at, strict=True)]
        self.context = [np.full(len(block.doc), n)] + [self._before(self.gram[k - 1], block.place, texts) for k in range(1, len(told))]

    @staticmethod
    def _before(gram: np.ndarray, place: np.ndarray, texts: int) -> np.ndarray:
        """What the context one token earlier has; before the first token that is the start, once per text."""
        out = np.empty_like(gram)
        out[1:] = gram[:-1]
        out[place == 0] = texts
        return out

    def without_own(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both counts of the tokens of texts to learn from, each text's own occurrences taken off."""
        block = self.block
        keep = ~block.out[block.doc]
        doc, place = block.doc[keep], block.place[keep]
        gram, context = [], []
        own_before = block.sizes[doc]
        for k, at in enumerate(block.at):
            pair = doc.astype(np.int64) * len(block.grams[k]) + at[keep]
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            own = count[inverse]
            gram.append(self.gram[k][keep] - own)
            context.append(self.context[k][keep] - own_before)
            own_before = self._before(own, place, 1)
        return gram, context


def estimates(gram: list[np.ndarray], context: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (tokens, orders), 0 where a context is unknown, and the buckets of the contexts."""
    ml = np.stack([g / np.maximum(c, 1) for g, c in zip(gram, context, strict=True)], 1)
    bucket = np.zeros(len(ml), np.int64)
    for k in range(1, len(gram)):
        known = context[k] > 0
        level = np.minimum(np.log2(np.maximum(context[k], 1)).astype(np.int64), BUCKETS - 1)
        bucket = np.where(known, 1 + (k - 1) * BUCKETS + level, bucket)
    return ml, bucket


def _cells(ml: np.ndarray) -> np.ndarray:
    """Grid places of estimates: 0 for none, else the rounded logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(ml > 0, 1 + np.round(-np.log2(ml) * GRID), 0).astype(np.int64)


def centres(cells: np.ndarray) -> np.ndarray:
    return np.where(cells > 0, np.exp2(-(cells - 1) / GRID), 0.0)


def learn_weights(totals, buckets: int, orders: int) -> np.ndarray:
    """Weights (buckets, 1 + orders) of the uniform estimate and of each order, by expectation-maximisation.

    ``totals(weights)`` gives per bucket the expected number of held-out tokens that each estimate accounts for. A
    bucket without tokens takes the weights of the next lower one of its order that has some, the lowest ones equal
    weights of what their contexts let estimate.
    """
    known = 1 + np.where(np.arange(buckets) > 0, 1 + (np.arange(buckets) - 1) // BUCKETS, 0)
    weights = (np.arange(orders + 1) <= known[:, None]) / (1.0 + known[:, None])
    for _ in range(ROUNDS):
        expected = totals(weights)
        mass = expected.sum(1, keepdims=True)
        after = np.where(mass > 0, expected / np.maximum(mass, 1e-300), weights)
        moved = np.abs(after - weights)[mass[:, 0] > 0].max(initial=0)
        weights = after
        if moved < SETTLED:
            break
    seen = mass[:, 0] > 0
    for b in range(1, buckets):
        # Order by order: the buckets of one order follow each other.
        if not seen[b] and (b - 1) % BUCKETS and seen[b - 1]:
            weights[b], seen[b] = weights[b - 1], True
    # Every token keeps some probability.
    weights[:, 0] = np.maximum(weights[:, 0], 1e-9)
    return weights / weights.sum(1, keepdims=True)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_ASSEMBLED = "kind int, block string, told binary, " + _BLOCK.split(", ", 1)[1] + ", bucket int, cells binary, counts binary"


def interpolated_scores(docs: DataFrame, out: str = "out", order: int = ORDER) -> DataFrame:
    """Per row of ``docs(doc_id, text, out)``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose ``out`` is true are only scored, those with false or null are learned from as well. ``base_score`` is
    the add-one unigram score, ``score`` that of the interpolated model of ``order``, both in base 10 with the full
    counts. A null or empty text is one end token. Repeated rows and null ids are rows like others. Without a row to
    learn from all counts are 0 and both scores uniform; no rows give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(out), F.lit(False)).cast("long").alias("out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(F.col("out") == 0).alias("texts")).first()
    parts, texts = max(6, -(-size["bytes"] // PART_BYTES)), size["texts"]
    blocks = stored(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    told = blocks.mapInArrow(_ask(order, parts), _ASKED).groupBy("k", "part").applyInArrow(lambda g: _tell(g), _TOLD)
    told = stored(told, "counts")
    sizes = {r["k"]: (r["n"], r["v"]) for r in told.where("block is null").groupBy("k").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).collect()}
    n, v = sizes.get(0, (0, 0))
    buckets = 1 + (order - 1) * BUCKETS

    def with_counts(row: dict, answers: pa.Table) -> tuple[Counts, list[np.ndarray]]:
        block = Block(row, order)
        found = [np.zeros(len(g), np.int64) for g in block.grams]
        for k, first, counts in zip(*(answers.column(c).to_pylist() for c in ("k", "first", "counts")), strict=True):
            part = unpack(counts).astype(np.int64)
            found[k][first : first + len(part)] = part
        return Counts(block, found, n, texts), found

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The blocks of a name with the answers to them, and the held-out estimates of one of them on the grid."""
        out_rows = []
        for row in left.to_pylist():  # equal blocks have one name and one answer
            answers = right.select(["k", "first", "counts"])
            counts, found = with_counts(row, _once(answers))
            ml, bucket = estimates(*counts.without_own())
            cells = _cells(ml)
            # Bucket and cells as one number: a grid has fewer than 512 cells, since no count reaches 2 to the 63.
            key = bucket
            for column in cells.T:
                key = key << 9 | column
            key, count = np.unique(key, return_counts=True)
            place = np.stack([key >> 9 * k & 511 if k < order else key >> 9 * k for k in range(order, -1, -1)], 1)
            packed = b"".join(len(p := pack(f)).to_bytes(8, "little") + p for f in found)
            out_rows.append((0, row["block"], packed, *(row[c] for c in ("rows", "doc_id", "none", "out", "sizes", "words", "at")), None, None, None))
            for b in np.unique(place[:, 0]).tolist():
                here = place[:, 0] == b
                out_rows.append((1, None, None, None, None, None, None, None, None, None, b, np.ascontiguousarray(place[here, 1:], np.int32).tobytes(), count[here].astype(np.int64).tobytes()))
        types = [pa.int32(), pa.string(), pa.binary(), pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in _ASSEMBLED.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in out_rows], t) for i, t in enumerate(types)], names=names)

    joined = blocks.groupBy("block").cogroup(told.where("block is not null").groupBy("block")).applyInArrow(assemble, _ASSEMBLED)
    assembled = stored(joined, "assembled", "kind")
    events = assembled.where("kind = 1").select("bucket", "cells", "counts")
    uniform = 1.0 / (v + 1)

    def totals(weights: np.ndarray) -> np.ndarray:
        def expected(batches):
            total = np.zeros((buckets, order + 1))
            for batch in batches:
                for b, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "cells", "counts")), strict=True):
                    ml = centres(np.frombuffer(cells, np.int32).reshape(-1, order))
                    each = np.column_stack([np.full(len(ml), uniform), ml]) * weights[b]
                    total[b] += (each * (np.frombuffer(counts, np.int64) / each.sum(1))[:, None]).sum(0)
            return total

        return sums.dense_total(events, expected, (buckets, order + 1))

    weights = learn_weights(totals, buckets, order) if n else np.tile(np.eye(order + 1)[0], (buckets, 1))

    def score(batches):
        for batch in batches:
            for row in _rows(batch):
                block, found, data = Block(row, order), [], row["told"]
                while data:
                    size = int.from_bytes(data[:8], "little")
                    found.append(unpack(data[8 : 8 + size]).astype(np.int64))
                    data = data[8 + size :]
                counts = Counts(block, found, n, texts)
                ml, bucket = estimates(counts.gram, counts.context)
                p = weights[bucket, 0] * uniform + (weights[bucket, 1:] * ml).sum(1)
                base = np.log10((counts.gram[0] + 1) / (n + v + 1))
                add = lambda x: np.add.reduceat(x, block.starts) if len(block.starts) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids, pa.int64(), mask=block.null), pa.array(block.out), pa.array(block.sizes, pa.int64()),
                    pa.array(add((counts.gram[0] > 0).astype(np.int64)), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    names = [f.split()[0] for f in _BLOCK.split(", ")]
    scored = assembled.where("kind = 0").select(*names, "told").mapInArrow(score, _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _once(answers: pa.Table) -> pa.Table:
    """Equal blocks ask the same and are told the same: one answer of each is enough."""
    return answers.group_by(["k", "first"]).aggregate([("counts", "min")]).rename_columns(["k", "first", "counts"])


@query("op13_interpolated_scores")
def op13_interpolated_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("out"))
    return interpolated_scores(docs)
