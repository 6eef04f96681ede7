"""Deleted interpolation against dictionaries of tuples, and the packing of integers."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from curascore.llm import interpolation
from curascore.llm.base import table
from curascore.llm.interpolation import interpolated_scores
from curascore.llm.packing import pack, unpack
from curascore.llm.queries import REGISTRY
from tests.conftest import SF
from tests.llm.conftest import ODD

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def grams_of(tokens, k):
    """The (k + 1)-gram that ends at each token; starts are padded."""
    padded = ["<s>"] * k + tokens
    return [(k, *padded[i : i + k + 1]) for i in range(len(tokens))]


def brute(rows, order):
    """``rows`` of (id, text, held out) scored by plain dictionaries, with the same grid and stopping rule."""
    streams = [(i, tokens_of(t), bool(o)) for i, t, o in rows]
    counts, texts = Counter(), sum(not o for *_, o in streams)
    for _, tokens, out in streams:
        if not out:
            for k in range(order):
                counts.update(grams_of(tokens, k))
    n = sum(c for g, c in counts.items() if g[0] == 0)
    v = sum(1 for g in counts if g[0] == 0)

    def met(tokens, own):
        """Per token the estimates and the bucket, with ``own`` counts taken off."""
        of = lambda g: counts[g] - own[g]
        size = n - (len(tokens) if own else 0)
        start = texts - (1 if own else 0)
        by = [grams_of(tokens, k) for k in range(order)]
        for i in range(len(tokens)):
            ml, bucket = [], 0
            for k in range(order):
                context = size if k == 0 else start if i == 0 else of(by[k - 1][i - 1])
                ml.append(of(by[k][i]) / context if context > 0 else 0.0)
                if k and context > 0:
                    bucket = 1 + (k - 1) * interpolation.BUCKETS + int(math.log2(context))
            yield ml, bucket

    events = Counter()
    for _, tokens, out in streams:
        if not out:
            own = Counter(g for k in range(order) for g in grams_of(tokens, k))
            for ml, bucket in met(tokens, own):
                events[bucket, tuple(2 ** -(round(-math.log2(x) * interpolation.GRID) / interpolation.GRID) if x else 0.0 for x in ml)] += 1
    weights = {}
    for b in range(1 + (order - 1) * interpolation.BUCKETS):
        known = 2 if b == 0 else 3 + (b - 1) // interpolation.BUCKETS
        weights[b] = [1 / known] * known + [0.0] * (order + 1 - known)
    for _ in range(interpolation.ROUNDS):
        total = defaultdict(lambda: [0.0] * (order + 1))
        for (b, ml), c in events.items():
            each = [w * p for w, p in zip(weights[b], [1 / (v + 1), *ml], strict=True)]
            for j, e in enumerate(each):
                total[b][j] += c * e / sum(each)
        moved = 0.0
        for b, t in total.items():
            after = [x / sum(t) for x in t]
            moved = max(moved, *(abs(x - y) for x, y in zip(after, weights[b], strict=True)))
            weights[b] = after
        if moved < interpolation.SETTLED:
            break
    seen = {b for b, _ in events}
    for b in range(1, 1 + (order - 1) * interpolation.BUCKETS):
        if b not in seen and (b - 1) % interpolation.BUCKETS and b - 1 in seen:
            weights[b] = weights[b - 1]
            seen.add(b)
    for i, tokens, out in streams:
        score = base = 0.0
        for ml, b in met(tokens, Counter()):
            w = [max(weights[b][0], 1e-9), *weights[b][1:]]
            score += math.log10(sum(x * p for x, p in zip(w, [1 / (v + 1), *ml], strict=True)) / sum(w))
        known = 0
        for t in tokens:
            base += math.log10((counts[0, t] + 1) / (n + v + 1))
            known += counts[0, t] > 0
        yield i, out, len(tokens), known, n, base, score


def same(found, want):
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 4))
    found, want = sorted(map(tuple, found), key=order), sorted(want, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for f, w in zip(found, want, strict=True):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def sentences(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Go", "GO", "naïve", "日本"]
    return [(i if rng.random() < 0.95 else None, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 3, 20, 200]))),
             rng.random() < 0.2 or None) for i in range(n)]


@pytest.mark.parametrize("order, block", [(1, 1_000_000), (2, 500), (3, 500), (3, 1_000_000)])
def test_equals_dictionaries(spark, monkeypatch, order, block):
    monkeypatch.setattr(interpolation, "BLOCK_TOKENS", block)
    monkeypatch.setattr(interpolation, "PART_BYTES", 4_000)
    rows = sentences(order, 150)
    rows += rows[:40] + [(500 + i, rows[0][1], False) for i in range(60)]  # repeated rows, and many copies of a text
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, out boolean, block string, k int, counts int")
    got = interpolated_scores(docs, order=order)
    assert got.columns == COLUMNS
    same(got.collect(), brute(rows, order))


def test_odd_rows(spark, make):
    from pyspark.sql import functions as F

    docs = make(ODD).withColumn("out", F.col("doc_id") == 4)
    rows = [(i, t, i == 4) for i, t, *_ in ODD]
    same(interpolated_scores(docs, order=3).collect(), brute(rows, 3))
    assert interpolated_scores(make([]).withColumn("out", F.lit(False))).collect() == []
    # Nothing to learn from: every token has the one uniform probability.
    held = interpolated_scores(make(ODD[:4]).withColumn("out", F.lit(True))).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in held} == {(0, 0, 0.0, 0.0)}


def test_query(spark):
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in table(spark, SF, "documents").collect()]
    got = REGISTRY["op13_interpolated_scores"].run(spark, SF)
    assert got.columns == COLUMNS
    rows = got.collect()
    same(rows, brute(docs, interpolation.ORDER))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for v in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), np.array([2**64 - 1, 0, 7], np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64)):
        assert (unpack(pack(v)) == v).all() and (unpack(pack(np.sort(v), True), True) == np.sort(v)).all()
