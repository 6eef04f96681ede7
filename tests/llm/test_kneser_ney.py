"""The class-conditional models against plain Python, and texts that differ in word order only."""

import math
import random
import re
from collections import Counter

import numpy as np

from curascore.llm import toxicity as op
from curascore.llm.toxicity import described, toxicity
from tests.llm.conftest import ODD

START = object()


def plain_log_likelihoods(learn, texts, discount, continued):
    """Natural log-likelihoods of the texts in both models, by the formulas of the module."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    pairs = lambda t: list(zip([START, *words(t)], words(t), strict=False))
    n = [Counter(p for t, y in learn if y == c for p in pairs(t)) for c in (0, 1)]
    contexts = [Counter(w for _, w in n[c]) for c in (0, 1)]
    both = Counter(w for _, w in set(n[0]) | set(n[1]))

    def p(c, v, w):
        s = (both[w] + 1) / (sum(both.values()) + len(both) + 1)
        total = sum(contexts[c].values())
        off = sum(min(k, continued) for k in contexts[c].values())
        q = (max(contexts[c][w] - continued, 0) + off * s) / total if total else s
        own = [k for (a, _), k in n[c].items() if a == v]
        return (max(n[c][v, w] - discount, 0) + sum(min(k, discount) for k in own) * q) / sum(own) if own else q

    return [[sum(math.log(p(c, v, w)) for v, w in pairs(t)) for c in (0, 1)] for t in texts]


def test_likelihoods_equal_plain_model(spark, make, monkeypatch):
    # Several blocks and parts, so that counts of one expression come from many places.
    monkeypatch.setattr(op, "PART_BYTES", 200)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("go home now then A, B; c d").lower() if rng.random() < 0.1 else rng.choice(["go", "home", "Now", "then", "x1", f"r{rng.randrange(60)}"])
                      for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    labels = [(i, int(rng.random() < 0.3)) for i in range(40)]
    docs = make([(i, t, "en", "a") for i, t in enumerate(texts)] + [(70, None, None, None), (None, "go home now", None, None)])
    for discount, continued in ((1, 2), (1, 1), (2, 4)):
        got = described(docs, spark.createDataFrame([*labels, (41, None), (None, 1)], "doc_id long, toxic int"), discount, continued, calibration=0, tokens=40).collect()
        want = dict(enumerate(plain_log_likelihoods([(texts[i], y) for i, y in labels], [*texts, "", "go home now"], discount, continued)))
        assert len(got) == 62 and all(r["toxic"] is None for r in got)
        for r in got:
            at = {70: 60, None: 61}.get(r["doc_id"], r["doc_id"])
            assert np.allclose([r["loglik"][0], r["loglik"][1]], want[at], rtol=1e-9, atol=1e-9)


def test_probabilities_add_up_to_one():
    learn = [("a b a c", 0), ("b a b", 1), ("c c a b", 1)]
    # Over the known words and one for all others, after a known context.
    for c in (0, 1):
        known = [plain_log_likelihoods(learn, [f"a {w}", "a"], 1, 2) for w in "abcz"]
        assert abs(sum(math.exp(x[0][c] - x[1][c]) for x in known) - 1) < 1e-9


def test_word_order(spark, make):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(18)]
    rows = []
    for i in range(2000):
        words = [rng.choice(common) for _ in range(18)]
        toxic = i % 2
        at = rng.randrange(19)
        rows.append((i, " ".join([*words[:at], *(["go", "home"] if toxic else ["home", "go"]), *words[at:]]), toxic))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:1600]], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity(make([(i, t, "en", "a") for i, t, _ in rows]), labels).collect()}
    assert np.mean([(scored[i] >= 0.5) == bool(y) for i, _, y in rows[1600:]]) > 0.95


def test_one_class_and_empty_tables(spark, make):
    labels = spark.createDataFrame([(4, 0), (6, 0)], "doc_id long, toxic int")
    for given, rows in ((labels, ODD), (labels.limit(0), ODD), (labels, []), (labels.selectExpr("doc_id + 100 as doc_id", "toxic"), ODD)):
        got = toxicity(make(rows), given).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
