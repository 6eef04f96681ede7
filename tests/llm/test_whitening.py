"""Whitening against a dense eigendecomposition, and the solver on operators that are hard for it."""

import math

import numpy as np
import pytest

from curascore.llm import whitening
from curascore.llm.base import table
from curascore.llm.whitening import jacobi_davidson, whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, component string, whitened long, x int"


def brute(rows, k=16):
    """Rows ``{(vec_id, component): (n, deviation, |whitened|, explained)}`` from a dense eigendecomposition."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fine], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(0)
    z = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > len(e) * 1e-14 * max(e.sum(), 1e-300)).sum()))
    w = np.abs(((n * x - s) / n).astype(float) @ u[:, :k] / np.sqrt(e[:k]))
    deviation = ((n * x - s) ** 2).sum(1)
    return {(i, c + 1): (n, int(deviation[r]), w[r, c], e[c] / e.sum()) for r, (i, _) in enumerate(fine) for c in range(k)}


def same(found, rows, loose=1e-7):
    want = brute(rows)
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert set(got) == set(want) and len(found) == len([1 for i, v in rows if (i, 1) in want]) * max((c for _, c in want), default=0)
    for key, (n, deviation, w, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(w, abs=loose) and r["explained"] == pytest.approx(explained, rel=1e-10)
        assert r["identity_error"] < 1e-10


def test_query_equals_dense(spark):
    vectors = table(spark, SF, "embeddings").collect()
    from curascore.llm.queries import REGISTRY

    out = REGISTRY["op12_embedding_whitening"].run(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(out.collect(), [(r["vec_id"], r["embedding"]) for r in vectors])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # copies count once in the fit
    rows += [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] * 6)]
    build = lambda r: spark.createDataFrame([(*x, "clash", 5, 6) for x in r], SCHEMA)
    same(whiten(build(rows)).collect(), rows)
    # Fewer vectors than components, equal vectors, none, and repeated ids.
    same(whiten(build(rows[:3])).collect(), rows[:3])
    assert whiten(build([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(build([])).columns == whiten(build(rows)).columns and whiten(build(rows[-5:])).count() == 0
    twice = whiten(build([(7, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 3.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in twice) == [(0, 1), (7, 1), (7, 1)]
    with pytest.raises(ValueError, match="different lengths"):
        whiten(build([(1, [1.0]), (2, [1.0, 2.0])]))
    again = [sorted(map(tuple, whiten(build(rows)).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_many_tasks_add_up_alike(spark, monkeypatch):
    vectors = table(spark, SF, "embeddings")
    plain = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(vectors).collect()}
    monkeypatch.setattr(whitening, "TASKS_AT_ONCE", 1)
    monkeypatch.setattr(whitening, "BLOCK_VALUES", 256)
    grouped = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(vectors).collect()}
    assert set(plain) == set(grouped) and max(abs(plain[k] - grouped[k]) for k in plain) < 1e-6


@pytest.mark.parametrize("n, d, decay", [(3000, 64, 1.0), (3000, 64, 0.8), (2000, 300, 1.0), (20, 64, 1.0), (500, 1, 1.0), (500, 7, 0.1)])
def test_solver_reaches_double_precision(n, d, decay):
    z = np.random.default_rng(d).normal(size=(n, d)) * decay ** np.arange(d)
    z -= z.mean(0)
    v, seen = z.T @ z / n, []

    def product(columns):
        seen.append(columns.shape[1])
        return v @ columns

    e, u = jacobi_davidson(product, d, 16, np.trace(v))
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.linalg.norm(v @ u - u * e, axis=0).max() <= 16 * np.finfo(float).eps * np.sqrt(d) * want[0] * 64
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and len(seen) < 120
