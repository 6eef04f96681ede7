"""Class tables past the bound stream past chunks of samples: same rows as numpy, whatever the blocks and chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curascore.operators import class_stream, scoring
from curascore.operators.lookup import Dimension


@pytest.fixture
def tiny(monkeypatch):
    """Blocks of two classes, chunks of seven samples; nothing is small enough to be shipped."""
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1)
    monkeypatch.setattr(class_stream, "BLOCK_BYTES", 2 * 8 * 8)
    monkeypatch.setattr(class_stream, "CHUNK_ROWS", 7)


def samples(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 8)), 1)
    rows = [(i, x[i].tolist(), f"text {i}", "a") for i in range(n)] + [(900, None, None, None), (901, None, "n", "b")]
    # A third of all rows are one row.
    rows += [(7, x[7].tolist(), "same", "c")] * 30
    return x, rows, spark.createDataFrame(rows, "sample_id long, features array<double>, _chunk string, _c0 string")


def table(spark, n=100, seed=1):
    """Classes whose ids have gaps and come in no order; some are equal, so that ties occur."""
    rng = np.random.default_rng(seed)
    w = np.round(rng.normal(size=(n, 8)), 1)
    w[n // 2 :] = w[: n - n // 2]
    ids = rng.permutation(n) * 37 + 5
    return ids, w, spark.createDataFrame([(int(i), v.tolist(), float(b)) for i, v, b in zip(ids, w, (ids % 3) * 0.0, strict=True)], "class_id int, weights array<double>, bias double")


def test_fifty_blocks_equal_numpy(spark, tiny):
    x, rows, df = samples(spark)
    ids, w, head = table(spark)
    assert class_stream.packed_classes(head, "weights", "bias").count() >= 50
    found = scoring.predict_linear(df, head)
    assert found.columns == [*df.columns, "score", "y_pred"]
    scores = np.round(x @ w.T, 6)
    got = sorted(map(tuple, found.select("sample_id", "_chunk", "score", "y_pred").collect()), key=repr)
    want = []
    for i, v, text, _ in rows:
        if v is None:
            want.append((i, text, None, None))
            continue
        s = scores[i]
        want.append((i, text, s.max(), int(ids[s == s.max()].min())))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want, key=repr)]
    assert [c for _, _, c, _ in got] == pytest.approx([c for _, _, c, _ in sorted(want, key=repr)])


def test_arrays_pairs_and_argmax(spark, tiny):
    x, rows, df = samples(spark)
    ids, w, head = table(spark)
    arrays = scoring.score_arrays(df, head)
    one = arrays.where("sample_id = 3").collect()
    assert len(one) >= 50 and sum(len(r["class_ids"]) for r in one) == 100
    pairs = {(r["class_id"]): r["score"] for r in scoring.linear_scores(df, head).where("sample_id = 3").collect()}
    assert pairs == pytest.approx({int(i): float(s) for i, s in zip(ids, x[3] @ w.T, strict=True)})
    best = {r["sample_id"]: r["y_pred"] for r in scoring.argmax(arrays).collect()}
    long = {r["sample_id"]: r["y_pred"] for r in scoring.argmax(scoring.linear_scores(df, head)).collect()}
    shipped = {r["sample_id"]: r["y_pred"] for r in scoring.predict_linear(df, head).where("y_pred is not null").collect()}
    assert best == long == shipped


def test_logits_past_the_bound(spark, tiny):
    x, _, df = samples(spark)
    _, w, _ = table(spark)
    head = spark.createDataFrame([(i, v.tolist(), 0.5) for i, v in enumerate(w)], "class_id int, weights array<double>, bias double")
    got = {r["sample_id"]: r["logits"] for r in scoring.with_logits(df, head).collect()}
    assert got[11] == pytest.approx((x[11] @ w.T + 0.5).tolist()) and got[900] is None
    with pytest.raises(Exception, match="class ids must be"):
        scoring.with_logits(df, table(spark)[2]).collect()


def test_plan_does_not_grow_with_the_classes(spark, tiny):
    _, _, df = samples(spark)
    plans = []
    for n in (10, 100):
        found = scoring.nearest_prototype(df, table(spark, n)[2].withColumnRenamed("weights", "prototype"))
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]


def test_bad_tables(spark, tiny):
    _, _, df = samples(spark)
    head = table(spark)[2]
    with pytest.raises(ValueError, match="no classes"):
        scoring.predict_linear(df, Dimension(head.limit(0), None))
    with pytest.raises(Exception, match="without an id or a vector"):
        scoring.predict_linear(df, head.withColumn("class_id", F.when(F.col("class_id") > 10, F.col("class_id")))).collect()
    with pytest.raises(Exception, match="feature width"):
        scoring.predict_linear(df.withColumn("features", F.slice("features", 1, 3)), head).collect()
    assert scoring.predict_linear(df.limit(0), head).collect() == []
