"""Metrics against a plain computation, and their identities."""

import random
from collections import Counter

import pytest

from curascore.operators import baselines as B
from curascore.operators import metrics as M
from curascore.operators.labels import build_label_map, densify_classes


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        true = 0 if rng.random() < 0.4 else rng.randrange(1, 9)  # one hot class
        pred = true if rng.random() < 0.7 else rng.randrange(11)
        source = "lab" if true in (1, 2) or (true == 0 and rng.random() < 0.5) else "field"
        rows.append((i, source, true, None if rng.random() < 0.05 else pred, i % 3))
    return spark.createDataFrame(rows, "sample_id long, source string, y_true int, y_pred int, run_id int").cache()


def plain(rows):
    """{view: (macro precision, recall, f1, classes)} by the definition."""
    out = {}
    for view in ("main", "lab", "field"):
        cells = Counter((r.y_true, r.y_pred) for r in rows if r.y_pred is not None and view in ("main", r.source))
        classes = sorted({c for pair in cells for c in pair})
        p, q, f = [], [], []
        for c in classes:
            tp = cells[(c, c)]
            fn = sum(n for (t, _), n in cells.items() if t == c) - tp
            fp = sum(n for (_, y), n in cells.items() if y == c) - tp
            p.append(tp / (tp + fp) if tp + fp else 0.0)
            q.append(tp / (tp + fn) if tp + fn else 0.0)
            f.append(2 * tp / (2 * tp + fp + fn))
        out[view] = (sum(p) / len(p), sum(q) / len(q), sum(f) / len(f), len(classes))
    return out


def test_macro_matches_definition(preds):
    want = plain(preds.collect())
    got = {r.view: r for r in M.metrics_by_view(preds).collect()}
    for view, (p, q, f, n) in want.items():
        r = got[view]
        assert (r.precision, r.recall, r.f1) == pytest.approx((p, q, f))
        assert r.n_classes == n and r.balanced_accuracy == r.recall
    # Classes that are predicted but never true count with recall 0; classes absent from a view do not count.
    assert want["main"][3] == 11 and want["lab"][3] <= 11


def test_runs_are_kept_apart(preds):
    for run in range(3):
        part = preds.where(f"run_id = {run}")
        one = {r.view: r.f1 for r in M.metrics_by_view(part).collect()}
        many = {r.view: r.f1 for r in M.metrics_by_view(preds, ["run_id"]).where(f"run_id = {run}").collect()}
        assert many == pytest.approx(one)


def test_identities(preds):
    counts = M.confusion_long(preds)
    per = M.per_class_counts(counts).collect()
    known = preds.where("y_pred is not null")
    for view, rows in (("main", known.count()), ("lab", known.where("source = 'lab'").count())):
        part = [r for r in per if r.view == view]
        assert sum(r.support for r in part) == sum(r.predicted for r in part) == rows
    wide = M.confusion_matrix(counts, 11)
    assert wide.count() == 33
    back = M.matrix_to_long(wide.where("view = 'main'").drop("view"), 11)
    want = {(r.y_true, r.y_pred): r.n for r in counts.where("view = 'main'").collect()}
    assert {(r.y_true, r.y_pred): r.n for r in back.collect()} == want
    assert {r.view: r.f1 for r in M.matrix_to_metrics(wide, 11).collect()} == pytest.approx(
        {r.view: r.f1 for r in M.metrics_by_view(preds).collect()})


def test_zero_division(spark):
    df = spark.createDataFrame([("lab", 0, 1)], "source string, y_true int, y_pred int")
    rows = M.per_class_metrics(M.per_class_counts(M.confusion_long(df))).where("view = 'main'").orderBy("class_id").collect()
    assert [(r.precision, r.recall, r.f1) for r in rows] == [(0.0, 0.0, 0.0)] * 2


def test_weighted_counts_equal_rows(preds):
    condensed = preds.groupBy("source", "y_true", "y_pred").count().withColumnRenamed("count", "n")
    a = sorted(map(tuple, M.confusion_long(preds).collect()))
    b = sorted(map(tuple, M.confusion_long(condensed, weight="n").collect()))
    assert a == b


def test_baselines(preds):
    assert {r.y_pred for r in B.predict_majority(preds).select("y_pred").distinct().collect()} == {0}
    drawn = B.predict_random(preds, 7)
    assert {r.y_pred for r in drawn.select("y_pred").distinct().collect()} == set(range(7))
    assert B.evaluate_baseline(preds, "majority", 9).where("success_rate <> 1.0").count() == 0


def test_tally_and_densify(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "label string")
    assert {r.outcome: r.n for r in M.outcome_tally(df, ["a", "b"]).collect()} == {"a": 2, "b": 1, "other": 2, "total": 5}
    counts = spark.createDataFrame([(1, 4)], "class_id int, n long")
    assert [r.n for r in densify_classes(counts, 3).orderBy("class_id").collect()] == [0, 4, 0]


def test_label_map_takes_last_seen(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 4), (3, "b", 0)], "pos long, crop_disease_label string, class_id int")
    assert {r.label: r.class_id for r in build_label_map(df, "pos").collect()} == {"a": 4, "b": 0, "false_parse": 65}
