"""Positions, selections by rank and positions within segments against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from curascore.operators import labels as L
from curascore.operators import lookup
from curascore.operators import positions as P

SCHEMA = "id long, a string, b double, payload string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([0.5, 1.5, None, -2.0]), f"p{i}" * 5) for i in range(3000)]
    rng.shuffle(made)
    return made


def key(r):
    low = lambda v: (v is not None, v if v is not None else 0)
    return (r[1] is not None, r[1] or ""), low(r[2]), r[0]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


ORDER = ["a", "b", "id"]


def test_late_payload_equals_sorting(spark, frame, rows):
    want = [(*r, i) for i, r in enumerate(sorted(rows, key=key))]
    late = P.positions(frame, ORDER, row_id="id")
    assert late.columns == [*frame.columns, "pos"]
    assert sorted(map(tuple, late.collect()), key=lambda r: r[-1]) == want
    assert sorted(map(tuple, P.positions(frame, ORDER).collect()), key=lambda r: r[-1]) == want
    # Only keys are in what was sorted; the payload is neither sorted nor read back.
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" in plan and all("payload" not in line for line in plan.splitlines() if "parquet" in line or "Sort" in line)


@pytest.mark.parametrize("start, end", [(0, 1), (1324, 1370), (2999, 3000), (2990, 4000), (0, 3000), (5000, 5001), (700, 2300), (10, 10)])
@pytest.mark.parametrize("limit", [50_000, 20])
def test_rank_range(spark, frame, rows, monkeypatch, start, end, limit):
    monkeypatch.setattr(P, "SORT_ROWS", limit)
    monkeypatch.setattr(P, "SAMPLE_KEYS", 200)
    want = [(*r, i) for i, r in enumerate(sorted(rows, key=key))][start:end]
    got = P.rank_range(frame, ORDER, start, end)
    assert got.columns == [*frame.columns, "pos"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == want


def test_rank_range_sorts_one_range_only(spark, frame):
    plan = P.rank_range(frame, ORDER, 1500, 1503)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan or "LogicalRDD" in plan  # what is left was proven small
    assert P.rank_range(frame.limit(0), ORDER, 0, 5).count() == 0 and P.rank_range(frame.limit(1), ORDER, 0, 5).count() == 1


def test_segmented_positions(spark, frame, rows):
    want = []
    for segment in ("x", "y", None):
        want += [(*r, i) for i, r in enumerate(sorted((r for r in rows if r[1] == segment), key=key))]
    got = P.segmented_positions(frame, ["a"], ["b", "id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ids_per_split_beyond_the_bound(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") % 3).cast("string").alias("split"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("crop_disease_label"))
    want = sorted(map(tuple, L.dense_label_ids(df, per_split=True).collect()))
    monkeypatch.setattr(lookup.bounded, "__defaults__", (3, 1 << 20))
    assert sorted(map(tuple, L.dense_label_ids(df, per_split=True).collect())) == want
