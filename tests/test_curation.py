"""Balance rule per case, sampling properties, vocabulary order."""

from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from curascore.operators import curation as C
from curascore.operators import labels as L
from curascore.operators import lookup
from curascore.operators import positions as P
from curascore.operators.lookup import Dimension
from curascore.plans.curate import curate
from curascore.settings import SPLIT_TARGETS, class_pairs

CASES = [  # (lab, field) rows in the train split -> case, lab kept, field kept
    ((360, 0), "1A", 360, 0), ((0, 0 + 5), "1A", 0, 5), ((361, 0), "1B", 361, 0), ((0, 389), "1B", 0, 389),
    ((390, 0), "1C", 370, 0), ((0, 5000), "1C", 0, 370), ((184, 185), "2LA", 184, 185), ((184, 186), "2LB", 184, 186),
    ((10, 4000), "2LB", 10, 360), ((185, 184), "2FA", 185, 184), ((186, 184), "2FB", 186, 184), ((4000, 1), "2FB", 369, 1),
    ((185, 185), "4", 185, 185), ((9000, 9000), "4", 185, 185), ((100, 100), "2LA", 100, 100),
]


def test_balance_rule(spark):
    rows = [("train", f"c{i}", "d", lab + field, lab, field) for i, ((lab, field), *_rest) in enumerate(CASES)]
    counts = spark.createDataFrame(rows, "split string, crop string, disease string, n_total long, n_lab long, n_field long")
    got = {r.crop: (r.balance_case, r.quota_lab, r.quota_field) for r in C.balance_case(counts).collect()}
    assert got == {f"c{i}": tuple(case[1:]) for i, case in enumerate(CASES)}
    flagged = C.flagged_groups(C.balance_case(counts)).collect()
    assert {(r.crop, r.source, r.reason) for r in flagged} == {("c0", "lab", "CASE 1"), ("c1", "field", "CASE 1")}


def sample_frame(spark, partitions=4):
    """One class holds over half of the rows."""
    rows = []
    for crop, lab, field in [("Hot", 3000, 2500), ("Low", 40, 900), ("One", 0, 700), ("Few", 30, 20)]:
        for source, n in (("lab", lab), ("field", field)):
            rows += [(len(rows) + i, crop, "rust", source, "train") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, crop string, disease string, source string, split string").repartition(partitions)


def brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault((r.crop, r.source), []).append((md5(f"42:{r.sample_id}".encode()).hexdigest(), r.sample_id))
    return {i for g in groups.values() for _, i in sorted(g)[:n]}


@pytest.mark.parametrize("partitions", [1, 7])
def test_sampling_is_exact_and_ignores_partitions(spark, partitions):
    df = sample_frame(spark, partitions)
    got = {r.sample_id for r in C.sample_n(df, 25, ["crop", "source"]).collect()}
    assert got == brute(df.collect(), 25)


def test_downsample_keeps_quotas(spark):
    df = sample_frame(spark)
    kept = C.balanced_downsample(df).collect()
    count = Counter((r.crop, r.source) for r in kept)
    assert count == {("Hot", "lab"): 185, ("Hot", "field"): 185, ("Low", "lab"): 40, ("Low", "field"): 330,
                     ("One", "field"): 370, ("Few", "lab"): 30, ("Few", "field"): 20}
    assert {r.sample_id for r in kept} == {r.sample_id for r in C.balanced_downsample(sample_frame(spark, 9)).collect()}
    labelled = curate(df).groupBy("crop_disease_label").agg(F.max("numeric_label").alias("id")).orderBy("id").collect()
    assert [r.crop_disease_label for r in labelled] == ["few_rust", "hot_rust", "low_rust", "one_rust"]


def test_short_groups_are_ranked_in_full(spark, monkeypatch):
    df = sample_frame(spark)
    want = brute(df.collect(), 25), {r.sample_id for r in C.balanced_downsample(df).collect()}
    # A margin far too low leaves most groups short of their quota.
    monkeypatch.setattr(C, "MARGIN_SIGMAS", -2)
    monkeypatch.setattr(C, "MARGIN_ROWS", -5)
    assert ({r.sample_id for r in C.sample_n(df, 25, ["crop", "source"]).collect()},
            {r.sample_id for r in C.balanced_downsample(df).collect()}) == want


def test_many_groups_are_ranked_by_salted_rounds(spark, monkeypatch):
    df = sample_frame(spark)
    want = brute(df.collect(), 25), {r.sample_id for r in C.balanced_downsample(df).collect()}
    monkeypatch.setattr(lookup.bounded, "__defaults__", (2, 1 << 20))
    assert ({r.sample_id for r in C.sample_n(df, 25, ["crop", "source"]).collect()},
            {r.sample_id for r in C.balanced_downsample(df).collect()}) == want


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "sample_id long, crop string")
    assert Counter(r.crop for r in C.sample_n(df, 7, ["crop"]).collect()) == {None: 7, "a": 7}


def test_positions_and_blocks(spark):
    df = sample_frame(spark).withColumn("crop_disease_label", L.compose_label())
    placed = P.positions(df, ["split", "crop_disease_label", "sample_id"])
    rows = placed.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [(r.crop_disease_label, r.sample_id) for r in rows] == sorted((r.crop_disease_label, r.sample_id) for r in rows)
    index = P.build_block_index(placed)
    assert all(r.is_contiguous for r in index.collect())
    blocks = index.select("split", F.col("crop").alias("block"), "start_pos", "end_pos")
    tagged = P.assign_blocks(placed, blocks)
    assert tagged.where("block <> crop").count() == 0 and tagged.count() == len(rows)
    for width, index_of in ((64, blocks), (10**9, blocks), (777, Dimension(blocks, None))):
        again = P.assign_blocks(placed, index_of, width=width)
        assert again.where("block <> crop").count() == 0 and again.count() == len(rows)
    # ends taken as exclusive although they name the last row: each block loses one
    lossy = P.build_block_index(placed, end_inclusive=True).select("split", F.col("crop").alias("block"), "start_pos", "end_pos")
    assert P.assign_blocks(placed, lossy).count() == len(rows) - 4
    assert [r.batch for r in P.assign_batches(placed, 32).orderBy("pos").limit(65).collect()] == [0] * 32 + [1] * 32 + [2]


def test_shuffle_orders_by_seed(spark):
    df = sample_frame(spark).select("sample_id")
    got = [r.sample_id for r in C.seeded_shuffle(df, 3407).orderBy("pos").collect()]
    want = sorted((r.sample_id for r in df.collect()), key=lambda i: (md5(f"3407:{i}".encode()).hexdigest(), i))
    assert got == want
    assert [r.sample_id for r in C.first_n(df, 10, 3407).orderBy("pos").collect()] == want[:10]


def test_majority_tie_goes_to_first_label(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",)], "crop_disease_label string")
    assert C.majority_class(df).first().label == "a"


def test_per_split_ids_shift(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "b")], "split string, crop_disease_label string")
    ids = {(r.split, r.label): r.class_id for r in L.dense_label_ids(df, per_split=True).collect()}
    assert ids == {("train", "a"): 0, ("train", "b"): 1, ("test", "b"): 0}
    assert {r.label: r.class_id for r in L.dense_label_ids(df).collect()} == {"a": 0, "b": 1}


def test_fixed_class_list():
    pairs = class_pairs()
    assert len(pairs) == len(set(pairs)) == 65
    assert len({c for c, _ in pairs}) == 16 and len({d for _, d in pairs}) == 41
    assert SPLIT_TARGETS == {"train": 370, "test": 46, "validation": 46}
    listed = [f"{c.lower()}_{d}" for c, d in pairs]
    # Ids that decode to another label through the unsorted list than through the sorted one.
    assert [i for i, (a, b) in enumerate(zip(listed, sorted(listed), strict=True)) if a != b] == [11, 12, 15, 16, 29, 31, 56, 58]
