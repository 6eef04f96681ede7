"""Each size check has another way behind it: forced here on small data, it must give the same rows."""

import pytest
from pyspark.sql import functions as F

from curascore.operators import choices as CH
from curascore.operators import labels as L
from curascore.operators import lookup, scoring
from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.plans import views as V
from tests.conftest import SF


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def large(dim: Dimension) -> Dimension:
    return Dimension(dim.frame, None)


@pytest.fixture(scope="module")
def classes(spark):
    return V.classes(spark, SF)


def test_bound_is_checked(spark):
    assert bounded(spark.range(10), max_rows=10).is_small
    assert not bounded(spark.range(11), max_rows=10).is_small
    assert not bounded(spark.range(1000), max_bytes=100).is_small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    df = spark.createDataFrame([(i, 0 if i % 3 == 0 else i % 50, {"k": i}) for i in range(600)], "id long, key long, m map<string,int>")
    dim = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    small, big = bounded(dim), Dimension(dim, None)
    assert rows_of(lookup_join(df, small, "key", how).drop("m")) == rows_of(lookup_join(df, big, "key", how).drop("m"))
    plan = lookup_join(df, big, "key", how)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_labels_and_choices(spark, classes):
    rows = V.samples(spark, SF)
    assert rows_of(L.encode_labels(rows, large(classes))) == rows_of(L.encode_labels(rows, classes))
    pick = lambda df: rows_of(df.select("sample_id", *[F.col("options")[k].alias(k) for k in "ABCD"]))
    assert pick(CH.build_choices(rows, large(classes))) == pick(CH.build_choices(rows, classes))


def test_choices_hold_the_true_label_and_three_others(spark, classes):
    rows = CH.build_choices(V.samples(spark, SF), classes).select("crop_disease_label", F.map_values("options").alias("o")).collect()
    assert all(len(set(r.o)) == 4 and r.crop_disease_label in r.o for r in rows)
    slots = {r.o.index(r.crop_disease_label) for r in rows}
    assert slots == {0, 1, 2, 3}


def test_context_match_by_join(spark, classes):
    outs = V.outputs(spark, SF)
    extra = outs.withColumn("output", F.concat("output", F.lit(" or plant b_high plant d_healthy"))).withColumn("sample_id", F.col("sample_id") + 10**6)
    both = outs.unionByName(extra)
    slim = lambda df: rows_of(df.select("sample_id", "label"))
    assert slim(CH.context_match(both, large(classes))) == slim(CH.context_match(both, classes))


def test_class_blocks_of_bounded_size(spark, monkeypatch):
    rows = V.features(spark, SF)
    protos = scoring.class_prototypes(rows)
    head = scoring.prototypes_as_head(protos)
    want = rows_of(scoring.nearest_prototype(rows, protos).select("sample_id", "y_pred", "score"))
    long = rows_of(scoring.score_pairs(rows, protos).select("sample_id", "class_id", F.round("score", 6)))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 8 * 64 * 3)
    assert rows_of(scoring.nearest_prototype(rows, protos).select("sample_id", "y_pred", "score")) == want
    assert rows_of(scoring.score_pairs(rows, protos).select("sample_id", "class_id", F.round("score", 6))) == long
    logits = scoring.with_logits(rows, head, unit=True).select("sample_id", F.posexplode("logits").alias("class_id", "s"))
    assert rows_of(logits.select("sample_id", "class_id", F.round("s", 6))) == long


def test_vocabulary_beyond_the_bound(spark, monkeypatch):
    rows = V.samples(spark, SF)
    want = rows_of(L.dense_label_ids(rows)), rows_of(L.class_table(rows, F.md5("label")))
    monkeypatch.setattr(lookup.bounded, "__defaults__", (3, 1 << 20))
    got = rows_of(L.dense_label_ids(rows)), rows_of(L.class_table(rows, F.md5("label")))
    assert got == want
