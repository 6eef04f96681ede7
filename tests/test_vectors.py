"""Vector and token functions against numpy, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curascore.functions import tokens as TK
from curascore.functions import vectors as VE
from curascore.operators import probe as PB
from curascore.operators import scoring as S
from curascore.plans import views as V
from curascore.plans.feature_eval import probe_metrics
from curascore.sources import heads
from tests.conftest import SF


def one(df, column):
    return df.select(column.alias("x")).first().x


def test_normalize_floor(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    assert one(df, VE.l2_normalize("v")) == [0.0, 0.0]
    assert one(df, VE.l2_normalize("v", floor=None)) == [None, None]
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert one(df, VE.l2_normalize("v")) == pytest.approx([0.6, 0.8])


def test_softmax_does_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0], 1)], "v array<double>, y int")
    e = np.exp(np.array([-1.0, 0.0, -2.0]))
    assert one(df, VE.softmax("v")) == pytest.approx(list(e / e.sum()))
    assert one(df, VE.cross_entropy("v", "y")) == pytest.approx(math.log(e.sum()))


def test_scores_with_null_rows_and_wrong_width(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 2.0])], "sample_id long, features array<float>").coalesce(1)
    protos = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "class_id int, prototype array<double>")
    got = S.nearest_prototype(df, protos).orderBy("sample_id").collect()
    assert [(r.y_pred, r.score) for r in got] == [(3, 1.0), (None, None), (1, 1.0)]  # the tie goes to the lowest id
    logits = df.withColumn("l", VE.matrix_scores("features", np.eye(2))).orderBy("sample_id").collect()
    assert [r.l for r in logits] == [[1.0, 0.0], None, [0.0, 2.0]]
    bad = spark.createDataFrame([(0, [1.0])], "sample_id long, features array<float>")
    with pytest.raises(Exception, match="feature width"):
        S.nearest_prototype(bad, protos).collect()


def test_top_k_is_limited_by_the_classes(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0])], "sample_id long, logits array<double>")
    rows = S.top_k(df, 5).collect()
    assert [(r["rank"], r.class_id) for r in rows] == [(1, 1), (2, 2), (3, 0)]


def test_probe_beats_chance_and_head_round_trip(spark, tmp_path):
    rows = V.features(spark, SF)
    model = PB.fit_linear_probe(rows)
    head = PB.head_of(model, rows)
    heads.save_head(head, str(tmp_path / "head"), "table")
    weights, meta = heads.load_head(spark, str(tmp_path / "head"), 10)
    assert meta["num_classes"] == 10 and meta["feature_dim"] == 64 and meta["head_type"] == "linear"
    scored = S.predict_linear(rows, weights, unit=True)
    assert scored.where("y_pred = y_true").count() / rows.count() > 0.3
    assert probe_metrics(rows, weights).where("view = 'main'").first().recall > 0.3
    S.require_dimensions(rows, weights, 10)
    with pytest.raises(ValueError, match="classes"):
        heads.load_head(spark, str(tmp_path / "head"), 11)
    with pytest.raises(ValueError, match="classes"):
        S.require_dimensions(rows, weights, 9)
    with pytest.raises(FileNotFoundError):
        heads.load_head(spark, str(tmp_path / "none"))
    table, best = PB.sweep_probe(rows.where("split = 'train'"), rows.where("split = 'validation'"), [1e-3, 10.0], max_iter=10)
    losses = {r.setting: r for r in table.collect()}
    assert sum(r.is_best for r in losses.values()) == 1
    assert [r for r in losses.values() if r.is_best][0].val_loss == min(r.val_loss for r in losses.values())
    assert best.numClasses == 10


TOKEN_CASES = [
    ([5, 2, 9], [5, 2], [5, 2, 9]), ([1, 5, 2, 5, 2], [5, 2], [-100, 5, 2, 5, 2]), ([1, 5, 5, 2], [5, 2], [-100, -100, 5, 2]),
    ([5], [5, 2], None), ([], [5, 2], None), ([1, 2, 3], [5, 2], None), ([7, 8, 9], [9], [-100, -100, 9]),
]


@pytest.mark.parametrize(("ids", "anchor", "want"), TOKEN_CASES)
def test_mask_before_anchor(spark, ids, anchor, want):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert one(df, TK.mask_before_anchor("ids", anchor)) == want


def test_token_edges(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert one(df, TK.strip_prompt("ids", 5)) == []
    assert one(df, TK.strip_prompt("ids", 1)) == [2, 3]
    assert one(df, TK.truncate_sequence("ids", 2)) == [1, 2]
    assert one(df, TK.pad_to("ids", F.lit(5))) == [0, 0, 1, 2, 3]
    assert one(df, TK.pad_to("ids", F.lit(5), 9, "right")) == [1, 2, 3, 9, 9]
    assert one(df, TK.mask_tokens("ids", [2])) == [1, -100, 3]
