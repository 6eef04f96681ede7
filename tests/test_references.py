"""Lists by reference past the bound, heads by gradient descent, and the dense grid of classes and runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curascore.operators import choices as CH
from curascore.operators import labels as L
from curascore.operators import metrics as M
from curascore.operators import probe as PB
from curascore.operators.lookup import Dimension, bounded


def vocabulary(spark, n):
    return spark.range(n).select(F.concat(F.lit("it's label "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"), F.col("id").cast("int").alias("class_id"),
                                 F.col("id").alias("list_pos"))


def rows(spark):
    return spark.createDataFrame([(1, "it's label 000007"), (2, "it's label 002000"), (3, "unknown"), (4, None), (5, "it's label 000007")], "sample_id long, crop_disease_label string")


def test_complement_by_reference_past_the_bound(spark):
    big = bounded(vocabulary(spark, 60_000))
    assert not big.is_small
    refs, blocks = L.distractor_references(rows(spark), big)
    assert {f.dataType.simpleString() for f in refs.schema.fields} == {"bigint", "string"}  # no list in the rows
    assert {r["sample_id"]: r["left_out"] for r in refs.collect()} == {1: 7, 2: 2000, 3: None, 4: None, 5: 7}
    out = L.distractors(refs, blocks)
    sizes = {r["sample_id"]: r["n"] for r in out.groupBy("sample_id").agg(F.sum(F.size("candidates")).alias("n")).collect()}
    assert sizes == {1: 59_999, 2: 59_999, 3: 60_000, 4: 60_000, 5: 59_999}
    assert out.where("sample_id = 1").where(F.array_contains("candidates", "it's label 000007")).count() == 0


def test_both_forms_of_the_complement_are_equal(spark):
    small = bounded(vocabulary(spark, 2_500))
    names = L.label_list(small)
    want = {r["sample_id"]: r["candidates"] for r in L.distractor_candidates(rows(spark), names).collect()}
    for table in (small, Dimension(small.frame, None)):
        refs, blocks = L.distractor_references(rows(spark), table)
        got = {}
        for r in sorted(L.distractors(refs, blocks).collect(), key=lambda r: r["first"]):
            got.setdefault(r["sample_id"], []).extend(r["candidates"])
        assert got[1] == want[1] and got[2] == want[2] and got[3] == names
    # The id follows the list, not the table; an empty list offers nothing.
    ids = {L.listed(t).first()["list_id"] for t in (small, Dimension(small.frame.repartition(3), None))}
    assert len(ids) == 1 and L.listed(bounded(vocabulary(spark, 2_499))).first()["list_id"] not in ids
    refs, blocks = L.distractor_references(rows(spark), bounded(vocabulary(spark, 0)))
    assert L.distractors(refs, blocks).count() == 0


def test_instruction_past_the_bound(spark):
    from curascore.functions.prompts import instruction, label_list_text

    df = spark.createDataFrame([(1, "context"), (2, "pure"), (3, None)], "id long, regime string")
    small = vocabulary(spark, 2_000)
    names = L.label_list(bounded(small), "list_pos")
    want = {r["id"]: r["t"] for r in df.select("id", instruction(F.col("regime"), names).alias("t")).collect()}
    got = {r["id"]: r["instruction"] for r in CH.with_instruction(df, Dimension(small, None)).collect()}
    assert got == want
    big = CH.with_instruction(df, vocabulary(spark, 60_000)).where("id = 1")
    text = big.first()["instruction"]
    assert label_list_text([f"it's label {i:06d}" for i in range(60_000)]) in text
    assert len(big._jdf.queryExecution().logical().toString()) < 20_000


def test_gradient_heads_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5)) + 3 * np.eye(5)[rng.integers(0, 3, 90)]
    y = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(90)] + [(None, 1), ([1.0] * 5, None)], "features array<double>, y_true int").repartition(4)
    u = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(90)])
    losses = []
    heads = {(r["setting"], r["class_id"]): [*r["weights"], r["bias"]] for r in PB.gradient_heads(df, [0.5, 4.0], 3, steps=6).collect()}
    for s, rate in enumerate((0.5, 4.0)):
        w = np.zeros((3, 6))
        for _ in range(6):
            p = np.exp(u @ w.T)
            w += rate / 90 * (np.eye(3)[y] - p / p.sum(1, keepdims=True)).T @ u
        assert np.array([heads[s, k] for k in range(3)]) == pytest.approx(w)
        z = u @ w.T
        losses.append(float(np.mean([math.log(np.exp(row).sum()) - row[k] for row, k in zip(z, y, strict=True)])))
    table, best = PB.sweep_rates(df, df, [0.5, 4.0], 3, steps=6)
    found = sorted(map(tuple, table.collect()))
    assert [f[2] for f in found] == pytest.approx(losses) and [f[3] for f in found] == [losses[0] <= losses[1], losses[1] < losses[0]]
    assert best.count() == 3
    with pytest.raises(ValueError, match="outside"):
        PB.gradient_heads(df, [1.0], 2)
    with pytest.raises(ValueError, match="no rows"):
        PB.gradient_heads(df.limit(0), [1.0], 2)


def test_grid_of_classes_and_runs(spark, monkeypatch):
    monkeypatch.setattr(M, "GRID_IDS", 4)
    classes = spark.createDataFrame([(i, f"c{i}") for i in (0, 1, 2, 9, 40, 41)], "class_id int, label string")
    runs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "run string, k int")
    got = sorted(map(tuple, M.class_grid(runs, classes).collect()), key=str)
    assert got == sorted([(r, k, c, f"c{c}") for r, k in (("a", 1), ("b", 2), (None, 3)) for c in (0, 1, 2, 9, 40, 41)], key=str)
    assert M.class_grid(runs, classes.limit(0)).count() == 0 and M.class_grid(runs.limit(0), classes).count() == 0
    monkeypatch.setattr(M, "MAX_RANGES", 2)
    with pytest.raises(ValueError, match="ranges"):
        M.class_grid(runs, classes)


def test_published_class_list_decodes_both_ways(spark):
    from curascore.settings import CLASS_LIST, FALSE_PARSE_ID

    pairs = [(c, d) for c, diseases in CLASS_LIST.items() for d in diseases]
    assert len(pairs) == FALSE_PARSE_ID
    df = L.with_label(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "crop string, disease string, place int"))
    places = F.element_at(F.create_map(*[x for i, (c, d) in enumerate(pairs) for x in (F.lit(f"{c.lower()}_{d}"), F.lit(i))]), F.col("label"))
    table = L.class_table(df, places)
    sorted_ids = {x: i for i, x in enumerate(sorted(f"{c.lower()}_{d}" for c, d in pairs))}
    assert {r["label"]: (r["class_id"], r["list_pos"]) for r in table.collect()} == {f"{c.lower()}_{d}": (sorted_ids[f"{c.lower()}_{d}"], i) for i, (c, d) in enumerate(pairs)}
    listed = table.select("label", F.col("list_pos").alias("class_id"))
    back = L.decode_labels(df.withColumn("class_id", F.col("place")), listed, name="decoded")
    assert back.where("decoded <> crop_disease_label or decoded is null").count() == 0
