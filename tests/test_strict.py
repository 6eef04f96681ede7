"""Bad or unusual input is reported or kept, never lost."""

import pytest
from pyspark.sql import functions as F

from curascore.operators import choices as CH
from curascore.operators.labels import class_table, label_list
from curascore.operators.lookup import Dimension, bounded
from curascore.operators.metrics import combine_views, confusion_matrix, matrix_to_long, per_class_metrics
from curascore.sources.readers import read_matrix_csv
from curascore.streaming.evaluation import run_confusion, stream_table


def large(df):
    return Dimension(df, None)


def test_matrix_columns_must_fit(spark):
    wide = spark.createDataFrame([(0, 1, 2, 11)], "y_true int, p0 int, p1 int, p2 int")
    with pytest.raises(ValueError, match="3 value columns"):
        matrix_to_long(wide, 2)
    assert matrix_to_long(wide, 3).agg(F.sum("n")).first()[0] == 14


def test_confusion_matrix_rejects_stray_ids(spark):
    counts = spark.createDataFrame([("main", 0, 0, 5), ("main", 1, 0, 3), ("main", 1, 0, 1)], "view string, y_true int, y_pred int, n long")
    rows = {r["y_true"]: (r["p0"], r["p1"]) for r in confusion_matrix(counts, 2, ("main",)).collect()}
    assert rows == {0: (5, 0), 1: (4, 0)}
    for bad in ((2, 0), (0, 2), (-1, 0)):
        more = counts.union(spark.createDataFrame([("main", *bad, 9)], counts.schema))
        with pytest.raises(Exception, match="class id outside"):
            confusion_matrix(more, 2, ("main",)).collect()


@pytest.mark.parametrize("text, want", [
    ("﻿HEADER,\n1,2\n3,4\n", [(0, 1, 2), (1, 3, 4)]), ("1,2\n\n3,4\n", [(0, 1, 2), (1, 3, 4)]), ("﻿1,2\n3,4", [(0, 1, 2), (1, 3, 4)]),
    ("1,2\nx,4\n", None), ("1,2\n3,4,5\n", None), ("1,2\n3\n", None), ("HEADER\nHEADER\n1,2\n", None), ("1,2\n3,y\n", None)])
def test_matrix_file(spark, tmp_path, text, want):
    (tmp_path / "m.csv").write_text(text)
    df = read_matrix_csv(spark, str(tmp_path / "m.csv"), 2)
    if want is None:
        with pytest.raises(Exception, match="not 2 integers"):
            df.collect()
    else:
        assert sorted(map(tuple, df.collect())) == want


def test_choices_keep_every_row(spark):
    vocab = spark.createDataFrame([(f"l{i}", i) for i in range(8)], "label string, class_id int")
    rows = spark.createDataFrame([(1, "l3"), (1, "l5"), (2, "unknown"), (3, "l0"), (3, "l0")], "sample_id long, crop_disease_label string")
    got = [sorted((r[0], r[1], tuple(sorted(r[2].items()))) for r in CH.build_choices(rows, v).collect()) for v in (vocab, large(vocab))]
    assert got[0] == got[1] and len(got[0]) == 5
    for _, label, options in got[0]:
        values = [v for _, v in options]
        assert label in values and len(set(values)) == 4


def test_context_match_forms_agree_on_repeated_ids(spark):
    classes = spark.createDataFrame([("leaf rust", 0), ("leaf", 1), ("scab\nspot", 2)], "label string, list_pos int")
    texts = ["a leaf rust", "a leaf", "scab\nspot", "none", "", None, "é leaf", "leafleaf rust"]
    rows = spark.createDataFrame([(1, t) for t in texts], "sample_id long, output string")
    got = [sorted(map(str, CH.context_match(rows, v).select("output", "label").collect())) for v in (classes, large(classes))]
    assert got[0] == got[1] and len(got[0]) == len(texts)
    long = spark.createDataFrame([(1, "word " * 20_000 + "leaf rust")], "sample_id long, output string")
    assert CH.context_match(long, large(classes)).first()["label"] == "leaf rust"


def test_regimes_need_their_inputs(spark):
    rows = spark.createDataFrame([(1, "A", "mcq"), (2, "x", "context")], "sample_id long, output string, regime string")
    for regime in ("mcq", "context"):
        with pytest.raises(Exception, match=f"the {regime} regime needs"):
            CH.resolve_by_regime(rows.where(F.col("regime") == regime)).select("label").collect()


def test_label_order_must_exist(spark):
    vocab = spark.createDataFrame([("b", 1), ("a", 2)], "label string, class_id int")
    assert label_list(vocab) == ["b", "a"] and label_list(vocab.select("label")) == ["a", "b"]
    with pytest.raises(ValueError, match="list_pos"):
        label_list(vocab, "list_pos")


def test_class_ids_number_labels_in_both_forms(spark, monkeypatch):
    rows = spark.createDataFrame([("x_a", "X", "a"), ("x_a", "x", "a"), ("y_a", "Y", "a")], "crop_disease_label string, crop string, disease string")
    ids = lambda: sorted((r["label"], r["crop"], r["class_id"]) for r in class_table(rows).collect())
    short = ids()
    monkeypatch.setattr("curascore.operators.labels.bounded", lambda d: bounded(d, max_rows=0))
    assert ids() == short == [("x_a", "X", 0), ("x_a", "x", 0), ("y_a", "Y", 1)]


def test_views_list_every_class(spark):
    per_class = spark.createDataFrame([("r1", "main", 1, 2, 0, 0), ("r2", "main", 0, 1, 1, 0)], "run string, view string, class_id int, tp long, fp long, fn long")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class_id int, label string")
    table = combine_views(per_class_metrics(per_class), ["run"], classes).collect()
    assert sorted((r["run"], r["label"], r["f1_main"] > 0) for r in table) == [
        ("r1", "a", False), ("r1", "b", True), ("r1", "c", False), ("r2", "a", True), ("r2", "b", False), ("r2", "c", False)]


def test_streams_restart_and_read_only_their_table(spark, tmp_path):
    schema = "source string, y_true int, y_pred int"
    write = lambda name, n: spark.createDataFrame([("lab", 0, 1)] * n, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    total = lambda df: df.where("view = 'main'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    run = lambda name: total(run_confusion(stream_table(spark, str(tmp_path / name), fields), str(tmp_path / f"state-{name}")))
    write("tab_old", 5)
    write("tab", 2)
    assert run("tab") == 2
    assert run("tab") == 2  # nothing new
    write("tab", 3)
    assert run("tab") == 5
    spark.createDataFrame([], fields).write.parquet(str(tmp_path / "empty"))
    assert run("empty") == 0
