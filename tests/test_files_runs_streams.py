"""Files, run names and streams."""

import os
import subprocess
import sys

import pytest

from curascore.functions import prompts as PR
from curascore.operators import metrics as M
from curascore.operators import runs as R
from curascore.plans import views as V
from curascore.session import scratch_path
from curascore.sources import readers, writers
from curascore.streaming import evaluation as ST
from tests.conftest import SF


def test_matrix_csv_with_heading_and_mark(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿HEADER,x,y\n1,2,3\n4,5,6\n7,8,9\n".encode())
    rows = readers.read_matrix_csv(spark, str(path), 3).orderBy("y_true").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 2, 3), (1, 4, 5, 6), (2, 7, 8, 9)]
    plain = tmp_path / "p.csv"
    plain.write_text("1,0\n2,7\n")
    got = M.matrix_to_long(readers.read_matrix_csv(spark, str(plain), 2), 2).collect()
    assert {(r.y_true, r.y_pred): r.n for r in got} == {(0, 0): 1, (1, 0): 2, (1, 1): 7}


def test_outputs_csv_keeps_text(spark, tmp_path):
    texts = [" lead", "two\nlines", 'a "quoted", one', "back\\slash\\n", "tail "]
    df = spark.createDataFrame([(i, f"l{i}", t) for i, t in enumerate(texts)], readers.OUTPUT_SCHEMA)
    writers.write_csv(df, str(tmp_path / "o"), ["True Label", "True Label (Text)", "Parsed Output"])
    back = readers.read_outputs_csv(spark, str(tmp_path / "o"), multi_line=True).orderBy("True Label").collect()
    assert [r["Parsed Output"] for r in back] == texts


def test_split_filter_prunes_folders(spark, tmp_path):
    writers.publish(V.labelled(spark, SF), str(tmp_path / "d"))
    one = readers.load_samples(spark, str(tmp_path / "d"), "test")
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    assert len(one.inputFiles()) > 0 and {r.split for r in one.select("split").distinct().collect()} == {"test"}


def test_checkpoints_are_listed_in_order(spark, tmp_path):
    for name in ("b.pth", "a.pth", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = readers.list_checkpoints(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.pth", "b.pth"]


def test_run_names(spark):
    names = [
        "dir/resnet50_model_exp_0.0001_16.pth", "dir/resnet50_model_exp_4.pth", "convnext_model_exp_1e-05_64.pth", "resnet50_model_exp_9.pth",
        "notes.pth", "resnet50_model_exp_0.0001_16.txt", "a_b_model_exp_1.pth", "dir/z/resnet50_model_exp_0.pth"]
    files = spark.createDataFrame(list(enumerate(names)), "run_pos long, path string")
    parsed = R.parse_run_files(files)
    got = {r.run_pos: (r.model, r.batch_size, r.learning_rate, r.status) for r in parsed.collect()}
    assert got == {
        0: ("resnet50", 16, 1e-4, "ok"), 1: ("resnet50", 32, 5e-4, "ok"), 2: ("convnext", 64, 1e-5, "ok"),
        3: ("resnet50", None, None, "out_of_range"), 4: (None, None, None, "skipped"), 6: (None, None, None, "skipped"),
        7: ("resnet50", 16, 1e-4, "ok")}
    shown = {r.run_name: r.path for r in R.named_runs(parsed).collect()}
    assert shown == {
        "ResNet50 Batch=16 LR=0.0001": "dir/z/resnet50_model_exp_0.pth", "ResNet50 Batch=32 LR=0.0005": names[1],
        "ConvNeXt-Tiny Batch=64 LR=1e-05": names[2]}
    assert {r.file for r in R.skipped_files(parsed).collect()} == {"notes.pth", "a_b_model_exp_1.pth"}
    ids = spark.createDataFrame([(8,), (9,)], "experiment_id long")
    with pytest.raises(Exception, match="no grid cell has number"):
        R.resolve_experiment(ids, strict=True).collect()


def test_grid_order(spark):
    rows = R.grid(spark.createDataFrame([("m",)], "model string")).orderBy("experiment_id").collect()
    assert [(r.batch_size, r.learning_rate) for r in rows] == [(b, lr) for b in (16, 32, 64) for lr in (1e-4, 5e-4, 2e-4)]


def test_trials_stay_in_range(spark):
    space = {"lr": {"distribution": "log_uniform_values", "min": 5e-5, "max": 2e-4}, "wd": {"distribution": "uniform", "min": 0, "max": 0.1},
             "r": {"distribution": "categorical", "values": [32, 64, 128]}}
    rows = R.trial_table(spark.range(500).withColumnRenamed("id", "trial_id"), space, 1).collect()
    assert all(5e-5 <= r.lr <= 2e-4 and 0 <= r.wd < 0.1 for r in rows) and {r.r for r in rows} == {32, 64, 128}
    middle = (5e-5 * 2e-4) ** 0.5
    assert 200 < sum(r.lr < middle for r in rows) < 300  # uniform in the logarithm


def test_best_epoch_takes_the_earlier_on_a_tie(spark):
    log = spark.createDataFrame([(0, 1, "m", 2.0), (0, 2, "m", 1.0), (0, 3, "m", 1.0)], "run_id int, epoch int, metric string, mean_value double")
    assert R.best_checkpoint(log).first().best_epoch == 2


def test_prompts(spark):
    df = spark.createDataFrame([("Bell Pepper", "leaf_spot"), ("Corn", "healthy"), ("{disease}", "x")], "crop string, disease string")
    rows = [r.p for r in df.select(PR.class_prompts().alias("p")).collect()]
    assert rows[0][0] == "a photo of a Bell Pepper leaf with leaf spot"
    assert rows[1] == ["a photo of a healthy Corn leaf", "an image of a healthy Corn leaf", "a close-up photo of a healthy Corn leaf"]
    assert rows[2][0] == "a photo of a {disease} leaf with x"  # inserted text is not searched again


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    preds = V.predictions(spark, SF)
    preds.repartition(5).write.parquet(str(tmp_path / "p"))
    stream = ST.stream_table(spark, str(tmp_path / "p"), spark.read.parquet(str(tmp_path / "p")).schema, files_per_trigger=1)
    got = ST.run_confusion(stream, scratch_path(spark, "t"))
    want = M.confusion_long(preds)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_of_outputs_equals_batch(spark, tmp_path):
    outs = V.outputs(spark, SF).select("sample_id", "output")
    outs.repartition(3).write.parquet(str(tmp_path / "o"))
    stream = ST.stream_table(spark, str(tmp_path / "o"), outs.schema, files_per_trigger=1)
    for regime in (None, "pure"):
        got = ST.run_parse(ST.streaming_parse(stream, regime=regime), scratch_path(spark, "t"))
        want = ST.streaming_parse(outs, regime=regime)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_scratch_follows_the_session():
    code = (
        "from curascore.session import build_session, scratch_path\n"
        "s = build_session(master='local[1]', **{'spark.checkpoint.dir': 'file:/tmp/shared-x', 'spark.ui.enabled': 'false'})\n"
        "print('PATH', scratch_path(s, 'tag'))"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout
    assert "PATH file:/tmp/shared-x/tag-" in out
