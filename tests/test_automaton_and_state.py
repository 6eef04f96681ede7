"""Long label lists against plain containment, and the incremental state of a confusion stream."""

import random

import pytest
from pyspark.sql import functions as F

from curascore.operators import choices as CH
from curascore.operators.lookup import Dimension
from curascore.operators.metrics import confusion_long
from curascore.streaming import evaluation as ST


@pytest.mark.parametrize("block, chunk", [(2_000_000, 1 << 25), (30, 400)])
def test_automaton_equals_containment(spark, monkeypatch, block, chunk):
    rng = random.Random(block)
    monkeypatch.setattr(CH, "BLOCK_CHARS", block)
    monkeypatch.setattr(CH, "TEXT_BYTES", chunk)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    labels = list(dict.fromkeys(word(rng.randrange(3, 9)) for _ in range(120)))
    texts = [word(rng.randrange(0, 40)) for _ in range(150)] + [labels[5]] * 60 + [None, "", "b" * 50_000 + labels[0]]
    classes = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, list_pos int")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, output string")
    got = {r["id"]: r["label"] for r in CH.context_match(df, Dimension(classes, None)).collect()}
    assert got == {i: next((x for x in labels if t is not None and x in t), "false_parse") for i, t in enumerate(texts)}


def test_automaton_odd_lists(spark):
    df = spark.createDataFrame([(1, "some text"), (2, ""), (3, None)], "id long, output string")
    match = lambda rows: {r["id"]: r["label"] for r in CH.context_match(df, Dimension(spark.createDataFrame(rows, "label string, list_pos int"), None)).collect()}
    assert match([]) == {1: "false_parse", 2: "false_parse", 3: "false_parse"}
    assert match([("text", 1), (None, 0), ("", 5)]) == {1: "text", 2: "", 3: "false_parse"}
    # Of equal labels and of nested ones the first in the list counts.
    assert match([("e t", 4), ("some text", 2), ("some", 3)])[1] == "some text"
    assert CH.context_match(df.limit(0), Dimension(spark.createDataFrame([("a", 0)], "label string, list_pos int"), None)).count() == 0


def test_batches_write_their_own_keys(spark, tmp_path):
    fields = "source string, y_true int, y_pred int"
    table, state = str(tmp_path / "rows"), str(tmp_path / "state")
    sent = []

    def send(*rows):
        sent.extend(rows)
        spark.createDataFrame(list(rows), fields).coalesce(1).write.mode("append").parquet(table)

    def run():
        stream = ST.stream_table(spark, table, spark.createDataFrame([], fields).schema)
        got = ST.run_confusion(stream, state, compact_every=3)
        want = confusion_long(spark.createDataFrame(sent, fields))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))

    send(("lab", 1, 1), ("lab", 1, 2), ("field", 0, 0), ("lab", None, 1))
    run()
    for i in range(7):  # seven restarts, one changed key each
        send(("lab", 1, 1), ("field", i, 5))
        run()
        written = spark.read.parquet(f"{state}/changes/batch={i + 1}")
        assert sorted(map(tuple, written.select("source", "y_true", "y_pred", "n").collect())) == sorted([("lab", 1, 1, i + 2), ("field", i, 5, 1)])
    assert ST._batches(spark, f"{state}/versions") == [2, 5]
    # A write that was not finished does not count, and a run without new rows changes nothing.
    spark.range(1).select(F.lit("lab").alias("source"), F.lit(1).alias("y_true"), F.lit(1).alias("y_pred"), F.lit(99).cast("long").alias("n")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{state}/changes/batch=50")
    run()


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "source string, y_true int, y_pred int").write.parquet(str(tmp_path / "none"))
    stream = ST.stream_table(spark, str(tmp_path / "none"), spark.read.parquet(str(tmp_path / "none")).schema)
    assert ST.run_confusion(stream, str(tmp_path / "state")).count() == 0
