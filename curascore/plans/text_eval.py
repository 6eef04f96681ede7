"""Stored model outputs -> labels -> outcomes -> metrics and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.functions.text import escape_output
from curascore.operators.choices import resolve_by_regime, resolve_prediction, with_outcome
from curascore.operators.curation import first_n
from curascore.operators.labels import encode_labels
from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.operators.metrics import (
    combine_views, confusion_long, confusion_matrix, macro_metrics, parse_quality, per_class_counts, per_class_metrics,
)
from curascore.session import scratch_path
from curascore.settings import EVALUATION_SEED, FALSE_PARSE, PARSE_SAMPLE_ROWS, VIEWS


def judge(outputs: DataFrame, vocab: DataFrame | Dimension, regime: str | None = None,
          classes: DataFrame | Dimension | None = None, strict: bool = False) -> DataFrame:
    """Add label, fallback flag, outcome, ``y_pred`` and ``y_true`` to each output.

    A true label outside the vocabulary gives a null ``y_true``; ``unknown_labels`` lists these, and with ``strict``
    such a row is an error when it is read.
    """
    return _coded(resolve_prediction(outputs, regime, classes=classes), vocab, strict)


def judge_by_regime(outputs: DataFrame, vocab: DataFrame | Dimension, regime: str = "regime",
                    classes: DataFrame | Dimension | None = None, strict: bool = False) -> DataFrame:
    """``judge`` with the regime of each output in a column, so that outputs of several regimes go in one pass."""
    return _coded(resolve_by_regime(outputs, regime, classes=classes), vocab, strict)


def _coded(resolved: DataFrame, vocab: DataFrame | Dimension, strict: bool) -> DataFrame:
    table = bounded(vocab)
    rows = encode_labels(with_outcome(resolved, table), table, "crop_disease_label").withColumnRenamed("class_id", "y_true")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("true label outside the vocabulary: "), F.coalesce("crop_disease_label", F.lit("null"))))
        rows = rows.withColumn("y_true", F.coalesce("y_true", unknown.cast("int")))
    return rows


def unknown_labels(judged: DataFrame) -> DataFrame:
    """True labels outside the vocabulary and their rows, which no matrix or metric holds."""
    return judged.where("y_true is null").groupBy(F.col("crop_disease_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def condense(judged: DataFrame, keys: list[str] | None = None) -> Dimension:
    """Rows per (keys, source, y_true, y_pred, is_false_parse, is_fallback): all that the metrics need.

    Parsing is the costly step, so its result is counted once; the counts depend on the classes, not the rows.
    """
    return bounded(judged.groupBy(
        *(keys or []), "source", "y_true", "y_pred", (F.col("label") == FALSE_PARSE).alias("is_false_parse"), "is_fallback"
    ).agg(F.count(F.lit(1)).alias("n")), max_rows=1_000_000)


def metrics_of(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return per_class_metrics(per_class_counts(confusion_long(counts, keys, weight="n"), keys))


def summary_of(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    on = [*(keys or []), "view"]
    quality = parse_quality(counts, keys, weight="n").select(*on, "success_rate", "false_parse", "fallback", "out_of_vocabulary")
    return lookup_join(macro_metrics(metrics_of(counts, keys), keys), quality, on)


def summary(outputs: DataFrame, vocab: DataFrame | Dimension, regime: str | None = None,
            classes: DataFrame | Dimension | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per (keys, view): macro metrics next to the parse counts; ``keys`` keeps runs apart in one pass."""
    return summary_of(condense(judge(outputs, vocab, regime, classes), keys).frame, keys)


def failure_matrix(counts: DataFrame, n_classes: int, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Wide matrix per view over all classes and the failure class, which has the last id ``n_classes``.

    ``counts`` come from ``condense``. The row of the failure class is empty, its column holds the false parses.
    """
    return confusion_matrix(confusion_long(counts, weight="n"), n_classes + 1, views)


def per_class_table(counts: DataFrame, vocab: DataFrame | Dimension, keys: list[str] | None = None) -> DataFrame:
    """All classes with their names, and F1, precision and recall of the three views; per run where ``keys`` name it."""
    return combine_views(metrics_of(counts, keys), keys, bounded(vocab).frame)


def report_tables(outputs: DataFrame, vocab: DataFrame | Dimension, regime: str | None = None,
                  classes: DataFrame | Dimension | None = None, sample_rows: int = PARSE_SAMPLE_ROWS, row_id: str = "sample_id") -> dict[str, DataFrame]:
    """The report: summary, per-class table with names, n+1-class matrix, failed outputs, parse samples, unknown labels.

    Outputs are parsed once; what came of them is written, with the text of failed outputs only, and all tables are
    made from that. The texts of the parse samples are looked up by ``row_id``, which must be unique.
    """
    table = bounded(vocab)
    judged = judge(outputs, table, regime, classes)
    failed = F.when(F.col("label") == FALSE_PARSE, escape_output("output")).alias("failed_output")
    judged = _written(judged.select(row_id, "source", "crop_disease_label", "label", "is_fallback", "y_true", "y_pred", failed))
    counts = condense(judged).frame
    picked = bounded(first_n(judged.select(row_id, "y_true"), sample_rows, EVALUATION_SEED, row_id), max_rows=sample_rows)
    return {
        "summary": summary_of(counts),
        "per_class": per_class_table(counts, table),
        "matrix": failure_matrix(counts, table.frame.agg(F.max("class_id").alias("n")).first()["n"] or 0),
        "failed_outputs": judged.where(F.col("label") == FALSE_PARSE).select(row_id, "failed_output"),
        "parse_samples": lookup_join(outputs.select(row_id, "output"), picked, row_id).select("pos", "y_true", escape_output("output").alias("parsed_output")),
        "unknown_labels": unknown_labels(judged),
    }


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "judged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def failed_outputs(judged: DataFrame) -> DataFrame:
    """Every output that gave no label, as one quoted line."""
    return judged.where(F.col("label") == FALSE_PARSE).select("sample_id", escape_output("output").alias("failed_output"))
