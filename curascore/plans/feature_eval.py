"""Feature vectors -> prototypes or head -> best class -> metrics per view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curascore.operators.lookup import Dimension, bounded
from curascore.operators.metrics import combine_views, confusion_long, confusion_matrix, macro_metrics, metrics_by_view, per_class_counts, per_class_metrics
from curascore.operators.scoring import class_prototypes, nearest_prototype, predict_linear, require_dimensions
from curascore.sources.heads import load_head


def zero_shot_metrics(samples: DataFrame, prototypes: DataFrame | Dimension | None = None) -> DataFrame:
    """Macro metrics of the nearest prototype; without given prototypes they come from the samples themselves."""
    protos = prototypes if prototypes is not None else class_prototypes(samples)
    return metrics_by_view(nearest_prototype(samples, protos))


def probe_metrics(samples: DataFrame, head: DataFrame | Dimension) -> DataFrame:
    """Macro metrics of a stored linear head over normalised features."""
    return metrics_by_view(predict_linear(samples, head, unit=True))


def evaluate_stored_head(spark: SparkSession, path: str, samples: DataFrame, classes: DataFrame | Dimension) -> dict[str, DataFrame]:
    """A head read from disk, checked against classes and features, and what it makes of the samples per view.

    The number of classes must be that of the head, and every feature as wide as its weights; else this is an error
    before anything is scored. Tables: summary (macro metrics), per_class (with names) and matrix.
    """
    table = bounded(classes)
    n = table.frame.count()
    head, _ = load_head(spark, path, n)
    require_dimensions(samples, head, n)
    scored = predict_linear(samples, head, unit=True)
    # Counted once; the counts depend on the classes only.
    counts = bounded(confusion_long(scored), max_rows=1_000_000).frame
    metrics = per_class_metrics(per_class_counts(counts))
    return {"summary": macro_metrics(metrics), "per_class": combine_views(metrics, classes=table.frame), "matrix": confusion_matrix(counts, n)}
