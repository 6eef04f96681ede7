"""Prototypes, linear heads, top-k and argmax over stored feature vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.functions.vectors import best_in_block, l2_normalize, matrix_scores, softmax
from curascore.operators.class_stream import All, Best, PerBlock, against_classes, array_scores, packed_classes
from curascore.operators.lookup import Dimension, bounded
from curascore.settings import TOP_K

BLOCK_BYTES = 32 * 1024 * 1024  # a class table up to this size is shipped with its task


def class_prototypes(df: DataFrame, class_id: str = "y_true", features: str = "features") -> DataFrame:
    """(class_id, prototype): normalise, mean per class, normalise again.

    The mean is a partial aggregation, so a class that holds most rows is reduced before it is shuffled.
    """
    unit = df.where(F.col(features).isNotNull()).select(
        F.col(class_id).alias("class_id"), array_to_vector(l2_normalize(features)).alias("_v")
    )
    means = unit.groupBy("class_id").agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select("class_id", l2_normalize(vector_to_array("_m")).alias("prototype"))


def _as_arrays(rows: pa.Table, vector: str, bias: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    rows = rows.sort_by("class_id")
    flat = rows[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weights = flat.astype(np.float64).reshape(rows.num_rows, -1)
    shift = rows[bias].to_numpy().astype(np.float64) if bias else None
    return rows["class_id"].to_numpy().astype(np.int32), weights, shift


def _small(table: DataFrame | Dimension, vector: str, bias: str | None) -> tuple[Dimension, tuple[np.ndarray, np.ndarray, np.ndarray | None] | None]:
    """The class table, and its (ids, weights, bias) where it is proven small enough to be shipped with every task."""
    dim = bounded(table, max_bytes=BLOCK_BYTES)
    if dim.is_small and not dim.rows.num_rows:
        raise ValueError("no classes to score against")
    return dim, _as_arrays(dim.rows, vector, bias) if dim.is_small else None


def _best_class(df: DataFrame, table: DataFrame | Dimension, vector: str, bias: str | None, features: str, unit: bool) -> DataFrame:
    dim, small = _small(table, vector, bias)
    if small is None:
        return against_classes(df, packed_classes(dim.frame, vector, bias), Best(), features, unit)
    ids, weights, shift = small
    best = best_in_block(features, weights, ids, shift, unit)
    return df.withColumn("_best", best).select("*", F.col("_best.score").alias("score"), F.col("_best.class_id").alias("y_pred")).drop("_best")


def nearest_prototype(df: DataFrame, prototypes: DataFrame | Dimension, features: str = "features") -> DataFrame:
    """Add ``score`` (cosine, 6 decimals) and ``y_pred``; the lowest id wins a tie.

    A class table that is proven small is shipped and samples are not shuffled. A larger one streams past chunks of
    samples in blocks, each task keeping the best class so far.
    """
    return _best_class(df, prototypes, "prototype", None, features, unit=True)


def score_arrays(df: DataFrame, table: DataFrame | Dimension, features: str = "features", row_id: str = "sample_id", vector: str = "weights",
                 bias: str | None = "bias", unit: bool = False) -> DataFrame:
    """``(row_id, class_ids, scores)``: all scores of a sample as arrays, in one row or, past the bound, one per block of classes."""
    dim, small = _small(table, vector, bias)
    if small is None:
        return against_classes(df, packed_classes(dim.frame, vector, bias), PerBlock(), features, unit, [row_id])
    ids, weights, shift = small
    names = F.array(*[F.lit(int(i)) for i in ids])
    return df.select(row_id, matrix_scores(features, weights, shift, unit).alias("scores")).select(
        row_id, F.when(F.col("scores").isNotNull(), names).alias("class_ids"), "scores")


def _pairs(arrays: DataFrame, row_id: str) -> DataFrame:
    return arrays.select(row_id, F.explode(array_scores("class_ids", "scores")).alias("_s")).select(row_id, "_s.class_id", "_s.score")


def score_pairs(df: DataFrame, prototypes: DataFrame | Dimension, features: str = "features", row_id: str = "sample_id") -> DataFrame:
    """Cosine of every sample with every prototype, as (row_id, class_id, score); arrays until they are written out."""
    return _pairs(score_arrays(df, prototypes, features, row_id, "prototype", None, unit=True), row_id)


def linear_scores(df: DataFrame, head: DataFrame | Dimension, features: str = "features", row_id: str = "sample_id") -> DataFrame:
    """``W x + b`` for every class, as (row_id, class_id, score)."""
    return _pairs(score_arrays(df, head, features, row_id), row_id)


def with_logits(df: DataFrame, head: DataFrame | Dimension, features: str = "features", name: str = "logits", unit: bool = False) -> DataFrame:
    """Add the scores of all classes as one array in id order; ids must be 0..n-1, others are an error."""
    dim, small = _small(head, "weights", "bias")
    if small is None:
        blocks = packed_classes(dim.frame, "weights", "bias")
        n = blocks.agg(F.sum(F.octet_length("_ids") / 8).cast("long").alias("n")).first()["n"]
        return against_classes(df, blocks, All(n or 0, name), features, unit)
    ids, weights, shift = small
    if ids.tolist() != list(range(len(ids))):
        raise ValueError(f"class ids must be 0..{len(ids) - 1}")
    return df.withColumn(name, matrix_scores(features, weights, shift, unit))


def predict_linear(df: DataFrame, head: DataFrame | Dimension, features: str = "features", unit: bool = False) -> DataFrame:
    """Add the best class of a linear head; ``unit`` normalises the features first, as probe heads expect.

    Leave the normalisation to ``unit`` rather than to a projected ``l2_normalize``: the optimizer would move
    that lambda into the argument of the Arrow function, and does not always recognise it there again.
    """
    return _best_class(df, head, "weights", "bias", features, unit)


def prototypes_as_head(prototypes: DataFrame) -> DataFrame:
    return prototypes.select("class_id", F.col("prototype").alias("weights"), F.lit(0.0).alias("bias"))


def top_k(df: DataFrame, k: int = TOP_K, scores: str = "logits", row_id: str = "sample_id", decimals: int = 6) -> DataFrame:
    """The ``min(k, n)`` most probable classes per sample as (row_id, rank, class_id, prob), within the row."""
    ranked = F.transform(
        F.col("_probs"),
        lambda p, i: F.struct((-F.round(p, decimals)).alias("_neg"), i.alias("class_id"), p.alias("prob")),
    )
    best = F.slice(F.array_sort(ranked), 1, k)
    return (
        df.select(row_id, softmax(scores).alias("_probs"))
        .select(row_id, F.posexplode(best).alias("rank", "_s"))
        .select(row_id, (F.col("rank") + 1).alias("rank"), F.col("_s.class_id").alias("class_id"), F.col("_s.prob").alias("prob"))
    )


def argmax(scores: DataFrame, row_id: str = "sample_id", decimals: int = 6) -> DataFrame:
    """Best class per sample; lowest id on ties.

    From score arrays the best of each array is found within its row, so a sample is shuffled once per block of
    classes, not once per class. Long scores (row_id, class_id, score) are taken as well.
    """
    if "scores" in scores.columns:
        pick = F.transform(array_scores("class_ids", "scores"), lambda x: F.struct(F.round(x["score"], decimals).alias("s"), (-x["class_id"]).alias("c")))
        best = scores.where(F.col("scores").isNotNull()).select(row_id, F.array_max(pick).alias("_b"))
    else:
        best = scores.select(row_id, F.struct(F.round("score", decimals).alias("s"), (-F.col("class_id")).alias("c")).alias("_b"))
    return best.groupBy(row_id).agg(F.max("_b").alias("_b")).select(row_id, (-F.col("_b.c")).alias("y_pred"), F.col("_b.s").alias("score"))


def check_dimensions(df: DataFrame, n_classes: int, width: int, features: str = "features") -> DataFrame:
    """One row per feature width found: its rows and whether it fits the head."""
    return df.groupBy(F.size(features).alias("width")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fits", (F.col("width") == width)
    ).withColumn("head_classes", F.lit(n_classes))


def require_dimensions(df: DataFrame, head: DataFrame, n_classes: int, features: str = "features") -> None:
    """Raise where a feature width or the class count differs from the head."""
    found = head.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("d")).first()
    if found["n"] != n_classes:
        raise ValueError(f"head has {found['n']} classes, the data has {n_classes}")
    wrong = check_dimensions(df, n_classes, found["d"], features).where(~F.col("fits")).limit(5).collect()
    if wrong:
        raise ValueError(f"feature widths {[r['width'] for r in wrong]} do not fit a head of width {found['d']}")
