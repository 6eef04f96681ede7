"""Vector columns. Element-wise work is native; class scoring is a matrix product over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curascore.functions.hashing import col_of
from curascore.functions.lets import let
from curascore.settings import CHANNEL_MEAN, CHANNEL_STD, NORM_FLOOR


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def norm(c: Column | str) -> Column:
    v = col_of(c)
    return F.sqrt(F.aggregate(v, _zero(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(c: Column | str, floor: float | None = NORM_FLOOR) -> Column:
    """``v / max(|v|, floor)``; with ``floor=None`` a zero vector gives null elements."""
    v = col_of(c)
    size = norm(v)
    size = F.greatest(size, F.lit(floor)) if floor is not None else F.nullif(size, _zero())
    return let(size, lambda s: F.transform(v, lambda x: x.cast("double") / s))


def softmax(c: Column | str) -> Column:
    """Probabilities, shifted by the maximum so that the exponentials cannot overflow."""
    v = col_of(c)
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(
        shifted,
        lambda e: let(F.aggregate(e, _zero(), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)),
    )


def cross_entropy(scores: Column | str, y_true: Column | str) -> Column:
    """``log(sum(exp(scores))) - scores[y]`` per row."""
    v, y = col_of(scores), col_of(y_true)
    return let(
        F.array_max(v),
        lambda top: F.ln(F.aggregate(v, _zero(), lambda acc, x: acc + F.exp(x - top))) + top - F.get(v, y),
    )


def standardize_channels(c: Column | str, mean: Sequence[float] = CHANNEL_MEAN, std: Sequence[float] = CHANNEL_STD) -> Column:
    """``(x - mean[c]) / std[c]`` with channel ``c = i mod len(mean)`` on an interleaved array."""
    channels = len(mean)
    m, s = F.array(*[F.lit(float(x)) for x in mean]), F.array(*[F.lit(float(x)) for x in std])
    return F.transform(
        col_of(c), lambda x, i: (x.cast("double") - F.get(m, i % channels)) / F.get(s, i % channels)
    )


def pooled_feature(pooled: Column | str, states: Column | str) -> Column:
    """The pooled vector where present, else the first state vector."""
    return F.coalesce(col_of(pooled), F.get(col_of(states), F.lit(0)))


def dense_rows(batch: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid mask, valid rows as one float64 matrix) of an Arrow list column; a wrong width is an error."""
    flat = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    valid = np.asarray(flat.is_valid())
    kept = flat.drop_null()
    lengths = np.asarray(kept.value_lengths())
    if lengths.size and not (lengths == width).all():
        raise ValueError(f"feature width differs from the head: expected {width}, got {sorted(set(lengths.tolist()))}")
    values = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return valid, values.reshape(-1, width)


def _list_column(valid: np.ndarray, rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(valid, width, 0))]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
    if valid.all():
        return made
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=pa.array(~valid))


def matrix_scores(features: Column | str, weights: np.ndarray, bias: np.ndarray | None = None, unit: bool = False) -> Column:
    """``W x + b`` for all classes of one bounded weight block, as array<double> in row order of ``weights``.

    With ``unit`` the features are L2-normalised first. One matrix product per Arrow batch.
    """
    transposed = np.ascontiguousarray(weights.T)
    width = weights.shape[1]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batch: pa.Array) -> pa.Array:
        valid, rows = dense_rows(batch, width)
        if unit:
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), NORM_FLOOR)
        out = rows @ transposed
        if bias is not None:
            out = out + bias
        return _list_column(valid, out)

    return score(col_of(features))


def best_in_block(features: Column | str, weights: np.ndarray, ids: np.ndarray, bias: np.ndarray | None = None,
                  unit: bool = False, decimals: int | None = 6) -> Column:
    """struct(score, class_id) of the best class of one bounded block; ties go to the lowest id.

    ``decimals`` rounds scores before they are compared, so that ties do not hang on summation order.
    """
    order = np.argsort(ids, kind="stable")
    transposed = np.ascontiguousarray(weights[order].T)
    shift = bias[order] if bias is not None else None
    sorted_ids, width = ids[order], weights.shape[1]

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("class_id", T.IntegerType())]))
    def pick(batch: pa.Array) -> pa.Array:
        valid, rows = dense_rows(batch, width)
        if unit:
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), NORM_FLOOR)
        out = rows @ transposed
        if shift is not None:
            out = out + shift
        if decimals is not None:
            out = np.round(out, decimals)
        at = out.argmax(axis=1)
        best = np.full(valid.size, np.nan)
        best[valid] = out[np.arange(at.size), at]
        chosen = np.full(valid.size, -1, dtype=np.int32)
        chosen[valid] = sorted_ids[at]
        return pa.StructArray.from_arrays(
            [pa.array(best, mask=~valid), pa.array(chosen, type=pa.int32(), mask=~valid)],
            fields=[pa.field("score", pa.float64()), pa.field("class_id", pa.int32())],
        )

    return pick(col_of(features))
