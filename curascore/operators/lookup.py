"""Joins to a dimension whose size is checked before it is broadcast."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 50_000
MAX_BYTES = 64 * 1024 * 1024
SALTS = 64


class Dimension(NamedTuple):
    """A dimension table; ``rows`` is set when it was proven small enough for every executor."""

    frame: DataFrame
    rows: pa.Table | None

    @property
    def is_small(self) -> bool:
        return self.rows is not None


def bounded(dim: DataFrame | Dimension, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Dimension:
    """Evaluate at most ``max_rows + 1`` rows; only a dimension within both bounds becomes a local relation.

    The dimension is computed once here, so the large side is not shuffled while waiting for its size.
    """
    if isinstance(dim, Dimension):
        return dim
    rows = dim.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return Dimension(dim, None)
    return Dimension(dim.sparkSession.createDataFrame(rows, schema=dim.schema), rows)


def lookup_join(df: DataFrame, dim: DataFrame | Dimension, on: str | list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join to a dimension: broadcast when proven small, else a salted shuffle join.

    The salt spreads a hot key of ``df`` over ``salts`` tasks; it is taken from row content, so a retried
    task repeats it. ``how`` is one that keeps or drops rows of ``df`` (inner, left, left_semi, left_anti).
    """
    keys = [on] if isinstance(on, str) else on
    table = bounded(dim)
    if table.is_small:
        return df.join(F.broadcast(table.frame), keys, how)
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = table.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
