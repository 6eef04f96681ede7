"""Sums of many vectors or count tables that are spread over all tasks, in two steps of small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, salt int, at binary, value binary"
ARROW = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])
SALTS = 64


def rows(parts: list[tuple[int, np.ndarray, np.ndarray]], salt: int) -> pa.RecordBatch:
    """For each (part, positions, values of some columns per position) a row; positions need not be distinct."""
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in parts], pa.int32()), pa.array([salt % SALTS] * len(parts), pa.int32()),
         pa.array([at.astype(np.int32).tobytes() for _, at, _ in parts], pa.binary()),
         pa.array([value.astype(np.float64).tobytes() for _, _, value in parts], pa.binary())], schema=ARROW)


def summed(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(b"".join(table.column("at").to_pylist()), np.int32)
    value = np.frombuffer(b"".join(table.column("value").to_pylist()), np.float64).reshape(-1, columns)
    keys, inverse = np.unique(at, return_inverse=True)
    return keys, np.stack([np.bincount(inverse, value[:, k], len(keys)) for k in range(columns)], 1) if len(keys) else value


def add_up(partial: DataFrame, columns: int) -> DataFrame:
    """One row per ``part``: first the rows of a salt are added, then the sums of all salts, so a group stays small
    however many tasks sent rows."""

    def add(group: pa.Table) -> pa.Table:
        at, value = summed(group, columns)
        return pa.Table.from_batches([rows([(group.column("part")[0].as_py(), at, value)], 0)])

    return partial.groupBy("part", "salt").applyInArrow(lambda g: add(g), SCHEMA).groupBy("part").applyInArrow(lambda g: add(g), SCHEMA)


TASKS_AT_ONCE = 256  # partial sums that the driver adds up itself; more are added up in groups first


def dense_total(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of ``of(batches)``, an array of ``shape``, which must be bounded by the model.

    Arrays are added in the order of the tasks, so a rerun agrees. With few tasks this is one stage.
    """

    def run(batches):
        value = np.ascontiguousarray(of(batches), np.float64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "value": pa.array([value.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        total = sum((np.frombuffer(v, np.float64) for v in group.column("value").to_pylist()), np.zeros(int(np.prod(shape))))
        return pa.table({"part": group.column("part")[:1].combine_chunks(), "value": pa.array([total.tobytes()], pa.binary())})

    partial = df.mapInArrow(run, "part int, value binary")
    if df.rdd.getNumPartitions() > TASKS_AT_ONCE:
        partial = partial.groupBy(F.pmod("part", F.lit(TASKS_AT_ONCE))).applyInArrow(lambda g: add(g), "part int, value binary")
    found = partial.toArrow()
    return np.frombuffer(add(found).column("value")[0].as_py(), np.float64).reshape(shape) if found.num_rows else np.zeros(shape)


def collected(total: DataFrame, columns: int, parts: int, width: int) -> np.ndarray:
    """The sums as a dense array (parts, width, columns); its size is fixed by the model, not by the data."""
    out = np.zeros((parts, width, columns))
    for row in total.toLocalIterator():
        at = np.frombuffer(row["at"], np.int32)
        out[row["part"], at] = np.frombuffer(row["value"], np.float64).reshape(-1, columns)
    return out
