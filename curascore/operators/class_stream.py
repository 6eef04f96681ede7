"""Samples against class tables of any size: packed blocks of classes stream past chunks of samples.

The class table is packed into blocks that are written once. Samples are dealt into chunks of bounded size, and every
chunk gets all blocks: sorted by chunk, the samples of a chunk come first and the blocks follow, so a task holds one
chunk and one block at a time. Neither the driver nor the plan holds classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curascore.functions.vectors import dense_rows
from curascore.session import scratch_path
from curascore.settings import NORM_FLOOR

BLOCK_BYTES = 8 * 1024 * 1024  # weights in one block
CHUNK_BYTES = 64 * 1024 * 1024  # of what a task holds for one chunk of samples
CHUNK_ROWS = 100_000
OUT_ROWS = 4_096

_BLOCK = "_block long, _ids binary, _weights binary, _bias binary, _width int"


def packed_classes(table: DataFrame, vector: str, bias: str | None = None) -> DataFrame:
    """(class_id, vector, bias) as blocks of at most ``BLOCK_BYTES`` of weights, written once; no classes is an error.

    Ids need not be dense. A null vector or id, or a vector of another length than the others, is an error.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("class_id").null_count or batch.column("v").null_count:
                raise ValueError("a class without an id or a vector")
            width = len(batch.column("v")[0])
            _, weights = dense_rows(batch.column("v"), width)
            ids, shift = batch.column("class_id").to_numpy().astype(np.int64), batch.column("b").to_numpy().astype(np.float64)
            step = max(1, BLOCK_BYTES // (8 * max(1, width)))
            for a in range(0, len(ids), step):
                order = np.argsort(ids[a : a + step], kind="stable") + a
                yield pa.RecordBatch.from_pydict({
                    "_block": pa.array([int(ids[order[0]])], pa.int64()), "_ids": pa.array([ids[order].tobytes()], pa.binary()),
                    "_weights": pa.array([weights[order].tobytes()], pa.binary()), "_bias": pa.array([shift[order].tobytes()], pa.binary()),
                    "_width": pa.array([width], pa.int32())})

    spark = table.sparkSession
    path = scratch_path(spark, "classes")
    shift = F.col(bias).cast("double") if bias else F.lit(0.0)
    table.select("class_id", F.col(vector).alias("v"), shift.alias("b")).mapInArrow(pack, _BLOCK).write.parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


class _Chunk:
    """The samples of one chunk; rows that repeat are held once and counted."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []

    def add(self, part: pa.RecordBatch) -> None:
        h = part.column("_h").to_numpy()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for i in np.flatnonzero(~new).tolist():
            new[i] = not part.slice(i - 1, 1).equals(part.slice(i, 1))
        if self.parts and part.slice(0, 1).equals(self.parts[-1].slice(self.parts[-1].num_rows - 1, 1)):
            new[0] = False
        first = np.flatnonzero(new)
        before = int(first[0]) if len(first) else len(h)
        if before:
            self.counts[-1][-1] += before
        if len(first):
            self.parts.append(part.take(pa.array(first)))
            self.counts.append(np.diff([*first, len(h)]))

    def rows(self, features: str, unit: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
        found = [dense_rows(p.column(features), width) for p in self.parts]
        valid = np.concatenate([v for v, _ in found]) if found else np.zeros(0, bool)
        rows = np.concatenate([r for _, r in found]) if found else np.zeros((0, width))
        return valid, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), NORM_FLOOR) if unit else rows

    def out(self, names: list[str], made: Callable[[np.ndarray], list[pa.Array]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Every row as often as it came, its columns followed by ``made(places of the rows)``."""
        at = 0
        for part, counts in zip(self.parts, self.counts, strict=True):
            every = np.repeat(np.arange(part.num_rows), counts)
            for a in range(0, len(every), OUT_ROWS):
                here = every[a : a + OUT_ROWS]
                kept = part.take(pa.array(here))
                yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), *made(here + at)], schema=schema)
            at += part.num_rows


class Best:
    """The best class of each row, scores rounded before they are compared; ties go to the lowest id."""

    fields = [T.StructField("score", T.DoubleType()), T.StructField("y_pred", T.IntegerType())]

    def __init__(self, decimals: int = 6):
        self.decimals = decimals

    def begin(self, n: int) -> None:
        self.score, self.id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, self.decimals)
        at = scores.argmax(1)
        best, found = scores[np.arange(len(at)), at], ids[at]
        better = (best > self.score) | ((best == self.score) & (found < self.id))
        self.score, self.id = np.where(better, best, self.score), np.where(better, found, self.id)

    def columns(self, at: np.ndarray, ok: np.ndarray) -> list[pa.Array]:
        """Results of the rows ``at``; those that are not ``ok`` have none."""
        return [pa.array(np.where(ok, self.score[at], 0), mask=~ok), pa.array(np.where(ok, self.id[at], 0).astype(np.int32), mask=~ok)]


class All:
    """All scores of each row as one array by id; the ids must be 0..n-1."""

    def __init__(self, n: int, name: str):
        self.n, self.fields = n, [T.StructField(name, T.ArrayType(T.DoubleType()))]

    def begin(self, n: int) -> None:
        self.scores = np.full((n, self.n), np.nan)

    def see(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if ids[0] < 0 or ids[-1] >= self.n:
            raise ValueError(f"class ids must be 0..{self.n - 1}, found {ids[0]}..{ids[-1]}")
        self.scores[:, ids] = scores

    def columns(self, at: np.ndarray, ok: np.ndarray) -> list[pa.Array]:
        return [pa.array([row.tolist() if fine else None for row, fine in zip(self.scores[at], ok, strict=True)], pa.list_(pa.float64()))]


class PerBlock:
    """A row per sample and block: the block's ids and scores as arrays."""

    fields = [T.StructField("class_ids", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType()))]

    def begin(self, n: int) -> None:
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros((n, 0))

    def see(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.ids, self.scores = ids, scores

    def columns(self, at: np.ndarray, ok: np.ndarray) -> list[pa.Array]:
        ids = self.ids.tolist()
        return [pa.array([ids if fine else None for fine in ok], pa.list_(pa.int32())),
                pa.array([row.tolist() if fine else None for row, fine in zip(self.scores[at], ok, strict=True)], pa.list_(pa.float64()))]


def past_chunks(rows: DataFrame, blocks: DataFrame, chunks: int, by: str) -> DataFrame:
    """Rows, dealt into chunks by the hash column ``by``, each chunk followed by all ``blocks``, in one sorted frame."""
    dealt = rows.withColumn("_chunk", F.pmod(by, F.lit(chunks)).cast("int")).withColumn("_kind", F.lit(0))
    copies = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_kind", F.lit(1))
    return dealt.unionByName(copies, allowMissingColumns=True).repartition("_chunk").sortWithinPartitions("_chunk", "_kind", by, "_block")


def chunk_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """The parts of such a frame that belong to one chunk and are all rows or all blocks, in order."""
    for batch in batches:
        if batch.num_rows:
            which, kind = batch.column("_chunk").to_numpy(), batch.column("_kind").to_numpy()
            edges = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                yield int(which[a]), bool(kind[a]), batch.slice(a, b - a)


def against_classes(df: DataFrame, blocks: DataFrame, take: Best | All | PerBlock, features: str = "features", unit: bool = False,
                    keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of every row of ``df`` and what ``take`` makes of its scores with all classes.

    ``blocks`` come from ``packed_classes``. A null vector gives null results; one of another width than the classes
    is an error. No classes is an error as well, no rows give no rows. Map columns cannot be kept.
    """
    names = keep if keep is not None else df.columns
    shape = blocks.agg(F.max("_width").alias("width"), F.min("_width").alias("least"), F.count("*").alias("n")).first()
    if not shape["n"]:
        raise ValueError("no classes to score against")
    if shape["least"] != shape["width"]:
        raise ValueError(f"classes have vectors of {shape['least']} and {shape['width']} elements")
    width, held = shape["width"], take.n if isinstance(take, All) else 0
    chunks = max(1, -(-df.count() // max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * (width + held))))))
    plain = df.select(*(F.col(n).alias(f"_c{i}") for i, n in enumerate(names)), F.col(features).alias("_f"))
    packed = [f"_c{i}" for i in range(len(names))]
    both = past_chunks(plain.withColumn("_h", F.xxhash64(*packed, "_f")), blocks, chunks, "_h")
    schema = T.StructType([*(T.StructField(p, f.dataType) for p, f in zip(packed, plain.schema.fields, strict=False)), *take.fields])
    every_block = isinstance(take, PerBlock)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, chunk, rows, valid = to_arrow_schema(schema), None, _Chunk(), None, None

        def results() -> Iterator[pa.RecordBatch]:
            place = np.cumsum(valid) - 1
            yield from chunk.out(packed, lambda at: take.columns(np.where(valid[at], place[at], 0) if valid.any() else at * 0, valid[at]), arrow)

        for which, is_block, part in chunk_parts(batches):
            if which != now:
                if rows is not None and not every_block:
                    yield from results()
                now, chunk, rows = which, _Chunk(), None
            if not is_block:
                chunk.add(part)
                continue
            if not chunk.parts:
                continue
            if rows is None:
                valid, rows = chunk.rows("_f", unit, width)
                take.begin(max(1, len(rows)))
            for ids, weights, bias in zip(part.column("_ids"), part.column("_weights"), part.column("_bias"), strict=True):
                ids = np.frombuffer(ids.as_py(), np.int64)
                scores = rows @ np.frombuffer(weights.as_py(), np.float64).reshape(-1, width).T + np.frombuffer(bias.as_py(), np.float64)
                if len(rows):
                    take.see(ids, scores)
                if every_block:
                    yield from results()
        if rows is not None and not every_block:
            yield from results()

    return both.mapInArrow(run, schema).toDF(*names, *(f.name for f in take.fields))


def array_scores(ids: Column | str, scores: Column | str) -> Column:
    """The two arrays of a block as an array of structs (class_id, score)."""
    return F.arrays_zip(F.col(ids).alias("class_id") if isinstance(ids, str) else ids.alias("class_id"),
                        F.col(scores).alias("score") if isinstance(scores, str) else scores.alias("score"))
