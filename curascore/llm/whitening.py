"""Whitening of embeddings by leading principal components, found with a block Jacobi-Davidson method.

Entries become integers, and the distinct vectors are written once as packed blocks of rows. Their covariance is never
formed: each step needs products of it with a few columns at once, and such a product is one pass over the blocks in
which every task centres its rows exactly, multiplies and adds up. The driver holds only what the model holds: columns
as long as a vector, as many as the search space is wide.

Each outer step takes Ritz pairs from the search space, locks the leading ones whose residual has reached double
precision, and solves the projected correction equation of the others by a few MINRES steps, all columns in the same
passes. The corrections widen the search space, which is cut back to its leading Ritz vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curascore.llm.base import query, stored, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
GUARD = 4  # Ritz pairs beyond the wanted ones that are improved along with them
WIDTH = 5  # times the block: the search space before it is cut back
INNER = 6  # MINRES steps of a correction equation, at most
OUTER = 60
BLOCK_VALUES = 1 << 17  # entries in a packed block
TASKS_AT_ONCE = 256  # partial sums that the driver adds up itself; more are added up in groups first
_EPS = np.finfo(np.float64).eps

_PACKED = "rows int, x binary"
_PARTIAL = pa.schema([("part", pa.int32()), ("value", pa.binary())])


def usable(vectors: DataFrame, column: str = "embedding") -> Column:
    """Whether a vector has entries, none of them null or not finite."""
    v = F.col(column).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def as_integers(column: str = "embedding") -> Column:
    return F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Fit:
    """The distinct integer vectors in packed blocks, their number ``n`` and sums ``s``, and products with them."""

    def __init__(self, distinct: DataFrame, d: int):
        def pack(batches):
            step = max(1, BLOCK_VALUES // d)
            for batch in batches:
                x = _matrix(batch.column("x"), d)
                for at in range(0, len(x), step):
                    part = np.ascontiguousarray(x[at : at + step], np.int64)
                    yield pa.RecordBatch.from_pydict({"rows": pa.array([len(part)], pa.int32()), "x": pa.array([part.tobytes()], pa.binary())})

        self.d, self.n, self.s = d, 0, np.zeros(d, np.int64)
        self.blocks = stored(distinct.select("x").mapInArrow(pack, _PACKED), "fit")
        self.trace = 0.0  # of the covariance, from exact integers
        counted = self._count()
        if counted:
            self.n, self.s = counted[0]["n"], np.array([r["s"] for r in counted], np.int64)
            self.trace = (self.n * int(counted[0]["q"]) - sum(int(v) ** 2 for v in self.s)) / self.n**2

    def _count(self) -> list:
        """Per dimension ``n``, the sum ``s`` and the sum ``q`` of all squares, in integers: nothing is rounded."""
        d = self.d

        def run(batches):
            n, s, q = 0, np.zeros(d, np.int64), 0
            for batch in batches:
                for packed in batch.column("x").to_pylist():
                    x = np.frombuffer(packed, np.int64).reshape(-1, d)
                    n, s = n + len(x), s + x.sum(0)
                    small = int(np.abs(x).max()) ** 2 * x.size < 1 << 63
                    q += int((x * x).sum()) if small else sum(int(v) ** 2 for v in x.ravel())
            if n:
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.int64())), "q": pa.array([q], pa.decimal128(38, 0))})

        each = self.blocks.mapInArrow(run, "n long, s array<long>, q decimal(38,0)").select("n", "q", F.posexplode("s").alias("i", "s"))
        return each.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``of(centred block)`` over all blocks, in a fixed order of tasks."""
        d, n, s = self.d, self.n, self.s

        def run(batches):
            from pyspark import TaskContext

            out = np.zeros(shape)
            for batch in batches:
                for x in batch.column("x").to_pylist():
                    out += of((n * np.frombuffer(x, np.int64).reshape(-1, d) - s) / n)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], schema=_PARTIAL)

        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("part")
            out = sum((np.frombuffer(v, np.float64) for v in group.column("value").to_pylist()), np.zeros(int(np.prod(shape))))
            return pa.Table.from_arrays([group.column("part")[:1].combine_chunks(), pa.array([out.tobytes()], pa.binary())], schema=_PARTIAL)

        partial = self.blocks.mapInArrow(run, "part int, value binary")
        if self.blocks.rdd.getNumPartitions() > TASKS_AT_ONCE:
            partial = partial.groupBy(F.pmod("part", F.lit(TASKS_AT_ONCE))).applyInArrow(lambda g: add(g), "part int, value binary")
        return np.frombuffer(add(partial.toArrow()).column("value")[0].as_py(), np.float64).reshape(shape)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns, without the covariance: one pass."""
        return self.total(lambda z: z.T @ (z @ columns), columns.shape) / self.n


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` orthogonal to ``against``; those that nearly vanish are left out."""
    kept = np.zeros((len(new), 0))
    for v in new.T:
        before = np.linalg.norm(v)
        if before == 0 or not np.isfinite(before):
            continue
        v = v / before
        for _ in range(3):
            for q in (*against, kept):
                v = v - q @ (q.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-10:
            kept = np.column_stack([kept, v / size])
    return kept


def _minres(product: Callable, shifts: np.ndarray, right: np.ndarray, basis: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """For every column i, some MINRES steps on ``P (V - shift_i) P t = right_i`` with ``P`` away from ``basis``.

    All columns share a pass per step. A column stops when its own residual has shrunk by ``tolerance``.
    """
    away = lambda y: y - basis @ (basis.T @ y)
    y = away(right)
    beta = np.linalg.norm(y, axis=0)
    start, phibar, active = beta.copy(), beta.copy(), beta > 0
    v, v_old, x, w, w_old = y / np.where(active, beta, 1), np.zeros_like(y), np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    beta, cs, sn, dbar, epsilon = np.zeros_like(beta), -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if not active.any():
            break
        y = np.zeros_like(v)
        y[:, active] = away(product(v[:, active]) - shifts[active] * v[:, active])
        alpha = (v * y).sum(0)
        y = away(y - alpha * v - beta * v_old)
        beta = np.linalg.norm(y, axis=0)
        # One rotation of each column's tridiagonal matrix.
        delta, gbar, before = cs * dbar + sn * alpha, sn * dbar - cs * alpha, epsilon
        epsilon, dbar = sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        active &= gamma > 0
        safe = np.where(gamma > 0, gamma, 1)
        cs, sn = gbar / safe, beta / safe
        w, w_old = (v - before * w_old - delta * w) / safe, w
        x = x + np.where(active, cs * phibar, 0) * w
        phibar = sn * phibar
        active &= (np.abs(phibar) > tolerance * start) & (beta > 0)
        v_old, v = v, y / np.where(beta > 0, beta, 1)
    return x


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, trace: float, outer: int = OUTER, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and their unit vectors of a symmetric operator given by its products.

    A pair is locked, leading ones first, when its residual is below ``16 eps`` times the root of ``d`` times the
    largest eigenvalue, which is what products in double precision can resolve.
    """
    k = min(k, d)
    block = min(d, k + GUARD)
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(d, block)))
    image = product(basis)
    locked, values = np.zeros((d, 0)), []
    scale = trace / d
    for step in range(outer):
        small = basis.T @ image
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        basis, image = basis @ u, image @ u
        if not values:
            scale = max(scale, theta[0])
        bar = 16 * _EPS * np.sqrt(d) * scale
        residual = image[:, :block] - basis[:, :block] * theta[:block]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        full = basis.shape[1] + locked.shape[1] == d
        done = 0
        while len(values) + done < k and done < len(size) and (size[done] <= bar or (full and step and size[done] <= 64 * bar)):
            done += 1
        locked, values = np.column_stack([locked, basis[:, :done]]), [*values, *theta[:done]]
        if len(values) == k:
            # Locked pairs of nearly equal values may have come out of order.
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        theta, basis, image, residual, size = theta[done:], basis[:, done:], image[:, done:], residual[:, done:], size[done:]
        if basis.shape[1] == 0 or full and not done:
            # Nothing is left to add: start the rest again from exact images.
            basis = _orthonormal(basis if basis.shape[1] else np.random.default_rng(seed + step + 1).normal(size=(d, block)), locked)
            image = product(basis)
            continue
        wanted = min(k - len(values) + GUARD, len(size))
        if basis.shape[1] + wanted > WIDTH * block:
            keep = min(basis.shape[1], max(block, 2 * wanted))
            basis, image, theta = basis[:, :keep], image[:, :keep], theta[:keep]
        near = np.column_stack([locked, basis[:, :wanted]])
        right = -residual[:, :wanted]
        move = _minres(product, theta[:wanted], right, near, INNER, 2.0 ** -(step + 2))
        # A residual itself is a direction as well where the inner steps brought nothing.
        fresh = _orthonormal(np.where(np.linalg.norm(move, axis=0) > 0, move, right), locked, basis)
        room = d - locked.shape[1] - basis.shape[1]
        fresh = fresh[:, :room]
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + step + 1).normal(size=(d, min(block, room))), locked, basis) if room else fresh
        if fresh.shape[1]:
            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    raise RuntimeError(f"{len(values)} of {k} components reached double precision in {outer} steps")


def whiten(vectors: DataFrame, k: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per row with a usable vector and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; vectors of different lengths are
    an error. Components are learned from the distinct integer vectors, each once; rows that repeat, in vector or in
    ``key`` (null ones too), each get their own results. Only components of an eigenvalue above rounding are
    returned: ``k`` of them, or fewer where the vectors span less, and no rows where all vectors are equal or there are
    none. An entry too large for a 64-bit integer, or a deviation beyond one, is an error. Other columns, whatever their
    names, are not looked at.
    """
    rows = vectors.where(usable(vectors, column)).select(F.col(key).alias("id"), as_integers(column).alias("x"))
    sizes = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().limit(3).collect())
    if len(sizes) > 1:
        raise ValueError(f"vectors have different lengths: {sizes}")
    out = StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    schema = StructType([*rows.select(F.col("id").alias(key)).schema.fields, *out.fields])
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]
    fit = Fit(rows.select("x").distinct(), d)
    values, axes = jacobi_davidson(fit.product, d, k, fit.trace) if fit.trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    fine = values > d * 16 * _EPS * fit.trace
    values, axes = values[fine], axes[:, fine]
    if not len(values):
        return spark.createDataFrame([], schema)
    # The sign is free; the largest entry of a component is positive, so that a rerun agrees.
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    project = axes / np.sqrt(values)
    k = len(values)

    def moments(z: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(z)), z @ project])
        return w.T @ w

    m = fit.total(moments, (k + 1, k + 1)) / fit.n
    error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max())
    explained = values / fit.trace
    n, s = fit.n, fit.s
    fits = n * n * d * (1 << 40) < 1 << 63  # squares of differences below 2^20 surely stay in 64 bits

    def results(batches):
        names = [f.name for f in schema.fields]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d).astype(np.int64)
            diff = n * x - s
            small = fits and np.abs(diff).max() < n << 20
            deviation = (diff * diff).sum(1).tolist() if small else [int(v) for v in (diff.astype(object) ** 2).sum(1)]
            w = (diff / n) @ project
            at = np.repeat(np.arange(batch.num_rows), k)
            made = [batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(at), n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array(w.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return rows.mapInArrow(results, schema)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
