"""Nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Every block of vectors posts its rows in one inverted file per
pivot, with the pivot's place in the row's order. A query walks the files of its own nearest pivots and adds up the
footrule distance; the best share of the block is reranked by exact inner products. Blocks of vectors meet blocks of
queries one pair at a time, so a task holds one of each whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table

PIVOTS = 256
PLACES = 64  # nearest pivots that represent a vector
SHARE = 0.4  # of a block that is reranked
LEAST = 256  # rows of a block that are reranked at least
ROWS, QUERIES = 8_192, 2_048  # in a block
NEAREST, STEP = 20, 20


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of rows that take part: an id, and finite components that are not all zero, none null."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), v.alias("v")).where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def pivots(rows: DataFrame, n: int, count: int) -> np.ndarray:
    """Distinct vectors with small hashes, as unit vectors; the sample they come from is about eight times as large."""
    share = min(1.0, 8 * count / max(n, 1))
    h = F.xxhash64("v")
    drawn = rows.where(F.pmod(h, F.lit(1_000_000)) < F.lit(share) * 1_000_000).groupBy(h.alias("h")).agg(F.first("v").alias("v"))
    made = np.array([r["v"] for r in drawn.orderBy("h").limit(count).collect()])
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def orders(x: np.ndarray, points: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row in order; equally near ones by number."""
    return np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :places]


class InvertedFiles:
    """For each pivot the rows of a block that have it among their nearest, with its place."""

    def __init__(self, order: np.ndarray, count: int):
        self.rows_n, self.places = order.shape
        pivot = order.ravel()
        by = np.argsort(pivot, kind="stable")
        self.row = (by // self.places).astype(np.int64)
        self.place = (by % self.places).astype(np.int32)
        self.edge = np.searchsorted(pivot[by], np.arange(count + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of each row to a query's order; a pivot that a row does not have counts as one place too far."""
        total = np.zeros(self.rows_n, np.int32)
        for j, pivot in enumerate(order.tolist()):
            a, b = self.edge[pivot], self.edge[pivot + 1]
            total[self.row[a:b]] += np.abs(self.place[a:b] - j) - self.places
        return total


def _search(vectors: pa.Table, queries: pa.Table, points: np.ndarray, places: int, share: float, least: int, nearest: int) -> pa.Table:
    dense = lambda t: (t.column("vec_id").to_numpy(), np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1))
    out: tuple[list, list, list] = ([], [], [])
    if vectors.num_rows and queries.num_rows:
        ids, x = dense(vectors)
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        files = InvertedFiles(orders(x, points, places), len(points))
        names, q = dense(queries)
        many = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
        place = np.arange(len(ids))
        for name, one, order in zip(names.tolist(), q, orders(q, points, places), strict=True):
            key = files.footrule(order).astype(np.int64) * len(ids) + place
            found = np.sort(np.argpartition(key, many - 1)[:many]) if many < len(ids) else place
            found = found[ids[found] != name]
            if len(found) > nearest:
                rough = x[found] @ one
                bar = np.partition(rough, -nearest)[-nearest]
                found = found[rough >= bar - 1e-9 * max(1.0, abs(bar))]
            score = (x[found] * one).sum(1)
            best = np.lexsort((ids[found], -score))[:nearest]
            for column, value in zip(out, (np.full(len(best), name), ids[found][best], score[best]), strict=True):
                column.append(value)
    cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})


def nearest_neighbours(vectors: DataFrame, is_query, nearest: int = NEAREST, count: int = PIVOTS, places: int = PLACES,
                       share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows of ``vectors(vec_id, embedding)`` found for each query.

    Nearness is the inner product in double precision, ties go to the smaller id. A query's candidates are the rows
    with another id. Rows with a null id take no part, nor do vectors that are null, empty, zero, or hold null or
    non-finite components, nor those of another length than most have. Rows with equal ids and vectors are one.
    No rows or no queries give no rows. Other columns of ``vectors`` are not looked at.
    """
    rows = stored(usable(vectors).distinct(), "vectors")
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    if not m:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = pivots(rows, n, count)
    places = min(places, max(1, len(points) // 2))
    vb, qb = -(-n // ROWS), -(-m // QUERIES)
    block = lambda k, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select("vec_id", "v", block(vb, 1).alias("vb"), each(qb).alias("qb")).groupBy("vb", "qb")
    right = asked.select("vec_id", "v", block(qb, 2).alias("qb"), each(vb).alias("vb")).groupBy("vb", "qb")
    found = left.cogroup(right).applyInArrow(lambda x, y: _search(x, y, points, places, share, least, nearest), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % STEP == 0)
