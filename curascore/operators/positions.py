"""Explicit row positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.session import scratch_path

SAMPLE_KEYS, CUTS = 4_096, 64  # keys that place the cuts of a selection by rank, and the ranges between them
SORT_ROWS = 50_000  # a range of a selection that one task may sort
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in its low 33 bits


def _staged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in a range-partitioned order, written once, with ``_part`` and the ``_row`` within it.

    Writing makes the count pass and the numbering pass see one layout.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", _ROW_BITS).cast("int"))
        .withColumn("_row", F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1))
        .write.parquet(path)
    )
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def positions(df: DataFrame, order: list[Column | str], name: str = "pos", row_id: str | None = None) -> DataFrame:
    """Global 0-based position in ``order``, which must be a total order (end it with a unique id).

    Range-partitioned sort; offsets are a running sum over one row per partition. With ``row_id``, the name of a column
    that is unique, only the order columns (given by name) and the id are sorted and written, and the other columns join
    by the id afterwards: they are shuffled once, and neither sorted nor written.
    """
    if row_id is None:
        return _numbered(df, order, name).select(*df.columns, name)
    keys = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(row_id).alias("_id"))
    places = _numbered(keys, [f"_o{i}" for i in range(len(order))], "_pos").select("_id", "_pos")
    joined = df.join(places.hint("shuffle_hash"), F.col(row_id).eqNullSafe(F.col("_id")))
    return joined.select(*[F.col(c) for c in df.columns], F.col("_pos").alias(name))


def _numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    staged = _staged(df, order)
    # One row per partition of the sort: bounded by the shuffle width, not by the data.
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return lookup_join(staged, bounded(offsets, max_rows=1_000_000), "_part").withColumn(name, F.col("_offset") + F.col("_row"))


def segmented_positions(df: DataFrame, segment: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position in ``order`` within each segment, without one task per segment.

    The rows are range-partitioned by segment and order, so a large segment spans partitions. Each partition counts its
    rows by segment, and one running sum per segment over these counts tells where its rows begin there. ``order`` must
    be total within a segment. Null segments are one segment.
    """
    staged = _staged(df, [*segment, *order])
    keys = [f"_s{i}" for i in range(len(segment))]
    named = staged.select("*", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")).alias(k) for c, k in zip(segment, keys, strict=True)])
    # One row per partition and segment in it: at most the partitions and the segments together.
    sizes = named.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return lookup_join(named, starts, ["_part", *keys]).withColumn(name, F.col("_offset") + F.col("_row")).select(*df.columns, name)


def rank_range(df: DataFrame, order: list[str], start: int, end: int, name: str = "pos") -> DataFrame:
    """Rows whose 0-based position in ``order`` lies in [start, end), with that position; nothing else is sorted.

    A sample of keys cuts the rows into ranges, which are counted; only those that the wanted positions fall into stay,
    and are cut again while they are many. What is left is sorted and numbered from the count of all rows before it.
    ``order`` names columns of a total order, ascending with nulls first.
    """
    df = df.select("*", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("_key"))
    kind = df.schema["_key"].dataType
    as_key = lambda row: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind, strict=True)])
    inside, skipped = df, 0
    while True:
        sample = [r["_key"] for r in inside.select("_key", F.xxhash64("_key").alias("_h")).orderBy("_h").limit(SAMPLE_KEYS).select("_key").distinct().orderBy("_key").collect()]
        cuts = sorted({len(sample) * i // CUTS for i in range(1, CUTS)}) if len(sample) > 1 else []
        if not cuts:
            break
        bounds = F.array(*[as_key(sample[c]) for c in cuts])
        place = F.size(F.filter(bounds, lambda b: b < F.col("_key")))
        counts = dict(inside.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect())
        edges, total = [], skipped
        for p in range(len(cuts) + 1):
            edges.append((p, total, total + counts.get(p, 0)))
            total += counts.get(p, 0)
        hit = [(p, a, b) for p, a, b in edges if a < end and b > start]
        if not hit:
            return df.where(F.lit(False)).withColumn(name, F.lit(0).cast("long")).drop("_key")
        kept = sum(b - a for _, a, b in hit)
        everything = kept == total - skipped
        first, last = hit[0][0], hit[-1][0]
        if first > 0:
            inside = inside.where(F.col("_key") > as_key(sample[cuts[first - 1]]))
        if last < len(cuts):
            inside = inside.where(F.col("_key") <= as_key(sample[cuts[last]]))
        skipped = hit[0][1]
        if everything or kept <= max(SORT_ROWS, 2 * (end - start)):
            break
    table = bounded(inside.drop("_key"), max_rows=SORT_ROWS)
    if table.is_small:
        numbered = table.frame.withColumn(name, (F.row_number().over(Window.orderBy(*[F.asc_nulls_first(c) for c in order])) - 1 + skipped).cast("long"))
    else:
        numbered = _numbered(table.frame, list(order), name).withColumn(name, F.col(name) + skipped).select(*table.frame.columns, name)
    return slice_by_position(numbered, start, end, name)


def slice_by_position(df: DataFrame, start: int, end: int, pos: str = "pos") -> DataFrame:
    """Rows in the half-open range [start, end)."""
    return df.where((F.col(pos) >= start) & (F.col(pos) < end))


def row_at(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) == k)


def build_block_index(df: DataFrame, keys: tuple[str, ...] = ("split", "crop", "disease"), pos: str = "pos",
                      end_inclusive: bool = False) -> DataFrame:
    """Start and end position per class block, with a flag telling whether the block is contiguous.

    ``end_inclusive`` writes the position of the last row as the end, as the published index does.
    """
    last = F.max(pos) if end_inclusive else F.max(pos) + 1
    return df.groupBy(*keys).agg(
        F.min(pos).alias("start_pos"),
        last.alias("end_pos"),
        (F.max(pos) - F.min(pos) + 1 == F.count(F.lit(1))).alias("is_contiguous"),
    )


def split_positions(df: DataFrame, split: str = "split", pos: str = "pos") -> DataFrame:
    """Positions that restart at 0 in each split, from global positions ordered by split first."""
    starts = df.groupBy(split).agg(F.min(pos).alias("_first"))
    return lookup_join(df, starts, split).withColumn(pos, F.col(pos) - F.col("_first")).select(*df.columns)


def assign_blocks(df: DataFrame, index: DataFrame | Dimension, split: str = "split", pos: str = "pos",
                  width: int | None = None) -> DataFrame:
    """Tag each row with the block of its split whose [start_pos, end_pos) holds its position.

    The range join is an equi-join on position buckets with the range as residual: each block is listed under
    every bucket it touches. With buckets as wide as the mean block (the default) that is about twice the index,
    and a row meets one or two candidates. The index is broadcast when proven small; otherwise rows shuffle by
    (split, bucket), which holds at most ``width`` of them since positions are unique in a split.
    """
    table = bounded(index)
    if width is None:
        span = table.frame.agg(F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean")).first()["mean"]
        width = max(1, int(span or 1))
    blocks = table.frame.withColumnRenamed(split, "_split").withColumn(
        "_bucket",
        F.explode(F.sequence(F.expr(f"start_pos div {width}"), F.expr(f"greatest(start_pos, end_pos - 1) div {width}"))),
    )
    hit = (
        (F.col(split) == F.col("_split")) & (F.expr(f"`{pos}` div {width}") == F.col("_bucket"))
        & (F.col(pos) >= F.col("start_pos")) & (F.col(pos) < F.col("end_pos"))
    )
    return df.join(F.broadcast(blocks) if table.is_small else blocks, hit, "inner").drop("_split", "_bucket")


def assign_batches(df: DataFrame, size: int, pos: str = "pos", name: str = "batch") -> DataFrame:
    """Fixed-size batches in position order."""
    return df.withColumn(name, F.floor(F.col(pos) / size).cast("bigint"))
