"""Seeded sampling and the balanced downsampling rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curascore.functions.hashing import key_below, salt_of, seed_key
from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.operators.positions import positions
from curascore.session import scratch_path
from curascore.settings import CURATION_SEED, OVER_MARGIN, REVIEW_MARGIN, SPLIT_TARGETS, UNDER_MARGIN

CLASS_KEYS = ["split", "crop", "disease"]
SALTS = 64
# Rows ranked beyond the quota: this many standard deviations of a group's candidate count, and a few more.
MARGIN_SIGMAS = 10
MARGIN_ROWS = 50


def seeded_shuffle(df: DataFrame, seed: int, row_id: str = "sample_id", name: str = "pos") -> DataFrame:
    """Reproducible random order, as an explicit position."""
    keyed = df.withColumn("_key", seed_key(seed, row_id))
    return positions(keyed, ["_key", row_id], name, row_id=row_id).drop("_key")


def first_n(df: DataFrame, n: int, seed: int, row_id: str = "sample_id", name: str = "pos") -> DataFrame:
    """The first ``n`` rows of the seeded order (a top-n per partition, then a merge)."""
    top = df.withColumn("_key", seed_key(seed, row_id)).orderBy("_key", row_id).limit(n)
    rank = F.row_number().over(Window.orderBy("_key", row_id))  # over n rows
    return top.withColumn(name, (rank - 1).cast("bigint")).drop("_key")


def top_per_group(df: DataFrame, n: int, keys: list[str], order: list[Column | str], row_id: str,
                  salts: int = SALTS, name: str = "rn") -> DataFrame:
    """Rank 1..n per group, in two exact rounds.

    The first round ranks inside (group, salt), so a group that holds a third of all rows is cut down by
    ``salts`` tasks (each task also drops rows past rank n before it shuffles); the second sees at most
    ``salts * n`` rows per group.
    """
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_salt", salt_of(row_id, salts))
        .withColumn(name, F.row_number().over(inner))
        .where(F.col(name) <= n)
        .drop("_salt", name)
    )
    return cut.withColumn(name, F.row_number().over(outer)).where(F.col(name) <= n)


def sample_by_quota(df: DataFrame, quotas: Dimension, keys: list[str], seed: int = CURATION_SEED,
                    row_id: str = "sample_id") -> DataFrame:
    """Per group the first ``quota`` rows of the seeded order; ``quotas`` is a proven small (keys, n_rows, quota).

    Keys of the order are uniform, so the wanted rows lie below a share of the hash range that follows from the
    group sizes. Only rows below that share, with a wide margin, are ranked: a group of any size is cut to about
    its quota where it is read, without a sort or shuffle of the rest. The candidates are written once; a group
    left short of its quota (practically never) is ranked in full instead, so the result is exact.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", seed_key(seed, row_id))
    share = (F.col("quota") + MARGIN_SIGMAS * F.sqrt(F.col("quota")) + MARGIN_ROWS) / F.col("n_rows")
    sized = quotas.frame.where((F.col("quota") > 0) & (F.col("n_rows") > 0)).select(
        *[F.col(k).alias(f"_q_{k}") for k in keys], "n_rows", "quota", key_below(share).alias("_below"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys])
    near = keyed.join(F.broadcast(sized), same).where(F.col("_key") < F.col("_below"))
    path = scratch_path(spark, "candidates")
    near = near.select(*df.columns, "_key", F.least("quota", "n_rows").alias("_quota"))
    near.write.parquet(path)
    stored = spark.read.schema(near.schema).parquet(path)

    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_key", row_id))
        return rows.withColumn("_rn", rank).where(F.col("_rn") <= F.col("_quota")).select(*df.columns)

    found = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_found"))
    short = (
        sized.join(F.broadcast(found), same, "left")
        .where(F.coalesce("_found", F.lit(0)) < F.least("quota", "n_rows"))
        .select(*[f"_q_{k}" for k in keys], F.least("quota", "n_rows").alias("_quota"))
    )
    missing = bounded(short, max_rows=max(1, quotas.rows.num_rows))
    if not missing.rows.num_rows:
        return ranked(stored)
    whole = stored.join(F.broadcast(missing.frame.drop("_quota")), same, "left_anti")
    redo = keyed.join(F.broadcast(missing.frame), same).select(*df.columns, "_key", "_quota")
    most = missing.frame.agg(F.max("_quota").alias("m")).first()["m"]
    return ranked(whole).unionByName(ranked(top_per_group(redo, most, keys, ["_key", row_id], row_id).drop("rn")))


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = CURATION_SEED, row_id: str = "sample_id") -> DataFrame:
    """``n`` random rows per group; a smaller group is kept whole."""
    sizes = bounded(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n).cast("bigint").alias("quota")))
    if sizes.is_small:
        return sample_by_quota(df, sizes, keys, seed, row_id)
    keyed = df.withColumn("_key", seed_key(seed, row_id))
    return top_per_group(keyed, n, keys, ["_key", row_id], row_id).drop("_key", "rn")


def source_balance(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, lab and field rows per class and split."""
    return df.groupBy(*(keys or CLASS_KEYS)).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("source") == "lab").alias("n_lab"),
        F.count_if(F.col("source") == "field").alias("n_field"),
    )


def _by_split(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for split, value in values.items():
        out = F.when(F.col("split") == split, F.lit(value)).otherwise(out)
    return out


def balance_case(counts: DataFrame, targets: dict[str, int] = SPLIT_TARGETS, under: int = UNDER_MARGIN,
                 over: int = OVER_MARGIN, review: int = REVIEW_MARGIN) -> DataFrame:
    """Add the balance case and the rows to keep per source; the first matching case wins.

    Case 3 cannot be reached, because case 2L matches whenever its condition holds; it stays in the order.
    """
    total, lab, field = F.col("n_total"), F.col("n_lab"), F.col("n_field")
    target, half = F.col("_target"), F.col("_half")
    single = (lab == 0) | (field == 0)
    case = (
        F.when(single & (total <= target - under), "1A")
        .when(single & (total < target + over), "1B")
        .when(single, "1C")
        .when((lab < half) & (total < target), "2LA")
        .when(lab < half, "2LB")
        .when((field < half) & (total < target), "2FA")
        .when(field < half, "2FB")
        .when((lab < half - review) & (field < half - review), "3")
        .otherwise("4")
    )
    quota_lab = (
        F.when((F.col("balance_case") == "1C") & (lab > 0), target)
        .when(F.col("balance_case") == "2FB", target - field)
        .when(F.col("balance_case") == "4", half)
        .otherwise(lab)
    )
    quota_field = (
        F.when((F.col("balance_case") == "1C") & (field > 0), target)
        .when(F.col("balance_case") == "2LB", target - lab)
        .when(F.col("balance_case") == "4", half)
        .otherwise(field)
    )
    return (
        counts.withColumn("_target", _by_split(targets))
        .withColumn("_half", _by_split({s: t // 2 for s, t in targets.items()}))
        .where(target.isNotNull())
        .withColumn("balance_case", case)
        .withColumn("quota_lab", quota_lab.cast("bigint"))
        .withColumn("quota_field", quota_field.cast("bigint"))
        .drop("_target", "_half")
    )


def flagged_groups(cases: DataFrame) -> DataFrame:
    """Groups to review, with the reason, in one schema for both reasons."""
    return cases.where(F.col("balance_case").isin("1A", "3")).select(
        *CLASS_KEYS,
        F.when((F.col("n_lab") > 0) & (F.col("n_field") > 0), "both").when(F.col("n_field") == 0, "lab")
        .otherwise("field").alias("source"),
        "n_total",
        F.when(F.col("balance_case") == "3", "CASE 3").otherwise("CASE 1").alias("reason"),
    )


def balanced_downsample(df: DataFrame, targets: dict[str, int] = SPLIT_TARGETS, seed: int = CURATION_SEED,
                        row_id: str = "sample_id", under: int = UNDER_MARGIN, over: int = OVER_MARGIN,
                        cases: DataFrame | Dimension | None = None) -> DataFrame:
    """The whole curation policy; result keeps the input columns and adds ``balance_case``.

    One pass counts the groups, a second one keeps candidates by hash. Every quota is below ``max(target) + over``
    by the rule itself (a group is kept whole only below that), so what is ranked depends on the classes only.
    """
    table = bounded(cases if cases is not None else balance_case(source_balance(df), targets, under, over))
    inside = df.where(F.col("split").isin(*targets))
    keys = [*CLASS_KEYS, "source"]
    per_source = F.array(
        F.struct(F.lit("lab").alias("source"), F.col("n_lab").alias("n_rows"), F.col("quota_lab").alias("quota")),
        F.struct(F.lit("field").alias("source"), F.col("n_field").alias("n_rows"), F.col("quota_field").alias("quota")),
    )
    if table.is_small:
        quotas = bounded(table.frame.select(*CLASS_KEYS, F.inline(per_source)))
        if quotas.is_small:
            kept = sample_by_quota(inside, quotas, keys, seed, row_id)
            named = Dimension(table.frame.select(*CLASS_KEYS, "balance_case"), table.rows)
            return lookup_join(kept, named, CLASS_KEYS).select(*df.columns, "balance_case")
    # Too many classes to ship: rank up to the largest possible quota, then look the quota of each group up.
    ranked = top_per_group(
        inside.withColumn("_key", seed_key(seed, row_id)), max(targets.values()) + over, keys, ["_key", row_id], row_id)
    quota = F.when(F.col("source") == "lab", F.col("quota_lab")).when(F.col("source") == "field", F.col("quota_field"))
    slim = Dimension(table.frame.select(*CLASS_KEYS, "balance_case", "quota_lab", "quota_field"), None)
    return lookup_join(ranked, slim, CLASS_KEYS).where(F.col("rn") <= quota).select(*df.columns, "balance_case")


def class_counts(df: DataFrame, order: Column | str, class_id: str = "numeric_label",
                 label: str = "crop_disease_label") -> DataFrame:
    """Rows per class over all splits, with the last-seen name, ordered by id."""
    return df.groupBy(class_id).agg(
        F.max_by(label, order).alias("label"), F.count(F.lit(1)).alias("n")
    ).orderBy(class_id)


def class_counts_total(df: DataFrame, class_id: str = "numeric_label") -> DataFrame:
    """The same with a grand-total row (``is_total`` = 1, id null)."""
    return df.rollup(class_id).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("is_total"))


def class_by_source(df: DataFrame, n: int, class_id: str = "numeric_label") -> DataFrame:
    """Lab and field rows per class 0..n-1, zeros filled; both columns exist even where a source is absent."""
    from curascore.operators.labels import densify_classes

    counts = df.groupBy(class_id).pivot("source", ["lab", "field"]).count()
    return densify_classes(counts, n, class_id)


def majority_class(df: DataFrame, label: str = "crop_disease_label") -> DataFrame:
    """Most frequent class; a tie goes to the first label in order."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(1)


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def kept_totals(cases: DataFrame) -> DataFrame:
    """Rows kept per class and their running total within the split, in (crop, disease) order.

    Input is one row per class, not per sample.
    """
    kept = cases.withColumn("n_kept", F.col("quota_lab") + F.col("quota_field"))
    running = Window.partitionBy("split").orderBy("crop", "disease").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(*CLASS_KEYS, "balance_case", "n_kept", F.sum("n_kept").over(running).alias("running_total"))
