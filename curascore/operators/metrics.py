"""Confusion counts and the metrics derived from them.

Rows are aggregated once to (keys, true, predicted) counts; everything after that works on at most
``keys x classes^2`` rows, so views and macro averages never touch the samples again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.operators.labels import with_views
from curascore.settings import FALSE_PARSE, VIEWS

GRID_IDS, MAX_RANGES = 1_024, 100_000  # ids in a range of a dense grid; ranges that a plan may name


def confusion_long(df: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Count per (keys, view, true, predicted). Rows without a predicted class take no part.

    ``weight`` names a count column where rows are already aggregated.
    """
    extra = keys or []
    pre = (
        df.where(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
        .groupBy(*extra, "source", "y_true", "y_pred")
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    return with_views(pre).groupBy(*extra, "view", "y_true", "y_pred").agg(F.sum("_n").alias("n"))


def confusion_matrix(counts: DataFrame, n_classes: int, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """Wide n x n matrix per view: one row per true class, columns ``p0..`` by predicted class, zeros filled.

    A class id outside ``0..n_classes - 1`` is an error when the matrix is computed, as its cell has no place.
    """
    rows = counts.sparkSession.range(n_classes).select(
        F.explode(F.array(*[F.lit(v) for v in views])).alias("view"), F.col("id").cast("int").alias("y_true"))
    inside = F.col("y_true").between(0, n_classes - 1) & F.col("y_pred").between(0, n_classes - 1)
    stray = F.raise_error(F.concat(F.lit(f"class id outside 0..{n_classes - 1}: "), F.concat_ws(", ", "y_true", "y_pred")))
    cells = counts.groupBy("view", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    # One map of at most n entries per row instead of n aggregates.
    row = cells.groupBy("view", F.when(inside, F.col("y_true")).otherwise(stray.cast("int")).alias("y_true")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("y_pred").cast("int"), "n"))).alias("_row"))
    wide = row.select("view", "y_true", *[F.try_element_at("_row", F.lit(i)).alias(f"p{i}") for i in range(n_classes)])
    return rows.join(wide, ["view", "y_true"], "left").na.fill(0)


def per_class_counts(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, support and predicted rows per class, in one aggregation instead of a join of two.

    A cell adds to its true class (tp or fn) and, off the diagonal, to its predicted class (fp).
    """
    on = [*(keys or []), "view"]
    hit = F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("bigint")
    as_true = F.struct(
        F.col("y_true").cast("int").alias("class_id"),
        F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
        zero.alias("fp"),
        F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
    )
    as_pred = F.struct(F.col("y_pred").cast("int").alias("class_id"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn"))
    parts = F.when(hit, F.array(as_true)).otherwise(F.array(as_true, as_pred))
    return (
        counts.select(*on, F.explode(parts).alias("_c")).select(*on, "_c.*")
        .groupBy(*on, "class_id")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        .withColumn("support", F.col("tp") + F.col("fn"))
        .withColumn("predicted", F.col("tp") + F.col("fp"))
    )


def _ratio(top, bottom):
    return F.when(bottom == 0, F.lit(0.0).cast("double")).otherwise(top.cast("double") / bottom)


def per_class_metrics(per_class: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; 0 where the denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        per_class.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def macro_metrics(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro means over the classes that take part in the view (true or predicted at least once).

    Balanced accuracy is macro recall; both are reported.
    """
    on = [*(keys or []), "view"]
    present = metrics.where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return present.groupBy(*on).agg(
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def metrics_by_view(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Macro metrics for main, lab and field in one pass over the predictions."""
    counts = confusion_long(df, keys)
    return macro_metrics(per_class_metrics(per_class_counts(counts, keys)), keys)


def macro_accuracy(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return metrics_by_view(df, keys).select(*(keys or []), "view", F.col("balanced_accuracy").alias("macro_accuracy"))


def combine_views(metrics: DataFrame, keys: list[str] | None = None, classes: DataFrame | None = None) -> DataFrame:
    """F1, precision and recall of the three views side by side, one row per class; 0 where a class is absent.

    ``classes(class_id, label)`` adds the label and the classes that no view has, once per combination of keys.
    """
    wide = metrics.groupBy(*(keys or []), "class_id").pivot("view", list(VIEWS)).agg(
        F.first("f1").alias("f1"), F.first("precision").alias("precision"), F.first("recall").alias("recall")
    )
    names = [(f"{view}_{m}", f"{m}_{view}") for m in ("f1", "precision", "recall") for view in VIEWS]
    table = wide.select(*(keys or []), "class_id", *[F.coalesce(F.col(a), F.lit(0.0)).alias(b) for a, b in names])
    if classes is None:
        return table
    every = classes.select(F.col("class_id").cast("int"), "label")
    if keys:
        every = class_grid(table.select(*keys).distinct(), every)
    return every.join(table, [*(keys or []), "class_id"], "left").na.fill(0.0, [b for _, b in names])


def class_grid(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of ``runs`` with every class of ``classes(class_id, label)``, dealt out by ranges of ids.

    A run is listed once per range of ``GRID_IDS`` ids that has classes, and meets the classes of that range by an
    equi-join; no list of runs or of classes is gathered. Ids may have gaps. The numbers of the ranges are one per
    ``GRID_IDS`` classes where ids are dense; more than ``MAX_RANGES`` of them is an error.
    """
    ranged = classes.withColumn("_range", F.floor(F.col("class_id") / GRID_IDS).cast("int"))
    ranges = sorted(r["_range"] for r in ranged.select("_range").distinct().limit(MAX_RANGES + 1).collect())
    if len(ranges) > MAX_RANGES:
        raise ValueError(f"class ids fall into more than {MAX_RANGES} ranges of {GRID_IDS}")
    listed = runs.withColumn("_range", F.explode(F.array(*[F.lit(r) for r in ranges]).cast("array<int>")))
    return listed.join(ranged, "_range").select(*runs.columns, *classes.columns)


def matrix_to_long(wide: DataFrame, n_classes: int, row: str = "y_true", keep: list[str] | None = None) -> DataFrame:
    """Stored wide matrix -> (true, predicted, n) for the non-zero cells; it must have ``n_classes`` value columns."""
    extra = keep or []
    columns = [c for c in wide.columns if c not in (row, *extra)]
    if len(columns) != n_classes:
        raise ValueError(f"the matrix has {len(columns)} value columns, not {n_classes}")
    cells = wide.unpivot([*extra, row], columns, "_column", "n")
    at = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return cells.select(
        *extra, F.col(row).cast("int").alias("y_true"), F.try_element_at(at, F.col("_column")).alias("y_pred"), F.col("n").cast("bigint")
    ).where(F.col("n") > 0)


def matrix_to_metrics(wide: DataFrame, n_classes: int, row: str = "y_true") -> DataFrame:
    """Macro metrics of a stored wide matrix; a ``view`` column is used where there is one."""
    if "view" not in wide.columns:
        wide = wide.withColumn("view", F.lit("main"))
    cells = matrix_to_long(wide, n_classes, row, ["view"])
    return macro_metrics(per_class_metrics(per_class_counts(cells)))


def top_confusions(counts: DataFrame, k: int, view: str = "main") -> DataFrame:
    """The ``k`` largest off-diagonal cells."""
    cells = counts.where((F.col("view") == view) & (F.col("y_true") != F.col("y_pred")))
    return cells.orderBy(F.desc("n"), "y_true", "y_pred").limit(k).select("y_true", "y_pred", "n")


def parse_quality(df: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """False parses, fallbacks and success rate per view; the total is all rows, also out-of-vocabulary ones.

    Only rows inside the vocabulary count as fallbacks, which includes false parses found by the fallback scan.
    Needs ``source``, ``y_pred``, ``is_false_parse`` (or ``label``) and ``is_fallback``.
    """
    extra = keys or []
    one = F.col(weight) if weight else F.lit(1).cast("bigint")
    known = F.col("y_pred").isNotNull()
    failed = F.col("is_false_parse") if "is_false_parse" in df.columns else F.col("label") == FALSE_PARSE

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, one)), F.lit(0).cast("bigint"))

    pre = df.groupBy(*extra, "source").agg(
        F.sum(one).alias("total"),
        rows(known & failed).alias("false_parse"),
        rows(known & F.col("is_fallback")).alias("fallback"),
        rows(~known).alias("out_of_vocabulary"),
    )
    names = ["total", "false_parse", "fallback", "out_of_vocabulary"]
    return (
        with_views(pre).groupBy(*extra, "view").agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("success_rate", (F.col("total") - F.col("false_parse")).cast("double") / F.col("total"))
    )


def outcome_tally(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Rows per named prediction, ``other`` and ``total``, in one pass."""
    named = F.when(F.col(label).isin(*labels), F.col(label)).otherwise("other")
    tally = df.select(named.alias("outcome")).rollup("outcome").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_total"))
    return tally.select(F.when(F.col("_total") == 1, "total").otherwise(F.col("outcome")).alias("outcome"), "n")


def sort_classes(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    return df.orderBy(class_id)
