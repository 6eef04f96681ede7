"""Experiment grids, run names, losses per epoch and trial settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curascore.functions.hashing import seeded_unit
from curascore.functions.text import file_name, parse_run_name, pretty_run_name
from curascore.operators.metrics import metrics_by_view
from curascore.settings import GRID_BATCH_SIZES, GRID_LEARNING_RATES, MODEL_NAMES, OTHER_MODEL_NAME


def grid(models: DataFrame, batch_sizes: Sequence[int] = GRID_BATCH_SIZES, rates: Sequence[float] = GRID_LEARNING_RATES) -> DataFrame:
    """Every setting for every row of ``models``, batch size outer and learning rate inner, with its id."""
    settings = F.array(*[
        F.struct(F.lit(i * len(rates) + j).cast("bigint").alias("experiment_id"), F.lit(b).alias("batch_size"),
                 F.lit(float(r)).alias("learning_rate"))
        for i, b in enumerate(batch_sizes) for j, r in enumerate(rates)
    ])
    return models.select("*", F.inline(settings))


def resolve_experiment(df: DataFrame, batch_sizes: Sequence[int] = GRID_BATCH_SIZES, rates: Sequence[float] = GRID_LEARNING_RATES,
                       experiment_id: str = "experiment_id", strict: bool = False) -> DataFrame:
    """Experiment id -> (batch, rate) by arithmetic on the grid, without a join.

    ``resolved`` is false for an id outside the grid; with ``strict`` such a row is an error.
    """
    size = len(batch_sizes) * len(rates)
    eid = F.col(experiment_id)
    inside = eid.isNotNull() & (eid >= 0) & (eid < size)
    batches = F.array(*[F.lit(b) for b in batch_sizes])
    lrs = F.array(*[F.lit(float(r)) for r in rates])
    at = F.when(inside, eid).otherwise(F.lit(0))
    out = (
        df.withColumn("grid_batch_size", F.when(inside, F.get(batches, F.floor(at / len(rates)).cast("int"))))
        .withColumn("grid_learning_rate", F.when(inside, F.get(lrs, (at % len(rates)).cast("int"))))
        .withColumn("resolved", inside)
    )
    if strict:
        message = F.concat(F.lit("no grid cell has number "), eid.cast("string"), F.lit(f"; there are {size}"))
        out = out.withColumn("resolved", F.when(eid.isNotNull() & ~inside, F.raise_error(message).cast("boolean")).otherwise(inside))
    return out


def parse_run_files(files: DataFrame, tag: str = "model_exp", suffix: str = ".pth") -> DataFrame:
    """(model, batch_size, learning_rate, experiment_id, status) per checkpoint file.

    ``status``: ``ok``, ``out_of_range`` (an id outside the grid) or ``skipped`` (any other name).
    """
    found = files.where(F.endswith(F.col("path"), F.lit(suffix))).withColumn("_r", parse_run_name("path", tag))
    flat = found.select("*", "_r.*").drop("_r")
    full = resolve_experiment(flat)
    return full.select(
        *files.columns,
        "model",
        F.coalesce("batch_size", "grid_batch_size").alias("batch_size"),
        F.coalesce("learning_rate", "grid_learning_rate").alias("learning_rate"),
        "experiment_id",
        F.when(F.col("model").isNull(), "skipped")
        .when(F.col("experiment_id").isNotNull() & ~F.col("resolved"), "out_of_range")
        .otherwise("ok").alias("status"),
    )


def named_runs(parsed: DataFrame, names: dict[str, str] = MODEL_NAMES, other: str = OTHER_MODEL_NAME) -> DataFrame:
    """One row per display name; of files with the same name the last in path order wins."""
    shown = pretty_run_name(F.col("model"), F.col("batch_size"), F.col("learning_rate"), names, other)
    return (
        parsed.where(F.col("status") == "ok").withColumn("run_name", shown)
        .groupBy("run_name")
        .agg(F.max_by(F.struct("path", "batch_size", "learning_rate"), F.struct("path", "run_pos")).alias("_l"), F.count(F.lit(1)).alias("n_files"))
        .select("run_name", "_l.*", "n_files")
    )


def skipped_files(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("status") == "skipped").select(file_name("path").alias("file"))


def epoch_losses(log: DataFrame, value: str = "value") -> DataFrame:
    """Mean per run, epoch and metric from per-step values."""
    return log.groupBy("run_id", "epoch", "metric").agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("steps"))


def best_checkpoint(losses: DataFrame, value: str = "mean_value", decimals: int | None = None) -> DataFrame:
    """Per run and metric the epoch with the lowest value; an equal value keeps the earlier epoch."""
    v = F.round(value, decimals) if decimals is not None else F.col(value)
    return losses.groupBy("run_id", "metric").agg(
        F.min_by(F.struct(F.col("epoch"), v.alias("v")), F.struct(v.alias("v"), F.col("epoch"))).alias("_b")
    ).select("run_id", "metric", F.col("_b.epoch").alias("best_epoch"), F.col("_b.v").alias("best_value"))


def draw(space: dict, seed: int, trial_id: Column | str, name: str) -> Column:
    """One setting of a trial: ``log_uniform_values`` and ``uniform`` use min and max, ``categorical`` uses values."""
    u = seeded_unit(f"{seed}:{name}", trial_id)
    kind = space["distribution"]
    if kind == "categorical":
        values = F.array(*[F.lit(v) for v in space["values"]])
        return F.get(values, F.floor(u * len(space["values"])).cast("int"))
    low, high = float(space["min"]), float(space["max"])
    if kind == "uniform":
        return F.lit(low) + u * F.lit(high - low)
    if kind == "log_uniform_values":
        return F.exp(F.ln(F.lit(low)) + u * (F.ln(F.lit(high)) - F.ln(F.lit(low))))
    raise ValueError(f"unknown distribution {kind}")


def trial_table(trials: DataFrame, space: dict[str, dict], seed: int, trial_id: str = "trial_id") -> DataFrame:
    """Add one drawn column per parameter to each trial."""
    return trials.select("*", *[draw(s, seed, trial_id, name).alias(name) for name, s in space.items()])


def run_summary(df: DataFrame, run: str = "run_id") -> DataFrame:
    """One summary row per run and view."""
    return metrics_by_view(df, [run])


def with_batch_length(df: DataFrame, batch: str, size: Column | str) -> DataFrame:
    """Longest row per batch, next to each row; a batch is a few rows, so its window is small."""
    return df.withColumn("batch_length", F.max(size).over(Window.partitionBy(batch)))
