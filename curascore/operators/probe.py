"""Linear probe on frozen features, with MLlib's multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.functions.vectors import cross_entropy, dense_rows, l2_normalize
from curascore.operators.scoring import with_logits
from curascore.session import scratch_path
from curascore.settings import NORM_FLOOR


def training_rows(df: DataFrame, features: str = "features", label: str = "y_true") -> DataFrame:
    """(label, vector) with features L2-normalised."""
    return df.select(F.col(label).cast("double").alias("label"), array_to_vector(l2_normalize(features)).alias("vector"))


def _estimator(reg: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="vector", labelCol="label", family="multinomial", regParam=reg, maxIter=max_iter, standardization=False
    )


def fit_linear_probe(df: DataFrame, reg: float = 1e-4, max_iter: int = 50, features: str = "features",
                     label: str = "y_true") -> LogisticRegressionModel:
    """Gradients are summed per partition, so rows stay where they are."""
    return _estimator(reg, max_iter).fit(training_rows(df, features, label))


def head_of(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """(class_id, weights, bias): one row per class, created from the fitted coefficients."""
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    rows = [(i, [float(x) for x in weights[i]], float(bias[i])) for i in range(weights.shape[0])]
    return df.sparkSession.createDataFrame(rows, "class_id int, weights array<double>, bias double")


def sweep_probe(train: DataFrame, validation: DataFrame, values: Sequence[float], max_iter: int = 50,
                features: str = "features", label: str = "y_true") -> tuple[DataFrame, LogisticRegressionModel]:
    """One fit per setting on the given train split; (table of validation losses, model of the lowest loss).

    The split is the caller's: nothing is re-split at random.
    """
    base = _estimator(0.0, max_iter)
    grid = ParamGridBuilder().addGrid(base.regParam, list(values)).build()
    rows, held = training_rows(train, features, label).persist(), training_rows(validation, features, label).persist()
    measure = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label", probabilityCol="probability")
    fitted = sorted(base.fitMultiple(rows, grid), key=lambda pair: pair[0])
    losses = [(float(values[i]), float(measure.evaluate(model.transform(held)))) for i, model in fitted]
    rows.unpersist()
    held.unpersist()
    best = min(range(len(losses)), key=lambda i: (losses[i][1], i))
    table = train.sparkSession.createDataFrame(
        [(value, loss, i == best) for i, (value, loss) in enumerate(losses)], "setting double, val_loss double, is_best boolean"
    )
    return table, dict(fitted)[best]


HEADS = "setting int, rate double, class_id int, weights array<double>, bias double"


def gradient_heads(train: DataFrame, rates: Sequence[float], n_classes: int, steps: int = 10, features: str = "features",
                   label: str = "y_true") -> DataFrame:
    """One softmax head per learning rate, by full gradient descent from zero weights over unit features.

    All settings share a pass per step: every task adds up the gradients of its rows for all heads, and only these sums
    (settings x classes x width) reach the driver. Rows without a label or features take no part; a label outside
    ``0..n_classes - 1`` is an error. The heads of all settings are written as one table.
    """
    rows = train.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).alias("f"), F.col(label).cast("int").alias("y"))
    first = rows.agg(F.max(F.size("f")).alias("width"), F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    if not first["n"]:
        raise ValueError("no rows to learn from")
    if first["low"] < 0 or first["high"] >= n_classes:
        raise ValueError(f"labels {first['low']}..{first['high']} outside 0..{n_classes - 1}")
    width, n, scale = first["width"], first["n"], np.array(rates, np.float64)[:, None, None]
    heads = np.zeros((len(rates), n_classes, width + 1))

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(heads)
        for batch in batches:
            _, x = dense_rows(batch.column("f"), width)
            x = np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR), np.ones(len(x))])
            hot = np.eye(n_classes)[batch.column("y").to_numpy()]
            for s, head in enumerate(heads):
                z = x @ head.T
                p = np.exp(z - z.max(1, keepdims=True))
                total[s] += (hot - p / p.sum(1, keepdims=True)).T @ x
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    for _ in range(steps):
        parts = rows.mapInArrow(gradients, "g binary").toArrow().column("g").to_pylist()
        heads = heads + scale / n * sum(np.frombuffer(g, np.float64).reshape(heads.shape) for g in parts)
    made = [(s, float(rates[s]), k, heads[s, k, :-1].tolist(), float(heads[s, k, -1])) for s in range(len(rates)) for k in range(n_classes)]
    spark = train.sparkSession
    path = scratch_path(spark, "heads")
    spark.createDataFrame(made, HEADS).write.parquet(path)
    return spark.read.schema(HEADS).parquet(path)


def sweep_rates(train: DataFrame, validation: DataFrame, rates: Sequence[float], n_classes: int, steps: int = 10, features: str = "features",
                label: str = "y_true") -> tuple[DataFrame, DataFrame]:
    """One head per learning rate and its mean cross entropy on the validation rows: (setting, rate, val_loss, is_best),
    and the head of the lowest loss (of equal ones the first setting). All heads are scored in one pass."""
    heads = gradient_heads(train, rates, n_classes, steps, features, label)
    stacked = heads.select((F.col("setting") * n_classes + F.col("class_id")).alias("class_id"), "weights", "bias")
    known = validation.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    rows = with_logits(known.select(features, label), stacked, features, "_logits", unit=True)
    loss = [F.avg(cross_entropy(F.slice("_logits", s * n_classes + 1, n_classes), label)).alias(f"s{s}") for s in range(len(rates))]
    losses = list(rows.agg(*loss).first())
    if losses[0] is None:
        raise ValueError("no rows to validate on")
    best = min(range(len(rates)), key=lambda s: (losses[s], s))
    table = train.sparkSession.createDataFrame(
        [(s, float(r), losses[s], s == best) for s, r in enumerate(rates)], "setting int, rate double, val_loss double, is_best boolean")
    return table, heads.where(F.col("setting") == best).select("class_id", "weights", "bias")
