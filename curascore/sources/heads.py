"""Linear heads on disk: one row per class, and a metadata row next to them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curascore.settings import HEAD_NORMALIZATION, HEAD_NOTE, HEAD_TYPE

HEAD_SCHEMA = "class_id int, weights array<double>, bias double"
META_SCHEMA = "backbone_name string, num_classes int, feature_dim int, head_type string, normalization string, note string"


def save_head(head: DataFrame, path: str, backbone_name: str) -> None:
    rows = head.select(F.col("class_id").cast("int"), F.col("weights").cast("array<double>"), F.col("bias").cast("double"))
    rows.write.mode("overwrite").parquet(f"{path}/weights")
    stored = head.sparkSession.read.schema(HEAD_SCHEMA).parquet(f"{path}/weights")
    meta = stored.agg(
        F.lit(backbone_name).alias("backbone_name"),
        F.count(F.lit(1)).cast("int").alias("num_classes"),
        F.max(F.size("weights")).alias("feature_dim"),
        F.lit(HEAD_TYPE).alias("head_type"),
        F.lit(HEAD_NORMALIZATION).alias("normalization"),
        F.lit(HEAD_NOTE).alias("note"),
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")


def load_head(spark: SparkSession, path: str, n_classes: int | None = None) -> tuple[DataFrame, dict]:
    """(weights, metadata); a missing part or another class count is an error."""
    try:
        meta_rows = spark.read.schema(META_SCHEMA).json(f"{path}/metadata").limit(2).collect()
        weights = spark.read.schema(HEAD_SCHEMA).parquet(f"{path}/weights")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no linear head under {path}") from missing
    if len(meta_rows) != 1:
        raise FileNotFoundError(f"no single metadata row under {path}")
    meta = meta_rows[0].asDict()
    if n_classes is not None and meta["num_classes"] != n_classes:
        raise ValueError(f"head expects {meta['num_classes']} classes, the data has {n_classes}")
    return weights, meta
