"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []


def build_session(app: str = "curascore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; only unset keys are filled, so cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for a written intermediate, below the folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is unset and the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _LOCAL_SCRATCH:
            folder = tempfile.mkdtemp(prefix="curascore-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL_SCRATCH.append(folder)
        base = _LOCAL_SCRATCH[0]
    return os.path.join(base, f"{tag}-{uuid.uuid4().hex}")


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out evenly over the cores where its ``scan`` has fewer partitions than that; else as it is.

    This only concerns inputs of a few small files, where row-wise parsing would otherwise use one core. The
    partitions of a plain scan are known without running anything; those of a join are not, hence ``scan``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (scan or df).rdd.getNumPartitions() < cores else df
