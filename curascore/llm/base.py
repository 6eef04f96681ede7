"""Shared by the operators of this subpackage: tables, written intermediates, and the list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curascore.session import scratch_path


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: later steps and lost executors start there."""
    path = scratch_path(df.sparkSession, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of the texts, to choose how many parts later steps are dealt into."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
