"""Streams of outputs and predictions: the row-wise parsers and a running confusion count."""

from __future__ import annotations

import os

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curascore.functions.text import parse_output, parse_zero_shot
from curascore.operators.metrics import confusion_long


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a table as a stream; ``path`` is its folder, or a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files, place = _files(spark, path)
    if not files.exists(place) or files.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # The file source watches folders: a single file is watched in its folder by its exact name.
    folder, name = os.path.split(path.rstrip("/"))
    return reader.option("pathGlobFilter", name).parquet(folder)


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path as that file system knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def streaming_parse(stream: DataFrame, output: str = "output", regime: str | None = None) -> DataFrame:
    """Label and fallback flag per row, in append mode."""
    parser = parse_zero_shot if regime == "pure" else parse_output
    return stream.withColumn("_p", parser(output)).select("*", "_p.label", "_p.is_fallback").drop("_p")


def streaming_confusion(stream: DataFrame) -> DataFrame:
    """Running count per (source, true, predicted).

    State holds one number per key, at most sources x classes^2 of them; partial counts are made before the
    shuffle, so a hot class does not travel row by row. Views are formed from the counts, not from the rows.
    """
    return (
        stream.where(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
        .groupBy("source", "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


COMPACT_EVERY = 16  # batches whose changes are merged into one version of the whole state


def run_confusion(stream: DataFrame, path: str, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Drain the stream; return the confusion counts per view of all batches in the folder, also of earlier runs.

    A batch writes the new counts of the keys that it changed, under its own id, so a retry replaces them. Every
    ``compact_every`` batches the changes so far become a version of the whole state, which later ones build on.
    """
    counts = streaming_confusion(stream)

    def changes(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _state(batch.sparkSession, path, batch_id).write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update").foreachBatch(changes)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return confusion_long(_state(counts.sparkSession, path), weight="n")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batches under a folder whose write was finished."""
    files, place = _files(spark, folder)
    names = [f.getPath() for f in files.listStatus(place)] if files.exists(place) else []
    done = [p.getName() for p in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.split("=")[1]) for name in done if name.startswith("batch="))


def _state(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """(source, y_true, y_pred, n) after batch ``until`` (default: the last): the newest version and later changes."""
    schema = "source string, y_true int, y_pred int, n long"
    versions = [b for b in _batches(spark, f"{path}/versions") if until is None or b < until]
    base = versions[-1] if versions else -1
    later = [b for b in _batches(spark, f"{path}/changes") if b > base and (until is None or b <= until)]
    state = spark.createDataFrame([], schema + ", batch long")
    if versions:
        state = spark.read.schema(schema).parquet(f"{path}/versions/batch={base}").withColumn("batch", F.lit(base).cast("long"))
    if later:
        # One read of all changes; a changed key carries its whole count, so the latest one counts.
        read = spark.read.schema(schema + ", batch long").option("basePath", f"{path}/changes")
        state = state.unionByName(read.parquet(*[f"{path}/changes/batch={b}" for b in later]))
    return state.groupBy("source", "y_true", "y_pred").agg(F.max_by("n", "batch").alias("n"))


def run_parse(parsed: DataFrame, path: str) -> DataFrame:
    """Drain a parsed stream into files and read them back."""
    query = (
        parsed.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    )
    query.awaitTermination()
    return parsed.sparkSession.read.schema(parsed.schema).parquet(f"{path}/rows")
