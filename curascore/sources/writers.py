"""Writers. Each writes to a path of its own and never over its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.functions.prompts import training_conversation


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The listed columns in the listed order, with a header and standard quoting; whitespace is kept."""
    df.select(*columns).write.mode("overwrite").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def publish(df: DataFrame, path: str) -> None:
    """One folder per split. Rows go to the files of their split from every task, so no split is one task's work."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_matrix_csv(matrix: DataFrame, path: str, n_classes: int) -> None:
    """Wide matrix, one row per true class, without a header; files in name order hold the rows in class order."""
    cells = [f"p{i}" for i in range(n_classes)]
    matrix.select("y_true", *cells).orderBy("y_true").select(*cells).write.mode("overwrite").csv(path)


def write_report(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Each report table (summary, per-class, failed outputs, parse samples) under its own folder."""
    written = {}
    for name, table in tables.items():
        written[name] = f"{path}/{name}"
        table.write.mode("overwrite").parquet(written[name])
    return written


def sft_rows(df: DataFrame, row_id: str = "sample_id") -> DataFrame:
    """One JSON line per sample: ``{"messages": [...]}``."""
    return df.select(row_id, F.to_json(F.struct(training_conversation().alias("messages"))).alias("value"))


def export_sft_jsonl(df: DataFrame, path: str) -> None:
    sft_rows(df).select("value").write.mode("overwrite").text(path)
