"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curascore.operators.positions import positions

SAMPLE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("crop", T.StringType()),
    T.StructField("disease", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("crop_disease_label", T.StringType()),
    T.StructField("numeric_label", T.IntegerType()),
    T.StructField("split", T.StringType()),
])
# A curated dataset also says by which case of the balance rule each row was kept.
CURATED_SCHEMA = T.StructType([*SAMPLE_SCHEMA.fields[:-1], T.StructField("balance_case", T.StringType()), SAMPLE_SCHEMA["split"]])
OUTPUT_SCHEMA = T.StructType([
    T.StructField("True Label", T.IntegerType()),
    T.StructField("True Label (Text)", T.StringType()),
    T.StructField("Parsed Output", T.StringType()),
])


def load_samples(spark: SparkSession, path: str, split: str | None = None, schema: T.StructType | None = SAMPLE_SCHEMA) -> DataFrame:
    """A curated dataset, or one split of it; the split is a partition folder, so others are not read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_outputs_csv(spark: SparkSession, path: str, schema: T.StructType = OUTPUT_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Parsed-output CSV with a header; quoted fields may hold doubled quotes.

    Outputs are expected as ``escape_output`` writes them, on one line, so that a large file is split over tasks.
    ``multi_line=True`` reads raw outputs with line breaks in quoted fields; a file of these is one task's work.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=True,
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def read_matrix_csv(spark: SparkSession, path: str, n_classes: int) -> DataFrame:
    """Headerless integer matrix with its row number; a heading in the first line and a byte-order mark are skipped.

    Row order is the place in the file (block, then line), not the order in which tasks deliver rows. Any other line
    that does not hold exactly ``n_classes`` integers is an error when it is read; empty lines are skipped.
    """
    names = [f"p{i}" for i in range(n_classes)]
    line = F.regexp_replace("value", "^\ufeff", "")
    placed = spark.read.text(path).where(F.trim(line) != "").select(
        F.transform(F.split(line, ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))).alias("_cells"), line.alias("_text"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    numbered = positions(placed, ["_file", "_block", "_line"], "_pos")
    numeric = F.forall("_cells", lambda c: c.try_cast("bigint").isNotNull())
    heading = int(not numbered.where(F.col("_pos") == 0).where(~numeric).isEmpty())
    wrong = F.raise_error(F.concat(F.lit(f"not {n_classes} integers: "), F.substring("_text", 1, 200)))
    cells = F.when(numeric & (F.size("_cells") == n_classes), F.col("_cells")).otherwise(wrong.cast("array<string>"))
    rows = numbered.where(F.col("_pos") >= heading).select((F.col("_pos") - heading).alias("y_true"), cells.alias("_cells"))
    return rows.select("y_true", *[F.get("_cells", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)])


def list_checkpoints(spark: SparkSession, folder: str, pattern: str = "*.pth") -> DataFrame:
    """Checkpoint files of a folder in path order; only names and sizes are read, never contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").orderBy("path")
