"""Label columns, vocabularies and lookups in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curascore.functions.text import compose_label
from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.operators.positions import positions, segmented_positions
from curascore.settings import FALSE_PARSE, FALSE_PARSE_ID, LAB, MAIN

LIST_BLOCK = 1_024  # labels in a row of a stored list


def source_view(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source") == source)


def load_variant(df: DataFrame, job_type: str) -> DataFrame:
    """Main, lab or field data by job type: ``lab``/``field`` in the name filters the source."""
    for source in (LAB, "field"):
        if source in job_type:
            return source_view(df, source)
    return df


def with_views(df: DataFrame) -> DataFrame:
    """Each row under ``main`` and under its own source. Apply to aggregates, not to raw rows."""
    return df.withColumn("view", F.explode(F.array(F.lit(MAIN), F.col("source"))))


def prune_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep)


def column_difference(df: DataFrame, keep: list[str]) -> list[str]:
    """Columns of ``df`` that are not kept."""
    return [c for c in df.columns if c not in keep]


def with_label(df: DataFrame, name: str = "crop_disease_label") -> DataFrame:
    return df.withColumn(name, compose_label())


def vocabulary(df: DataFrame, label: str = "crop_disease_label") -> DataFrame:
    """Sorted distinct labels."""
    return df.select(F.col(label).alias("label")).distinct().orderBy("label")


def vocabulary_size(df: DataFrame, label: str = "crop_disease_label") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_classes"))


def dense_label_ids(df: DataFrame, label: str = "crop_disease_label", per_split: bool = False) -> DataFrame:
    """0-based id by sorted label, over the distinct labels only.

    ``per_split`` numbers each split on its own, so ids shift where a split misses a class.
    """
    keys = ["split"] if per_split else []
    table = bounded(df.select(*keys, F.col(label).alias("label")).distinct())
    if per_split:
        if not table.is_small:
            return segmented_positions(table.frame, keys, ["label"], "class_id").withColumn("class_id", F.col("class_id").cast("int"))
        rank = F.row_number().over(Window.partitionBy("split").orderBy("label"))  # proven small above
        return table.frame.select("split", "label", (rank - 1).alias("class_id"))
    if not table.is_small:
        return positions(table.frame, ["label"], "class_id").withColumn("class_id", F.col("class_id").cast("int"))
    rank = F.row_number().over(Window.orderBy("label"))  # proven small above
    return table.frame.select("label", (rank - 1).alias("class_id"))


def class_table(df: DataFrame, list_order: Column | None = None) -> DataFrame:
    """(label, crop, disease, class_id, list_pos); ``list_order`` gives the published order, default sorted."""
    distinct = df.select(F.col("crop_disease_label").alias("label"), "crop", "disease").distinct()
    table = bounded(distinct)
    order = list_order if list_order is not None else F.col("label")
    if not table.is_small:
        # Ids number the labels: two crops that lower-case to one label share an id.
        numbered = positions(table.frame.select("label").distinct(), ["label"], "class_id")
        ids = lookup_join(table.frame, numbered, "label")
        ids = ids.withColumn("_order", order)
        out = positions(ids, ["_order", "label", "crop", "disease"], "list_pos").drop("_order")
        return out.withColumn("class_id", F.col("class_id").cast("int")).withColumn("list_pos", F.col("list_pos").cast("int"))
    return table.frame.select(
        "label", "crop", "disease",
        (F.dense_rank().over(Window.orderBy("label")) - 1).alias("class_id"),
        (F.row_number().over(Window.orderBy(order, "label")) - 1).alias("list_pos"),
    )


def encode_labels(df: DataFrame, vocab: DataFrame | Dimension, label: str = "crop_disease_label",
                  how: str = "left") -> DataFrame:
    """Add ``class_id`` by label; a label outside the vocabulary gives null under ``how='left'``."""
    table = bounded(vocab)
    slim = Dimension(table.frame.select(F.col("label").alias(label), "class_id"), table.rows)
    return lookup_join(df, slim, label, how)


def decode_labels(df: DataFrame, vocab: DataFrame | Dimension, class_id: str = "class_id", name: str = "label") -> DataFrame:
    """Add the label text by id; an unknown id gives null."""
    table = bounded(vocab)
    slim = Dimension(table.frame.select(F.col("class_id").alias(class_id), F.col("label").alias(name)), table.rows)
    return lookup_join(df, slim, class_id, "left")


def build_label_map(df: DataFrame, order: Column | str, label: str = "crop_disease_label", class_id: str = "class_id",
                    failure_id: int = FALSE_PARSE_ID) -> DataFrame:
    """Last-seen id per label in ``order``, plus the failure class."""
    last = df.groupBy(F.col(label).alias("label")).agg(F.max_by(class_id, order).cast("int").alias("class_id"))
    failure = df.sparkSession.range(1).select(F.lit(FALSE_PARSE).alias("label"), F.lit(failure_id).cast("int").alias("class_id"))
    return last.unionByName(failure)


def first_row_for_label(df: DataFrame, order: Column | str, label: str = "crop_disease_label") -> DataFrame:
    """Crop and disease of the first row of each label in ``order``."""
    first = df.groupBy(F.col(label).alias("label")).agg(F.min_by(F.struct("crop", "disease"), order).alias("_first"))
    return first.select("label", "_first.crop", "_first.disease")


def in_vocabulary(df: DataFrame, vocab: DataFrame | Dimension, label: str = "label", invert: bool = False) -> DataFrame:
    """Rows whose label is known; ``invert`` gives the rejected rows instead."""
    table = bounded(vocab)
    slim = Dimension(table.frame.select(F.col("label").alias(label)), table.rows)
    return lookup_join(df, slim, label, "left_anti" if invert else "left_semi")


def densify_classes(counts: DataFrame, n: int, class_id: str = "class_id") -> DataFrame:
    """One row per class 0..n-1, missing counts as 0."""
    every = counts.sparkSession.range(n).select(F.col("id").cast("int").alias(class_id))
    return every.join(counts, class_id, "left").na.fill(0)


def distractor_candidates(df: DataFrame, labels: list[str], label: str = "crop_disease_label") -> DataFrame:
    """All labels but the true one, as one array per row, so that no pairs are emitted."""
    vocab = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("candidates", F.array_except(vocab, F.array(F.col(label))))


def listed(vocab: DataFrame | Dimension, order: str = "class_id") -> DataFrame:
    """The vocabulary as blocks of a list: (list_id, first, labels), ``LIST_BLOCK`` labels in list order per block.

    ``order`` is a column of positions 0..n-1. The id is a digest of all labels with their positions, so equal lists
    share it whatever table they come from.
    """
    rows = bounded(vocab).frame.select("label", F.col(order).cast("long").alias("_pos"))
    digest = rows.agg(F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(F.xxhash64("label", "_pos"))),
                                  F.hex(F.sum(F.hash("label", "_pos").cast("long")))).alias("id")).first()["id"]
    blocks = rows.groupBy((F.floor(F.col("_pos") / LIST_BLOCK) * LIST_BLOCK).alias("first")).agg(F.array_sort(F.collect_list(F.struct("_pos", "label"))).alias("_l"))
    return blocks.select(F.lit(digest).alias("list_id"), "first", F.col("_l.label").alias("labels"))


def distractor_references(df: DataFrame, vocab: DataFrame | Dimension, label: str = "crop_disease_label", order: str = "class_id") -> tuple[DataFrame, DataFrame]:
    """(rows, list): every row with ``list_id`` and ``left_out``, the list position of its true label, and the list.

    What a row is offered is the list without that position: two numbers instead of all labels, whatever the size of
    the vocabulary. A label that is not in it leaves nothing out (null). ``distractors`` writes the labels out.
    """
    table = bounded(vocab)
    blocks = listed(table, order)
    first = blocks.select("list_id").first()
    places = Dimension(table.frame.select(F.col("label").alias(label), F.col(order).cast("long").alias("left_out")), table.rows)
    return lookup_join(df, places, label, "left").withColumn("list_id", F.lit(first["list_id"] if first else None).cast("string")), blocks


def distractors(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``distractor_references`` written out, where they are used: ``candidates`` of a row, one array per block
    of its list, with ``first``, the block's place in the list. A block that is left empty gives no row."""
    lists = bounded(blocks)
    rows = lookup_join(refs.withColumn("_id", F.col("list_id")).drop("list_id"), Dimension(lists.frame.withColumnRenamed("list_id", "_id"), lists.rows), "_id")
    kept = F.filter("labels", lambda x, i: F.coalesce(F.col("first") + i != F.col("left_out"), F.lit(True)))
    return rows.withColumn("candidates", kept).where(F.size("candidates") > 0).drop("labels").withColumnRenamed("_id", "list_id")


def label_list(vocab: DataFrame | Dimension, order: str | None = None) -> list[str] | None:
    """The labels as a Python list for use in expressions; None when the vocabulary is not proven small.

    Their order is that of the named column, which must be there; by default that of ``class_id``, or sorted.
    """
    table = bounded(vocab)
    if not table.is_small:
        return None
    if order is not None and order not in table.rows.column_names:
        raise ValueError(f"the vocabulary has no column {order}")
    order = order or "class_id"
    pairs = table.rows.select(["label", order]).to_pylist() if order in table.rows.column_names else None
    if pairs is None:
        return sorted(x["label"] for x in table.rows.select(["label"]).to_pylist())
    return [x["label"] for x in sorted(pairs, key=lambda x: x[order])]


def concat(*frames: DataFrame) -> DataFrame:
    """Union all of parts, matched by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def label_difference(vocab: DataFrame, other: DataFrame) -> DataFrame:
    """Labels of ``vocab`` that are not in ``other``."""
    return vocab.select("label").join(other.select("label").distinct(), "label", "left_anti")
