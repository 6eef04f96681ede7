"""From raw documents to a mixed training corpus, in five stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curascore.llm.base import stored, table
from curascore.llm.decontaminate import contamination
from curascore.llm.jaccard_join import one_of_each
from curascore.llm.language_id import held_out, identify
from curascore.llm.line_dedup import dedup_lines
from curascore.llm.mixing import mix_sources

# Languages, distances and first occurrences are learned or chosen within the run: no SQL states its rows.
ORACLE_SQL = None


def _apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """``docs`` with neutral names, next to the columns an operator uses; and the way back to the names."""
    neutral = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)), *used)
    return neutral, [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without a letter or far from every language go."""
    neutral, back = _apart(docs, "text")
    labelled = docs.where(~held_out("doc_id", 4, 2)).select("text", "lang")
    return identify(neutral, labelled).where("not rejected").select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occurred before; those that lose every line go. ``n_chars`` follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    neutral = docs.select("doc_id", "text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(others)))
    kept = dedup_lines(neutral).where("n_removed = 0 or trim(text) <> ''")
    place = {c: F.col(f"_c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(place["n_chars"])
    return kept.select(*(place[c].alias(c) for c in docs.columns))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    neutral, back = _apart(docs, "text")
    carry = tuple(c for c in neutral.columns if c != "text")
    return contamination(neutral, table(spark, sf_dir, "benchmark"), carry=carry).where("not contaminated").select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size``, ``taken`` and how often each is repeated."""
    neutral, back = _apart(docs, "doc_id", "source", "text")
    carry = tuple(c for c in neutral.columns if c.startswith("_c"))
    mixed = mix_sources(neutral, carry=carry).where("taken > 0")
    extra = {"mix_size": F.col("size"), "mix_taken": F.col("taken"), "mix_repeats": (F.col("taken") / F.col("size")).cast("int")}
    return mixed.select(*back, *(v.alias(k) for k, v in extra.items() if k not in docs.columns))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
