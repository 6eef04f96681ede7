"""Raw samples -> balanced, labelled, published dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from curascore.operators.curation import balance_case, balanced_downsample, source_balance
from curascore.operators.labels import dense_label_ids, encode_labels, with_label
from curascore.operators.lookup import bounded
from curascore.settings import CURATION_SEED, SPLIT_TARGETS
from curascore.sources.writers import publish


def curate(raw: DataFrame, targets: dict[str, int] = SPLIT_TARGETS, seed: int = CURATION_SEED, row_id: str = "sample_id") -> DataFrame:
    """Balanced sample of every split with label text and one global id per label.

    The raw rows are read twice: once for the class counts, which also give the vocabulary, and once to sample.
    """
    cases = bounded(balance_case(source_balance(raw), targets))
    vocab = dense_label_ids(with_label(cases.frame.select("crop", "disease")))
    kept = with_label(balanced_downsample(raw, targets, seed, row_id, cases=cases))
    return encode_labels(kept, vocab).withColumnRenamed("class_id", "numeric_label")


def build_dataset(raw: DataFrame, path: str, targets: dict[str, int] = SPLIT_TARGETS, seed: int = CURATION_SEED) -> None:
    publish(curate(raw, targets, seed), path)
