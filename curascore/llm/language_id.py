"""Language identification by nearest centroid over TF-IDF n-gram vectors.

Texts become vectors of hashed byte 2- and 3-grams with logarithmic counts, weighted by inverse document frequency over
all labelled rows and normalised. Each language has several centroids: a bounded sample gives the starting points,
then all labelled rows are assigned and averaged. A text gets the language of the centroid with the largest cosine; it
is rejected if even that one is further away than labelled rows of the language are. Cosines grow with the length, so
the bar is set for each language and length: where nearly all labelled rows of other languages stay below, but never so
high that more than a small share of the language's own rows would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curascore.llm import sums
from curascore.llm.base import query, table
from curascore.llm.words import byte_texts, chunks, mix

BITS = 12
WIDTH = 1 << BITS
CENTROIDS = 4  # per language
SAMPLE = 1_024  # labelled rows, over all languages, that the starting points are found on
MAX_LANGUAGES = 512  # bounds the model; more learned values raise an error
BINS = 256
LENGTHS = 16  # bars by the power of two of the bytes
OWN_BELOW = 0.005  # share of a language's own labelled rows that its bar may reject
OTHERS_BELOW = 0.99  # share of other languages' labelled rows that a bar need not exceed
ENOUGH = 200  # own rows behind a bar; the next lengths on both sides join until there are so many
DOCS = 256  # texts that are dense at a time


def counts(texts: list[bytes]) -> np.ndarray:
    """Table (texts, WIDTH) of hashed 2- and 3-gram counts of the bytes, ASCII letters in lower case."""
    data = np.frombuffer(b"\x00\x00".join([b"", *texts, b""]), np.uint8).astype(np.uint64)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint64) * np.uint64(32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    doc = np.repeat(np.arange(len(texts)), size)
    two = data[1:-1] | (data[2:] << np.uint64(8))
    three = two[:-1] | (data[3:] << np.uint64(16)) | np.uint64(1 << 24)
    out = np.zeros(len(texts) * WIDTH, np.int64)
    for grams in (two, three):
        at = (mix(grams) >> np.uint64(64 - BITS)).astype(np.int64)
        keep = min(len(at), len(doc))
        out += np.bincount(doc[:keep] * WIDTH + at[:keep], minlength=len(out))
    return out.reshape(len(texts), WIDTH)


def vectors(texts: list[bytes], idf: np.ndarray | None = None) -> np.ndarray:
    made = np.log1p(counts(texts)).astype(np.float32)
    if idf is not None:
        made *= idf
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    return made


def pieces(texts: list[bytes]):
    for start, end in chunks(texts):
        for a in range(start, end, DOCS):
            yield a, min(a + DOCS, end)


def _df(batches):
    """Document frequencies of the grams, one partial sum per task."""
    total = np.zeros(WIDTH)
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        for a, b in pieces(texts):
            total += (counts(texts[a:b]) > 0).sum(0)
    yield sums.rows([(0, np.arange(WIDTH), total)], TaskContext.get().partitionId())


def start_points(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Cluster centres of normalised rows: farthest points first, then a few rounds of averaging."""
    centres = [sample.mean(0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(sample)):
        centres.append(sample[np.argmin((sample @ np.stack(centres).T).max(1))])
    points = np.stack(centres)
    for _ in range(rounds):
        nearest = (sample @ points.T).argmax(1)
        for c in range(len(points)):
            if (nearest == c).any():
                mean = sample[nearest == c].mean(0)
                points[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return points


def _assign(batches, shared):
    """Sums of the vectors of the centroid of its own language that each row is nearest to."""
    names, idf, points, owner = shared.value
    index = {x: i for i, x in enumerate(names)}
    total = np.zeros((len(points), WIDTH))
    for batch in batches:
        texts, langs = byte_texts(batch.column("text")), batch.column("lang").to_pylist()
        for a, b in pieces(texts):
            made = vectors(texts[a:b], idf)
            lang = np.array([index[x] for x in langs[a:b]])
            nearest = np.where(owner[None] == lang[:, None], made @ points.T, -1).argmax(1)
            pick = np.zeros((len(made), len(points)), np.float32)
            pick[np.arange(len(made)), nearest] = 1
            total += pick.T @ made
    parts = [(c, np.arange(WIDTH), total[c]) for c in range(len(points)) if total[c].any()]
    if parts:
        yield sums.rows(parts, TaskContext.get().partitionId())


def length_class(texts: list[bytes]) -> np.ndarray:
    return np.array([min(max(len(t).bit_length() - 1, 0), LENGTHS - 1) for t in texts], np.int64)


def _cosines(batches, shared):
    """Per language and length, histograms of the cosine to its nearest centroid: of its own rows and of all others.

    A row's own centroid is taken without the row, so few rows do not look nearer than unseen texts are.
    """
    names, idf, points, owner, size = shared.value
    index = {x: i for i, x in enumerate(names)}
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    seen = np.zeros((len(names), LENGTHS * BINS, 2))
    for batch in batches:
        texts, langs = byte_texts(batch.column("text")), batch.column("lang").to_pylist()
        for a, b in pieces(texts):
            cosine = (vectors(texts[a:b], idf) @ points.T).astype(np.float64)
            lang = np.array([index[x] for x in langs[a:b]])
            row, own = np.arange(b - a), np.where(owner[None] == lang[:, None], cosine, -1).argmax(1)
            part = size[own] * cosine[row, own]
            left = np.sqrt(np.maximum(size[own] ** 2 - 2 * part + 1, 0))
            cosine[row, own] = np.where(left > 1e-3, (part - 1) / np.maximum(left, 1e-3), 0)
            best = np.maximum.reduceat(cosine, start, axis=1)
            at = length_class(texts[a:b])[:, None] * BINS + np.clip(best * BINS, 0, BINS - 1).astype(int)
            each = np.arange(len(names))[None]
            other = (lang[:, None] != each).astype(int)
            np.add.at(seen, (np.broadcast_to(each, at.shape), at, other), 1)
    parts = [(i, at, seen[i, at]) for i in range(len(names)) if len(at := np.flatnonzero(seen[i].any(1)))]
    if parts:
        yield sums.rows(parts, TaskContext.get().partitionId())


def bars(seen: np.ndarray) -> np.ndarray:
    """Least cosine that is not rejected, per language and length, from counts ``(language, length, bin, own or other)``."""
    out = np.zeros(seen.shape[:2])
    every = seen.sum(0)
    for i, of in enumerate(seen):
        if of[:, :, 0].sum() < ENOUGH:  # too few to tell a share: what all languages' rows have to their own
            of = np.stack([every[:, :, 0], of[:, :, 1]], 2)
        rows = of[:, :, 0].sum(1)
        for k in range(LENGTHS):
            low, high = k, k + 1
            while rows[low:high].sum() < ENOUGH and (low > 0 or high < LENGTHS):
                low, high = max(low - 1, 0), min(high + 1, LENGTHS)
            own, other = of[low:high].sum(0).cumsum(0).T
            out[i, k] = (own > OWN_BELOW * own[-1]).argmax() / BINS
            if other[-1]:
                out[i, k] = min(out[i, k], ((other >= OTHERS_BELOW * other[-1]).argmax() + 1) / BINS)
    return out


class Model:
    """Names, gram weights, centroids with their language, and the least cosine not rejected per language and length."""

    def __init__(self, names, idf, points, owner, least):
        self.names, self.idf, self.points, self.owner, self.least = names, idf, points, owner, least

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b in pieces(texts):
            cosine = vectors(texts[a:b], self.idf) @ self.points.T
            best = cosine.argmax(1)
            lang[a:b], score[a:b] = self.owner[best], np.clip(cosine[np.arange(b - a), best], 0, 1)
        return lang, score


def fit(labelled: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE) -> Model | None:
    """Model of all rows of ``labelled(text, lang)``; none if there is no row with a letter and a language."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null").where(F.regexp_like("text", F.lit(r"\p{L}"))).select("text", "lang")
    found = sorted(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return None
    names = [r["lang"] for r in found]
    n = sum(r["count"] for r in found)
    df = sums.collected(sums.add_up(rows.select("text").mapInArrow(_df, sums.SCHEMA), 1), 1, 1, WIDTH)[0, :, 0]
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    each = max(1, sample // len(names))
    share = F.lit(1.0)
    for r in found:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, each / r["count"]))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def vector(batches):
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in pieces(texts):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([v.tobytes() for v in vectors(texts[a:b], idf)], pa.binary())],
                                                 names=["lang", "vector"])

    picked: dict[str, list[np.ndarray]] = {x: [] for x in names}
    for row in drawn.mapInArrow(vector, "lang string, vector binary").limit(8 * sample).collect():
        picked[row["lang"]].append(np.frombuffer(row["vector"], np.float32))
    points, owner = [], []
    for i, name in enumerate(names):
        rows_of = np.stack(sorted(picked[name], key=lambda v: v.tobytes())) if picked[name] else (idf / np.linalg.norm(idf))[None]
        own = start_points(rows_of, k)
        points.append(own)
        owner += [i] * len(own)
    points, owner = np.concatenate(points), np.array(owner)
    shared = spark.sparkContext.broadcast((names, idf, points, owner))
    mean = sums.collected(sums.add_up(rows.mapInArrow(lambda x: _assign(x, shared), sums.SCHEMA), 1), 1, len(points), WIDTH)[:, :, 0]
    size = np.linalg.norm(mean, axis=1, keepdims=True)
    points = np.where(size > 0, mean / np.maximum(size, 1e-12), points).astype(np.float32)
    final = spark.sparkContext.broadcast((names, idf, points, owner, size[:, 0]))
    seen = sums.collected(sums.add_up(rows.mapInArrow(lambda x: _cosines(x, final), sums.SCHEMA), 2), 2, len(names), LENGTHS * BINS)
    least = bars(seen.reshape(len(names), LENGTHS, BINS, 2))
    return Model(names, idf, points, owner, least)


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """All columns of ``docs`` (with ``text``) and ``lang_pred, score, rejected``.

    ``score`` is the cosine to the nearest centroid. A null text, one without a letter, or nothing to learn from gives
    ``und``, score 0 and rejection. Of equally near centroids the one of the first language by name counts. Columns of
    ``docs`` that have one of the three names are replaced.
    """
    model = fit(labelled)
    docs = docs.drop("lang_pred", "score", "rejected")
    und = docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    if model is None:
        return und
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def guess(text: pa.Array) -> pa.Array:
        m = shared.value
        texts = byte_texts(text)
        lang, score = m.predict(texts)
        return pa.StructArray.from_arrays([pa.array([m.names[i] for i in lang], pa.string()), pa.array(score), pa.array(score < m.least[lang, length_class(texts)])],
                                          names=["lang_pred", "score", "rejected"])

    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    made = docs.withColumn("_guess", guess("text"))
    return made.select(
        *docs.columns, F.when(lettered, F.col("_guess.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(lettered, F.col("_guess.score")).otherwise(0.0).alias("score"), (~lettered | F.col("_guess.rejected")).alias("rejected"))


def held_out(doc_id, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % folds == fold


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out("doc_id", 4, 2)).select("text", "lang")
    found = identify(docs.select(F.col("doc_id").cast("long"), "text"), labelled)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
