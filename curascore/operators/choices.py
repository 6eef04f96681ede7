"""Multiple-choice options and the choice of parser by regime."""

from __future__ import annotations

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curascore.functions.hashing import col_of, hex_word, seed_key
from curascore.functions.lets import let
from curascore.functions.prompts import instruction
from curascore.functions.text import decode_choice, escape_output, first_contained, parse_output, parse_zero_shot
from curascore.operators.class_stream import chunk_parts, past_chunks
from curascore.operators.labels import encode_labels, label_list, listed
from curascore.operators.lookup import Dimension, bounded, lookup_join
from curascore.session import scratch_path
from curascore.settings import CHOICE_KEYS, CONTEXT_INSTRUCTION, EVALUATION_SEED, FALSE_PARSE

MAX_BRANCHES = 512  # labels searched by one compiled expression
BLOCK_CHARS = 2_000_000  # of labels in one automaton
TEXT_BYTES = 32 * 1024 * 1024  # of distinct outputs that a task holds while automata pass


def _with_slots(df: DataFrame, position: str, n_labels: int, seed: int, row_id: str) -> tuple[DataFrame, list[Column]]:
    """(frame, label positions of the four options): three distinct distractors and the true label.

    One md5 gives four words: three draw distractors without replacement from the other labels, the last one
    picks the slot of the true label. Distractors keep their draw order, which is random already. The steps are
    plain columns, so that they compile and each runs once.
    """
    # A true label outside the vocabulary leaves all labels as distractors.
    others = F.when(F.col(position).isNull(), F.lit(n_labels)).otherwise(F.lit(n_labels - 1)).cast("bigint")
    word = lambda i: hex_word(F.col("_h"), i)
    a, b, x, k, p = (F.col(c) for c in ("_a", "_b", "_x", "_k", position))
    out = (
        df.withColumn("_h", seed_key(seed, row_id))
        .withColumns({"_a": word(0) % others, "_b": word(1) % (others - 1), "_x": word(2) % (others - 2), "_k": (word(3) % 4).cast("int")})
        .withColumn("_b", F.when(b >= a, b + 1).otherwise(b))
        # Skip both drawn positions, the lower one first.
        .withColumn("_x", F.when(x >= F.least(a, b), x + 1).otherwise(x))
        .withColumn("_x", F.when(x >= F.greatest(a, b), x + 1).otherwise(x))
        # Positions among the other labels -> positions in the whole list.
        .withColumns({c: F.when(F.col(c) >= p, F.col(c) + 1).otherwise(F.col(c)).cast("int") for c in ("_a", "_b", "_x")})
        .drop("_h")
    )
    slots = [
        F.when(k == 0, p).otherwise(a),
        F.when(k == 1, p).when(k < 1, a).otherwise(b),
        F.when(k == 2, p).when(k < 2, b).otherwise(x),
        F.when(k == 3, p).otherwise(x),
    ]
    return out, slots


def build_choices(df: DataFrame, vocab: DataFrame | Dimension, seed: int = EVALUATION_SEED, row_id: str = "sample_id",
                  label: str = "crop_disease_label") -> DataFrame:
    """Add ``options``: a map A-D to the true label and three random others. Needs a vocabulary of at least 4.

    The true label is an option whether or not the vocabulary has it. Rows may share a ``row_id``.
    """
    table = bounded(vocab)
    coded = encode_labels(df, table, label).withColumnRenamed("class_id", "_pos")
    keys = F.array(*[F.lit(k) for k in CHOICE_KEYS])
    labels = label_list(table)
    if labels is not None:
        drawn, slots = _with_slots(coded, "_pos", len(labels), seed, row_id)
        names = F.array(*[F.lit(x) for x in labels])
        options = F.map_from_arrays(keys, F.array(*[F.coalesce(F.get(names, slot), F.col(label)) for slot in slots]))
        return drawn.select(*df.columns, options.alias("options"))
    # Vocabulary too large to ship: look up the four positions one after the other; rows stay as they are.
    drawn, slots = _with_slots(coded, "_pos", table.frame.count(), seed, row_id)
    out = drawn.select(*df.columns, *[slot.alias(f"_s{i}") for i, slot in enumerate(slots)])
    for i in range(len(slots)):
        out = lookup_join(out, table.frame.select(F.col("class_id").alias(f"_s{i}"), F.col("label").alias(f"_o{i}")), f"_s{i}", "left")
    options = F.map_from_arrays(keys, F.array(*[F.coalesce(F.col(f"_o{i}"), F.col(label)) for i in range(len(slots))]))
    return out.select(*df.columns, options.alias("options"))


def with_instruction(df: DataFrame, vocab: DataFrame | Dimension, regime: str = "regime", options: str = "options", name: str = "instruction") -> DataFrame:
    """Add the system text of each row's regime, for a vocabulary of any size.

    The text that lists the labels is the same for all rows: it is put together once, from the blocks of the list, and
    joined as a table of one row, instead of being a literal with every label in the plan.
    """
    shown = F.transform("labels", escape_output)
    pieces = listed(vocab, "list_pos").select("first", F.array_join(shown, ", ").alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda p: p["text"])
    one = pieces.agg(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("_labels")).withColumn("_one", F.lit(1))
    rows = lookup_join(df.withColumn("_one", F.when(F.col(regime) == "context", 1)), one, "_one", "left")
    text = instruction(F.col(regime), [], F.col(options) if options in df.columns else None)
    before, after = CONTEXT_INSTRUCTION.split("{labels}")
    text = F.when(F.col(regime) == "context", F.concat(F.lit(before), F.col("_labels"), F.lit(after))).otherwise(text)
    return rows.withColumn(name, text).drop("_one", "_labels")


def context_match(df: DataFrame, classes: DataFrame | Dimension, output: str = "output", name: str = "label") -> DataFrame:
    """First label in list order that occurs in the output, else ``false_parse``.

    A short class list becomes one compiled expression; a longer one is searched with multi-pattern automata, in
    blocks of labels.
    """
    table = bounded(classes)
    labels = label_list(table, "list_pos")
    if labels is not None and len(labels) <= MAX_BRANCHES:
        return df.withColumn(name, first_contained(output, labels))
    return _context_match_by_automaton(df, table.frame, output, name)


def _context_match_by_automaton(df: DataFrame, classes: DataFrame, output: str, name: str) -> DataFrame:
    """Labels are packed into blocks of bounded size that stream past chunks of distinct outputs.

    A block becomes one goto/fail automaton, which reads each output of the chunk once, whatever the number and length
    of its labels; the least list position found so far is kept per output. Rows are the distinct outputs, by digest.
    """

    def pack(batches):
        for batch in batches:
            labels, places = batch.column("label").to_pylist(), batch.column("list_pos").to_pylist()
            start = size = 0
            for i, label in enumerate(labels):
                size += len(label) + 1
                if size >= BLOCK_CHARS or i + 1 == len(labels):
                    yield pa.RecordBatch.from_pydict({"_block": pa.array([places[start]], pa.int64()), "_labels": pa.array([labels[start : i + 1]], pa.list_(pa.string())),
                                                      "_places": pa.array([places[start : i + 1]], pa.list_(pa.int64()))})
                    start, size = i + 1, 0

    def search(batches):
        now, held = None, []

        def found():
            keys = [k for k, _, best in held if best is not None]
            places = [best[0] for _, _, best in held if best is not None]
            names = [best[1] for _, _, best in held if best is not None]
            return pa.RecordBatch.from_pydict({"_key": pa.array(keys, pa.string()), "_place": pa.array(places, pa.int64()), "_label": pa.array(names, pa.string())})

        for chunk, is_block, part in chunk_parts(batches):
            if chunk != now:
                yield found()
                now, held = chunk, []
            if not is_block:
                held += [[k, t, None] for k, t in zip(part.column("_key").to_pylist(), part.column("_text").to_pylist(), strict=True)]
                continue
            for labels, places in zip(part.column("_labels").to_pylist(), part.column("_places").to_pylist(), strict=True):
                automaton, least = Automaton(), None
                for label, place in sorted(zip(labels, places, strict=True), key=lambda x: -x[1]):
                    if label:
                        automaton.add_word(label, (place, label))  # of equal labels the first in the list stays
                    else:
                        least = (place, label)
                automaton.make_automaton()
                for row in held:
                    hits = (hit for _, hit in automaton.iter(row[1])) if len(automaton) else ()
                    best = min(hits, default=None)
                    row[2] = min((x for x in (row[2], best, least) if x is not None), default=None)
        yield found()

    keyed = df.withColumn("_key", F.md5(output))
    texts = keyed.where("_key is not null").select("_key", F.col(output).alias("_text")).dropDuplicates(["_key"])
    path = scratch_path(df.sparkSession, "labels")
    schema = "_block long, _labels array<string>, _places array<long>"
    listed = classes.where("label is not null").select("label", F.col("list_pos").cast("long").alias("list_pos"))
    listed.mapInArrow(pack, schema).write.parquet(path)
    blocks = df.sparkSession.read.schema(schema).parquet(path)
    size = texts.agg(F.sum(F.octet_length("_text") + 100).alias("b")).first()["b"] or 0
    both = past_chunks(texts.withColumn("_h", F.xxhash64("_key")), blocks, max(1, -(-size // TEXT_BYTES)), "_h")
    best = both.mapInArrow(search, "_key string, _place long, _label string").select("_key", F.col("_label").alias(name))
    return lookup_join(keyed, best, "_key", "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(FALSE_PARSE)))


def resolve_prediction(df: DataFrame, regime: str | None, output: str = "output", classes: DataFrame | Dimension | None = None,
                       options: str = "options") -> DataFrame:
    """Add ``label`` and ``is_fallback`` with the parser of the regime: None, ``pure``, ``context`` or ``mcq``.

    The last two set no fallback flag.
    """
    if regime == "context":
        if classes is None:
            raise ValueError("the context regime needs the class list")
        return context_match(df, classes, output).withColumn("is_fallback", F.lit(False))
    if regime == "mcq":
        return df.withColumn("label", decode_choice(output, options)).withColumn("is_fallback", F.lit(False))
    parser = parse_zero_shot if regime == "pure" else parse_output
    return df.withColumn("_p", parser(output)).select("*", "_p.label", "_p.is_fallback").drop("_p")


def resolve_by_regime(df: DataFrame, regime: str = "regime", output: str = "output",
                      classes: DataFrame | Dimension | None = None, options: str = "options") -> DataFrame:
    """Like ``resolve_prediction``, with the regime in a column, so that runs of several regimes go in one pass.

    A row whose regime needs the class list or the options, where these were not given, is an error when it is read.
    """
    r = F.col(regime)
    table = bounded(classes) if classes is not None else None
    labels = label_list(table, "list_pos") if table is not None else None
    if table is not None and (labels is None or len(labels) > MAX_BRANCHES):
        # A long class list is matched by join, so those rows take their own path.
        others = resolve_by_regime(df.where(~r.eqNullSafe("context")), regime, output, None, options)
        return others.unionByName(resolve_prediction(df.where(r == "context"), "context", output, table).select(others.columns))

    def plain(label: Column) -> Column:
        return F.struct(label.alias("label"), F.lit(False).alias("is_fallback"))

    def missing(what: str) -> Column:
        return plain(F.raise_error(F.lit(what)).cast("string"))

    chosen = F.when(r == "pure", parse_zero_shot(output))
    chosen = chosen.when(r == "context", plain(first_contained(output, labels)) if labels is not None else missing("the context regime needs the class list"))
    chosen = chosen.when(r == "mcq", plain(decode_choice(output, options)) if options in df.columns else missing("the mcq regime needs the options"))
    return df.withColumn("_p", chosen.otherwise(parse_output(output))).select("*", "_p.label", "_p.is_fallback").drop("_p")


def with_outcome(df: DataFrame, vocab: DataFrame | Dimension, name: str = "outcome") -> DataFrame:
    """Add ``y_pred`` (null outside the vocabulary) and the outcome of each row.

    ``vocab`` holds (label, class_id) and includes the failure class.
    """
    coded = encode_labels(df, vocab, "label").withColumnRenamed("class_id", "y_pred")
    return coded.withColumn(name, outcome_of(F.col("label"), F.col("is_fallback"), F.col("y_pred").isNotNull()))


def outcome_of(label: Column | str, is_fallback: Column, is_known: Column) -> Column:
    return (
        F.when(col_of(label) == FALSE_PARSE, FALSE_PARSE)
        .when(~is_known, "out_of_vocabulary")
        .when(is_fallback, "fallback")
        .otherwise("ok")
    )
