"""Projections, filters, joins and set operators over samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curascore.catalog.base import query
from curascore.catalog.sqltext import (
    CONFUSION, PARSED, PARSED_VIEWS, PER_CLASS, PROTOTYPES, SCORES, confusion_sql, per_class_sql,
)
from curascore.functions.text import cast_label, compose_label, parse_output, parse_run_name
from curascore.operators import labels as L
from curascore.operators import positions as P
from curascore.operators.choices import context_match
from curascore.operators.lookup import Dimension, bounded
from curascore.operators.metrics import combine_views, confusion_long, per_class_counts, per_class_metrics
from curascore.operators.runs import grid, resolve_experiment
from curascore.operators.scoring import class_prototypes, score_pairs
from curascore.plans import views as V
from curascore.settings import FALSE_PARSE, GRID_BATCH_SIZES, GRID_LEARNING_RATES

ORDER = ["split", "crop_disease_label", "sample_id"]
SAMPLE_COLUMNS = "sample_id, crop, disease, source, split, crop_disease_label"


def positioned(spark, sf):
    return P.positions(V.samples(spark, sf), ORDER, row_id="sample_id")


def vocab_with_failure(spark, sf) -> Dimension:
    """(label, class_id) of the class list plus the failure class, whose id follows the last one."""
    classes = V.classes(spark, sf)
    failure = spark.range(1).select(F.lit(FALSE_PARSE).alias("label"), F.lit(V.N_CLASSES).cast("int").alias("class_id"))
    return bounded(classes.frame.select("label", "class_id").unionByName(failure))


# ---------------------------------------------------------------- projections and filters

@query("pf1_source_view", f"select {SAMPLE_COLUMNS} from samples where source = 'lab'", ("samples",))
def _(spark, sf):
    return L.source_view(V.samples(spark, sf), "lab")


@query("pf2_prune_columns", "select numeric_label::int as numeric_label, source from labelled", ("labelled",))
def _(spark, sf):
    return L.prune_columns(V.labelled(spark, sf), ["numeric_label", "source"])


@query("pf3_compose_label", "select sample_id, concat(lower(crop),'_',disease) as label from samples", ("samples",))
def _(spark, sf):
    return V.samples(spark, sf).select("sample_id", compose_label().alias("label"))


@query("pf4_cast_label", """
select conv_id, turn, word, try_cast(case when regexp_full_match(word, '[+-]?[0-9]+') then word end as int) as value
from (select conv_id, turn, unnest(string_split(text, ' ')) as word from conversations) w""")
def _(spark, sf):
    words = V.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    whole = F.when(F.rlike("word", F.lit(r"^[+-]?[0-9]+\z")), F.col("word"))
    return words.select("conv_id", "turn", "word", cast_label(whole).alias("value"))


@query("pf5_slice_by_position", f"select {SAMPLE_COLUMNS}, pos from positioned where pos >= 1324 and pos < 1370", ("positioned",))
def _(spark, sf):
    return P.rank_range(V.samples(spark, sf), ORDER, 1324, 1370)


_SPLIT_POS = """select *, row_number() over (partition by split order by crop_disease_label, sample_id) - 1 as spos from samples"""
_INDEX = """select split, crop, disease, min(spos) as start_pos, max(spos) as last_pos, count(*) as n from sp group by all"""


@query("pf6_assign_blocks", """
select s.sample_id, s.split, s.spos as pos, i.crop as block_crop, i.disease as block_disease
from sp s join idx i on s.split = i.split and s.spos >= i.start_pos and s.spos < i.last_pos""",
       ("samples",), {"sp": _SPLIT_POS, "idx": _INDEX})
def _(spark, sf):
    # The index is used as published: ends are the last positions, taken as exclusive.
    rows = P.split_positions(positioned(spark, sf))
    index = P.build_block_index(rows, end_inclusive=True).select(
        "split", F.col("crop").alias("block_crop"), F.col("disease").alias("block_disease"), "start_pos", "end_pos")
    tagged = P.assign_blocks(rows, index)
    return tagged.select("sample_id", "split", "pos", "block_crop", "block_disease")


@query("pf7_build_block_index", """
select split, crop, disease, start_pos, last_pos + 1 as end_pos, last_pos - start_pos + 1 = n as is_contiguous from idx""",
       ("samples",), {"sp": _SPLIT_POS, "idx": _INDEX})
def _(spark, sf):
    return P.build_block_index(P.split_positions(positioned(spark, sf)))


@query("pf8_row_at", f"select {SAMPLE_COLUMNS}, pos from positioned where pos = 1366", ("positioned",))
def _(spark, sf):
    return P.rank_range(V.samples(spark, sf), ORDER, 1366, 1367)


@query("pf9_first_row_for_label", """
select crop_disease_label as label, arg_min(crop, sample_id) as crop, arg_min(disease, sample_id) as disease
from samples group by crop_disease_label""", ("samples",))
def _(spark, sf):
    return L.first_row_for_label(V.samples(spark, sf), "sample_id")


def _parsed(spark, sf):
    return V.outputs(spark, sf).withColumn("_p", parse_output("output")).select("sample_id", "_p.label", "_p.is_fallback")


@query("pf10_in_vocabulary", "select sample_id, label, is_fallback from parsed where label in (select label from vocab)",
       PARSED_VIEWS, PARSED)
def _(spark, sf):
    return L.in_vocabulary(_parsed(spark, sf), vocab_with_failure(spark, sf)).select("sample_id", "label", "is_fallback")


@query("pf10_out_of_vocabulary", "select sample_id, label, is_fallback from parsed where label not in (select label from vocab)",
       PARSED_VIEWS, PARSED)
def _(spark, sf):
    return L.in_vocabulary(_parsed(spark, sf), vocab_with_failure(spark, sf), invert=True).select("sample_id", "label", "is_fallback")


@query("pf11_positions", f"select {SAMPLE_COLUMNS}, pos from positioned", ("positioned",))
def _(spark, sf):
    return positioned(spark, sf)


# ---------------------------------------------------------------- joins

@query("j1_encode_labels", "select sample_id, crop_disease_label, numeric_label::int as class_id from labelled", ("labelled",))
def _(spark, sf):
    return L.encode_labels(V.samples(spark, sf), V.classes(spark, sf)).select("sample_id", "crop_disease_label", "class_id")


@query("j2_decode_labels", """
select p.sample_id, p.id::int as class_id, c.label, u.label as unsorted_label
from (select sample_id, y_pred + sample_id % 2 as id from predictions) p
left join classes c on p.id = c.class_id left join classes u on p.id = u.list_pos""", ("predictions",))
def _(spark, sf):
    # Ids past the last class decode to null; the second label decodes through the unsorted list instead.
    vocab = V.classes(spark, sf)
    ids = V.shape_predictions(V.labelled(spark, sf, vocab)).select(
        "sample_id", (F.col("y_pred") + F.col("sample_id") % 2).cast("int").alias("class_id"))
    listed = Dimension(vocab.frame.select("label", F.col("list_pos").alias("class_id")), vocab.rows)
    return L.decode_labels(L.decode_labels(ids, vocab), listed, name="unsorted_label").select(
        "sample_id", "class_id", "label", "unsorted_label")


@query("j3_build_label_map", """
select crop_disease_label as label, cast(arg_max(numeric_label, sample_id) as int) as class_id from labelled group by 1
union all select 'false_parse', 65""", ("labelled",))
def _(spark, sf):
    return L.build_label_map(V.labelled(spark, sf), "sample_id", class_id="numeric_label")


@query("j4_grid", f"""
select model, ((b.i - 1) * 3 + l.j - 1)::bigint as experiment_id, {GRID_BATCH_SIZES}[b.i]::int as batch_size,
  {GRID_LEARNING_RATES}[l.j]::double as learning_rate
from (select distinct lower(p_type) as model from part) m, range(1, 4) b(i), range(1, 4) l(j)""")
def _(spark, sf):
    return grid(V.table(spark, sf, "part").select(F.lower("p_type").alias("model")).distinct())


@query("j5_resolve_experiment", f"""
select run_pos, id as experiment_id,
  case when id < 9 then ({GRID_BATCH_SIZES})[id // 3 + 1] end::int as grid_batch_size,
  case when id < 9 then ({GRID_LEARNING_RATES})[id % 3 + 1] end::double as grid_learning_rate, id < 9 as resolved
from (select run_pos, try_cast(nullif(regexp_extract(path, '^([^_]+)_model_exp_(\\d+)[.]pth$', 2), '') as bigint) as id
  from run_files) r where id is not null""", ("run_files",))
def _(spark, sf):
    runs = V.run_files(spark, sf).select("run_pos", parse_run_name("path")["experiment_id"].alias("experiment_id"))
    return resolve_experiment(runs.where(F.col("experiment_id").isNotNull()))


@query("j6_densify_classes", """
select r.i::int as class_id, coalesce(c.n, 0)::bigint as n from range(65) r(i)
left join (select y_true, count(*) as n from features group by 1) c on c.y_true = r.i""", ("features",))
def _(spark, sf):
    counts = V.features(spark, sf).groupBy(F.col("y_true").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return L.densify_classes(counts, 65)


@query("j7_score_pairs", "select sample_id, class_id, round(score, 6) as score from scores", ("features",), {**PROTOTYPES, **SCORES})
def _(spark, sf):
    rows = V.features(spark, sf)
    pairs = score_pairs(rows, class_prototypes(rows))
    return pairs.select("sample_id", "class_id", F.round("score", 6).alias("score"))


@query("j8_context_match", """
select sample_id, coalesce((select arg_min(label, list_pos) from classes c where contains(o.output, c.label)), 'false_parse') as label
from outputs o""", ("outputs", "classes"))
def _(spark, sf):
    return context_match(V.outputs(spark, sf), V.classes(spark, sf)).select("sample_id", "label")


# The form for class lists that are too large to ship, forced.
@query("j8_context_match_join", """
select sample_id, coalesce((select arg_min(label, list_pos) from classes c where contains(o.output, c.label)), 'false_parse') as label
from outputs o""", ("outputs", "classes"))
def _(spark, sf):
    return context_match(V.outputs(spark, sf), Dimension(bounded(V.classes(spark, sf)).frame, None)).select("sample_id", "label")


# Whole documents and pages against class names that do occur in them.
@query("j8_context_match_texts", """
select t.sample_id, coalesce((select arg_min(c.label, c.list_pos) from words c where contains(t.text, c.label)), 'false_parse') as label
from texts t""", (), {
    "words": "select label, (row_number() over (order by md5(label)) - 1)::int as list_pos from (select distinct upper(p_brand) as label from part"
             " union select distinct n_name from nation union select 'and the of' union select 'ententeel' union select 'thion') w",
    "texts": "select doc_id * 2 as sample_id, text from documents union all select page_id * 2 + 1, html from pages"})
def _(spark, sf):
    t = lambda name: V.table(spark, sf, name)
    own = spark.createDataFrame([("and the of",), ("ententeel",), ("thion",)], "label string")
    words = t("part").select(F.upper("p_brand").alias("label")).union(t("nation").select("n_name")).union(own).distinct()
    ranked = words.withColumn("list_pos", (F.row_number().over(Window.orderBy(F.md5("label"))) - 1).cast("int"))
    texts = t("documents").select((F.col("doc_id") * 2).alias("sample_id"), F.col("text").alias("output")).union(
        t("pages").select(F.col("page_id") * 2 + 1, "html"))
    return context_match(texts, ranked).select("sample_id", "label")


@query("j9_distractor_candidates", """
select sample_id, len(cand)::int as n_candidates, md5(array_to_string(cand, ',')) as digest
from (select sample_id, list_filter(names, lambda x: x <> crop_disease_label) as cand
  from samples, (select list(label order by class_id) as names from classes) v) s""", ("samples", "classes"))
def _(spark, sf):
    names = L.label_list(V.classes(spark, sf))
    rows = L.distractor_candidates(V.samples(spark, sf), names)
    return rows.select("sample_id", F.size("candidates").alias("n_candidates"), F.md5(F.array_join("candidates", ",")).alias("digest"))


# The same candidates by reference: rows hold a list and a left-out place, and are written out here only.
@query("j9_distractors_by_reference", """
select sample_id, c.class_id::bigint as left_out, b.first, md5(array_to_string(list_filter(b.labels, lambda x: x <> crop_disease_label), ',')) as digest
from samples s join classes c on s.crop_disease_label = c.label,
  (select class_id // 1024 * 1024 as first, list(label order by class_id) as labels from classes group by 1) b
where len(list_filter(b.labels, lambda x: x <> crop_disease_label)) > 0""", ("samples", "classes"))
def _(spark, sf):
    refs, blocks = L.distractor_references(V.samples(spark, sf), V.classes(spark, sf))
    return L.distractors(refs, blocks).select("sample_id", "left_out", "first", F.md5(F.array_join("candidates", ",")).alias("digest"))


def per_class_wide_sql(keys: str = "", runs: str = "", names: str = "classes") -> str:
    """All classes of ``names`` with the metrics of the three views side by side; ``runs`` lists the keys."""
    k, on = (f"{keys}, ", f" and p.{keys} = g.{keys}") if keys else ("", "")
    grid = f"(select r.{keys}, c.class_id, c.label from ({runs}) r, {names} c)" if keys else names
    return f"select {'g.' + k if k else ''}g.class_id::int as class_id, g.label,\n  " + ",\n  ".join(
        f"round(coalesce(max(case when p.view = '{v}' then p.{m} end), 0), 6) as {m}_{v}"
        for m in ("f1", "precision", "recall") for v in ("main", "lab", "field")
    ) + f"\nfrom {grid} g left join per_class p on p.class_id = g.class_id{on} group by {'g.' + k if k else ''}g.class_id, g.label"


def rounded_table(wide, *fixed):
    return wide.select(*fixed, *[F.round(c, 6).alias(c) for c in wide.columns if c not in fixed])


@query("j10_combine_views", per_class_wide_sql(), ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    metrics = per_class_metrics(per_class_counts(confusion_long(V.predictions(spark, sf))))
    return rounded_table(combine_views(metrics, classes=V.classes(spark, sf).frame), "class_id", "label")


# One table per run, with all classes in each: of the nine runs, some miss classes in some views.
@query("j10_combine_views_by_run", per_class_wide_sql("run_id", "select distinct run_id from run_preds"), ("predictions",), {
    "run_preds": "select *, sample_id % 9 as run_id from predictions where sample_id % 9 < 4 or y_true % 2 = 0",
    **confusion_sql("run_preds", "run_id"), **per_class_sql("run_id")})
def _(spark, sf):
    rows = V.predictions(spark, sf).withColumn("run_id", F.col("sample_id") % 9).where("run_id < 4 or y_true % 2 = 0")
    metrics = per_class_metrics(per_class_counts(confusion_long(rows, ["run_id"]), ["run_id"]))
    return rounded_table(combine_views(metrics, ["run_id"], V.classes(spark, sf).frame), "run_id", "class_id", "label")


# ---------------------------------------------------------------- vocabulary and sets

@query("sw4_dense_label_ids", "select label, class_id::int as class_id from classes", ("classes",))
def _(spark, sf):
    return L.dense_label_ids(V.samples(spark, sf))


@query("sw4_dense_label_ids_per_split", """
select split, label, (row_number() over (partition by split order by label) - 1)::int as class_id
from (select distinct split, crop_disease_label as label from samples) d""", ("samples",))
def _(spark, sf):
    return L.dense_label_ids(V.samples(spark, sf), per_split=True)


@query("ag9_vocabulary", "select distinct crop_disease_label as label from samples", ("samples",))
def _(spark, sf):
    return L.vocabulary(V.samples(spark, sf))


@query("ag9_vocabulary_size", "select count(distinct crop_disease_label) as n_classes from samples", ("samples",))
def _(spark, sf):
    return L.vocabulary_size(V.samples(spark, sf))


@query("st1_concat", f"""
select {SAMPLE_COLUMNS} from samples where source = 'lab' union all select {SAMPLE_COLUMNS} from samples where source = 'field'""",
       ("samples",))
def _(spark, sf):
    rows = V.samples(spark, sf)
    return L.concat(L.source_view(rows, "lab"), L.source_view(rows, "field"))


@query("st2_difference", """
select distinct crop_disease_label as label from samples
where crop_disease_label not in (select crop_disease_label from samples where source = 'lab')""", ("samples",))
def _(spark, sf):
    rows = V.samples(spark, sf)
    return L.label_difference(L.vocabulary(rows), L.vocabulary(L.source_view(rows, "lab")))


@query("st2_column_difference", "select sample_id, crop, disease, split, crop_disease_label from labelled", ("labelled",))
def _(spark, sf):
    rows = V.labelled(spark, sf)
    return rows.select(*L.column_difference(rows, ["numeric_label", "source"]))


@query("st3_distinct_labels", "select distinct split, crop_disease_label as label from samples", ("samples",))
def _(spark, sf):
    return V.samples(spark, sf).select("split", F.col("crop_disease_label").alias("label")).distinct()
