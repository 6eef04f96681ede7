"""Output parsers, prompts, conversations and report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from curascore.catalog.base import query
from curascore.catalog.labels import vocab_with_failure
from curascore.catalog.sqltext import CHOICES, PARSED, PARSED_VIEWS, ZERO_SHOT
from curascore.functions import prompts as PR
from curascore.functions import text as TX
from curascore.operators import choices as CH
from curascore.operators import labels as L
from curascore.operators import runs as R
from curascore.plans import views as V
from curascore.settings import (
    CHOICE_INSTRUCTION, CONTEXT_INSTRUCTION, DISEASED_TEMPLATES, GRID_BATCH_SIZES, GRID_LEARNING_RATES,
    HEALTHY_TEMPLATES, PURE_INSTRUCTION, QUESTION, TRAIN_SYSTEM,
)


def quoted(text: str) -> str:
    """A SQL string; line breaks are spelt out."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("tx1_parse_output", "select sample_id, label, is_fallback from parsed", PARSED_VIEWS, PARSED)
def _(spark, sf):
    return V.outputs(spark, sf).select("sample_id", TX.parse_output("output").alias("p")).select("sample_id", "p.label", "p.is_fallback")


@query("tx2_parse_key_values", """
select sample_id, case when kv_crop <> '' and kv_disease <> '' then concat(lower(kv_crop), '_', kv_disease) else 'false_parse' end as label
from kv""", PARSED_VIEWS, PARSED)
def _(spark, sf):
    return V.outputs(spark, sf).select("sample_id", TX.parse_key_values("output").alias("label"))


@query("tx3_parse_zero_shot", "select sample_id, label from zero_shot", ("outputs",), ZERO_SHOT)
def _(spark, sf):
    return V.outputs(spark, sf).select("sample_id", TX.parse_zero_shot("output")["label"].alias("label"))


# The same parsers over free text, whole: pages and documents hold no answers, but many odd characters.
@query("tx2_parse_key_values_pages", """
select sample_id, case when kv_crop <> '' and kv_disease <> '' then concat(lower(kv_crop), '_', kv_disease) else 'false_parse' end as label
from kv""", (), {"outputs": "select page_id as sample_id, html as output, '' as source, '' as crop_disease_label from pages", "kv": PARSED["kv"]})
def _(spark, sf):
    return V.table(spark, sf, "pages").select(F.col("page_id").alias("sample_id"), TX.parse_key_values("html").alias("label"))


TEXTS = {"outputs": "select doc_id * 2 as sample_id, text as output, '' as source, '' as crop_disease_label from documents"
                    " union all select page_id * 2 + 1, html, '', '' from pages"}


def _texts(spark, sf):
    docs, pages = V.table(spark, sf, "documents"), V.table(spark, sf, "pages")
    return docs.select((F.col("doc_id") * 2).alias("sample_id"), F.col("text").alias("output")).union(
        pages.select(F.col("page_id") * 2 + 1, "html"))


@query("tx1_parse_output_texts", "select sample_id, label, is_fallback from parsed", ("classes",), {**TEXTS, **PARSED})
def _(spark, sf):
    return _texts(spark, sf).select("sample_id", TX.parse_output("output").alias("p")).select("sample_id", "p.label", "p.is_fallback")


@query("tx3_parse_zero_shot_texts", "select sample_id, label from zero_shot", (), {**TEXTS, **ZERO_SHOT})
def _(spark, sf):
    return _texts(spark, sf).select("sample_id", TX.parse_zero_shot("output")["label"].alias("label"))


def _with_choices(spark, sf, rows=None):
    vocab = V.classes(spark, sf)
    rows = rows if rows is not None else V.samples(spark, sf)
    return CH.build_choices(rows, vocab)


@query("tx4_decode_choice", """
select sample_id, case sample_id % 5 when 4 then 'false_parse' else opts[sample_id % 5 + 1] end as label from choices""",
       ("labelled",), CHOICES)
def _(spark, sf):
    rows = V.choice_outputs(_with_choices(spark, sf))
    return rows.select("sample_id", TX.decode_choice("output", "options").alias("label"))


@query("tx5_build_choices", """
select sample_id, crop_disease_label, opts[1] as a, opts[2] as b, opts[3] as c, opts[4] as d from choices""", ("labelled",), CHOICES)
def _(spark, sf):
    return _with_choices(spark, sf).select(
        "sample_id", "crop_disease_label", *[F.col("options")[k].alias(k.lower()) for k in ("A", "B", "C", "D")])




@query("tx6_resolve_prediction", """
select 'none' as regime, sample_id, label, is_fallback from parsed
union all select 'pure', sample_id, label, false from zero_shot
union all select 'context', sample_id, coalesce((select arg_min(label, list_pos) from classes c where contains(o.output, c.label)), 'false_parse'), false from outputs o
union all select 'mcq', sample_id, case sample_id % 5 when 4 then 'false_parse' else opts[sample_id % 5 + 1] end, false from choices""",
       ("outputs", "labelled"), {**PARSED, **ZERO_SHOT, **CHOICES})
def _(spark, sf):
    vocab = V.classes(spark, sf)
    outs = V.outputs(spark, sf)
    mcq = V.choice_outputs(CH.build_choices(V.samples(spark, sf), vocab))
    parts = [
        ("none", CH.resolve_prediction(outs, None)), ("pure", CH.resolve_prediction(outs, "pure")),
        ("context", CH.resolve_prediction(outs, "context", classes=vocab)), ("mcq", CH.resolve_prediction(mcq, "mcq")),
    ]
    return L.concat(*[df.select(F.lit(r).alias("regime"), "sample_id", "label", "is_fallback") for r, df in parts])


@query("tx6_resolve_by_regime", """
select o.sample_id, case o.sample_id % 4 when 0 then 'none' when 1 then 'pure' when 2 then 'context' else 'mcq' end as regime,
  case o.sample_id % 4 when 0 then p.label when 1 then z.label
    when 2 then coalesce((select arg_min(label, list_pos) from classes c where contains(o.output, c.label)), 'false_parse')
    else case o.sample_id % 5 when 4 then 'false_parse' else opts[o.sample_id % 5 + 1] end end as label,
  o.sample_id % 4 = 0 and p.is_fallback as is_fallback
from outputs o join parsed p on o.sample_id = p.sample_id join zero_shot z on o.sample_id = z.sample_id
join choices h on o.sample_id = h.sample_id""", ("outputs", "labelled"), {**PARSED, **ZERO_SHOT, **CHOICES})
def _(spark, sf):
    vocab = V.classes(spark, sf)
    rows = CH.build_choices(V.samples(spark, sf), vocab)
    regime = F.element_at(F.array(*[F.lit(x) for x in ("none", "pure", "context", "mcq")]), (F.col("sample_id") % 4 + 1).cast("int"))
    text = F.when(F.col("regime") == "mcq", V.choice_text()).otherwise(V.output_text())
    rows = rows.withColumn("regime", regime).withColumn("output", text)
    return CH.resolve_by_regime(rows, classes=vocab).select("sample_id", "regime", "label", "is_fallback")


@query("tx7_parse_outcome", """
select sample_id, label, y_pred::int as y_pred, case when label = 'false_parse' then 'false_parse'
  when y_pred is null then 'out_of_vocabulary' when is_fallback then 'fallback' else 'ok' end as outcome from coded""",
       PARSED_VIEWS, PARSED)
def _(spark, sf):
    rows = CH.with_outcome(CH.resolve_prediction(V.outputs(spark, sf), None), vocab_with_failure(spark, sf))
    return rows.select("sample_id", "label", "y_pred", "outcome")


def _template_sql(template: str) -> str:
    return "replace(replace(" + quoted(template) + ", '{crop}', ct), '{disease}', dt)"


@query("tx8_expand_prompts", f"""
select label, (i - 1)::int as template, case when lower(dt) = 'healthy'
  then [{', '.join(_template_sql(t) for t in HEALTHY_TEMPLATES)}][i] else [{', '.join(_template_sql(t) for t in DISEASED_TEMPLATES)}][i] end as prompt
from (select label, trim(replace(crop, '_', ' ')) as ct, trim(replace(disease, '_', ' ')) as dt from classes) c, range(1, 4) r(i)""",
       ("classes",))
def _(spark, sf):
    # The prompts of each class, from the first row of its label.
    first = L.first_row_for_label(V.samples(spark, sf), "sample_id")
    return first.select("label", F.posexplode(PR.class_prompts()).alias("template", "prompt"))


@query("tx9_display_text", """
select sample_id, trim(replace(crop, '_', ' ')) as crop, trim(replace(disease, '_', ' ')) as disease from samples""", ("samples",))
def _(spark, sf):
    return V.samples(spark, sf).select("sample_id", TX.display_text("crop").alias("crop"), TX.display_text("disease").alias("disease"))


@query("tx10_training_conversation", f"""
select sample_id, 'system,user,assistant' as roles, {quoted(TRAIN_SYSTEM)} as system_text, {quoted(QUESTION)} as user_text,
  'text,image' as user_parts, concat('Class: ', crop, chr(10), 'Disease: ', disease) as answer from samples""", ("samples",))
def _(spark, sf):
    rows = V.samples(spark, sf).select("sample_id", PR.training_conversation().alias("m"))
    return rows.select(
        "sample_id",
        F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"),
        F.col("m")[0]["content"][0]["text"].alias("system_text"),
        F.col("m")[1]["content"][0]["text"].alias("user_text"),
        F.array_join(F.transform(F.col("m")[1]["content"], lambda x: x["type"]), ",").alias("user_parts"),
        F.col("m")[2]["content"][0]["text"].alias("answer"),
    )


_LIST_TEXT = "'[' || array_to_string(list_transform(names, lambda n: '''' || n || ''''), ', ') || ']'"
_OPTS_TEXT = "'{' || array_to_string(list_transform(range(1, 5), lambda i: '''' || chr((64 + i)::int) || ''': ''' || opts[i] || ''''), ', ') || '}'"


@query("tx11_eval_conversation", f"""
select sample_id, 'system,user' as roles, md5({quoted(PURE_INSTRUCTION)}) as pure_text,
  md5(replace({quoted(CONTEXT_INSTRUCTION)}, '{{labels}}', {_LIST_TEXT})) as context_text,
  replace({quoted(CHOICE_INSTRUCTION)}, '{{options}}', {_OPTS_TEXT}) as choice_text, {quoted(QUESTION)} as user_text
from choices, (select list(label order by list_pos) as names from classes) n""", ("labelled",), CHOICES)
def _(spark, sf):
    vocab = V.classes(spark, sf)
    names = L.label_list(vocab, "list_pos")
    rows = CH.build_choices(V.samples(spark, sf), vocab)
    for regime in ("pure", "context", "mcq"):
        rows = rows.withColumn(regime, PR.eval_conversation(PR.instruction(regime, names, F.col("options"))))

    def system(regime):
        return F.col(regime)[0]["content"][0]["text"]

    return rows.select(
        "sample_id",
        F.array_join(F.transform("pure", lambda x: x["role"]), ",").alias("roles"),
        F.md5(system("pure")).alias("pure_text"), F.md5(system("context")).alias("context_text"),
        system("mcq").alias("choice_text"), F.col("pure")[1]["content"][0]["text"].alias("user_text"),
    )


# The regime in a column, and the list of labels as a table of one row instead of a literal.
@query("tx11_instruction_by_regime", f"""
select sample_id, regime, md5(case regime when 'context' then replace({quoted(CONTEXT_INSTRUCTION)}, '{{labels}}', {_LIST_TEXT})
  when 'mcq' then replace({quoted(CHOICE_INSTRUCTION)}, '{{options}}', {_OPTS_TEXT}) else {quoted(PURE_INSTRUCTION)} end) as instruction
from (select *, case sample_id % 3 when 0 then 'pure' when 1 then 'context' else 'mcq' end as regime from choices) c,
  (select list(label order by list_pos) as names from classes) n""", ("labelled",), CHOICES)
def _(spark, sf):
    vocab = V.classes(spark, sf)
    regime = F.element_at(F.array(F.lit("pure"), F.lit("context"), F.lit("mcq")), (F.col("sample_id") % 3 + 1).cast("int"))
    rows = CH.build_choices(V.samples(spark, sf), vocab).withColumn("regime", regime)
    return CH.with_instruction(rows, vocab).select("sample_id", "regime", F.md5("instruction").alias("instruction"))


@query("tx12_answer_text", "select sample_id, concat('Class: ', crop, chr(10), 'Disease: ', disease) as answer from samples", ("samples",))
def _(spark, sf):
    return V.samples(spark, sf).select("sample_id", TX.answer_text().alias("answer"))


_BODY = "replace(replace(replace(replace(output, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


@query("tx13_escape_output", f"""
select sample_id, case when contains(output, '''') and not contains(output, '"') then '"' || {_BODY} || '"'
  else '''' || replace({_BODY}, '''', '\\''') || '''' end as escaped from outputs""", ("outputs",))
def _(spark, sf):
    return V.outputs(spark, sf).select("sample_id", TX.escape_output("output").alias("escaped"))


PARSED_RUNS = {
    "pr0": "select run_pos, path, regexp_replace(path, '^(.+)[.][^.]*$', '\\1') as stem from run_files where path like '%.pth'",
    "pr1": """select *, regexp_extract(stem, '^([^_]+)_model_exp_(\\d*\\.?\\d+(?:e-?\\d+)?)_(\\d+)$', ['m', 'lr', 'b']) as f,
      regexp_extract(stem, '^([^_]+)_model_exp_(\\d+)$', ['m', 'id']) as s from pr0""",
    "pr2": """select run_pos, path, coalesce(nullif(f.m, ''), nullif(s.m, '')) as model,
      try_cast(nullif(f.lr, '') as double) as lr, try_cast(nullif(f.b, '') as int) as b, try_cast(nullif(s.id, '') as bigint) as id from pr1""",
    "parsed_runs": f"""select run_pos, path, model, id as experiment_id,
      coalesce(b, case when id < 9 then ({GRID_BATCH_SIZES})[id // 3 + 1] end)::int as batch_size,
      coalesce(lr, case when id < 9 then ({GRID_LEARNING_RATES})[id % 3 + 1] end)::double as learning_rate,
      case when model is null then 'skipped' when id >= 9 then 'out_of_range' else 'ok' end as status from pr2""",
}


@query("tx14_parse_run_name", "select * from parsed_runs", ("run_files",), PARSED_RUNS)
def _(spark, sf):
    return R.parse_run_files(V.run_files(spark, sf))


@query("tx14_skipped_files", "select path as file from parsed_runs where status = 'skipped'", ("run_files",), PARSED_RUNS)
def _(spark, sf):
    return R.skipped_files(R.parse_run_files(V.run_files(spark, sf)))


_SHOWN = "case when model = 'small' then 'Small' else 'Other' end || ' Batch=' || batch_size::varchar || ' LR=' || learning_rate::varchar"


@query("tx15_pretty_run_name", f"""
select run_name, l.path as path, l.batch_size as batch_size, l.learning_rate as learning_rate, n_files from (
  select {_SHOWN} as run_name, arg_max({{'path': path, 'batch_size': batch_size, 'learning_rate': learning_rate}},
    row(path, run_pos)) as l, count(*) as n_files from parsed_runs where status = 'ok' group by 1) r""", ("run_files",), PARSED_RUNS)
def _(spark, sf):
    parsed = R.parse_run_files(V.run_files(spark, sf))
    return R.named_runs(parsed, {"small": "Small"}, "Other")


@query("tx16_format_probability", "select event_id, format('{:.6f}', value / 100.0::double) as prob from events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", TX.format_probability(F.col("value") / 100.0).alias("prob"))
