"""Confusion counts, metrics, baselines, runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from curascore.catalog.base import query
from curascore.catalog.labels import ORDER, per_class_wide_sql, rounded_table, vocab_with_failure
from curascore.catalog.sqltext import (
    CHOICES, CONFUSION, PARSED, PARSED_VIEWS, PER_CLASS, PROTOTYPES, SCORES, ZERO_SHOT, confusion_sql, dot_sql, macro_sql, per_class_sql,
)
from curascore.catalog.vectors import _BEST, _head
from curascore.operators import baselines as B
from curascore.operators import choices as CH
from curascore.operators import metrics as M
from curascore.operators import positions as P
from curascore.operators import runs as R
from curascore.operators.labels import decode_labels
from curascore.operators.lookup import bounded
from curascore.plans import feature_eval, text_eval
from curascore.plans import views as V
from curascore.session import scratch_path
from curascore.sources import heads

N = V.N_CLASSES


def rounded(df, *names):
    """Floats at 6 decimals, for comparison."""
    chosen = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[F.round(c, 6).alias(c) if c in chosen else F.col(c) for c in df.columns])


def _counts(spark, sf):
    return M.confusion_long(V.predictions(spark, sf))


@query("ag10_confusion_long", "select view, y_true::int as y_true, y_pred::int as y_pred, n from confusion", ("predictions",), CONFUSION)
def _(spark, sf):
    return _counts(spark, sf)


_WIDE = ", ".join(f"coalesce(sum(n) filter (y_pred = {i}), 0)::bigint as p{i}" for i in range(N))
WIDE = {"wide": f"""select v.view, r.i::int as y_true, {_WIDE} from (select distinct view from confusion) v cross join range({N}) r(i)
  left join confusion c on c.view = v.view and c.y_true = r.i group by all"""}


@query("ag11_confusion_matrix", "select * from wide", ("predictions",), {**CONFUSION, **WIDE})
def _(spark, sf):
    return M.confusion_matrix(_counts(spark, sf), N)


@query("ag12_per_class_counts", """
select view, class_id::int as class_id, tp, fp, fn, tp + fn as support, tp + fp as predicted from per_class""",
       ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    return M.per_class_counts(_counts(spark, sf))


@query("ag13_per_class_metrics", """
select view, class_id::int as class_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from per_class""",
       ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    rows = M.per_class_metrics(M.per_class_counts(_counts(spark, sf)))
    return rounded(rows.select("view", "class_id", "precision", "recall", "f1"))


@query("ag14_macro_metrics", macro_sql() + " having view = 'main'", ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    rows = M.macro_metrics(M.per_class_metrics(M.per_class_counts(_counts(spark, sf))))
    return rounded(rows.where("view = 'main'"))


@query("ag15_metrics_by_view", macro_sql(), ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    return rounded(M.metrics_by_view(V.predictions(spark, sf)))


_QUALITY = {"cv": "select 'main' as view, * from coded union all select source as view, * from coded"}


@query("ag16_parse_quality", """
select view, count(*) as total, count(*) filter (y_pred is not null and label = 'false_parse') as false_parse,
  count(*) filter (y_pred is not null and is_fallback) as fallback, count(*) filter (y_pred is null) as out_of_vocabulary,
  round((count(*) - count(*) filter (y_pred is not null and label = 'false_parse'))::double / count(*), 6) as success_rate
from cv group by view""", PARSED_VIEWS, {**PARSED, **_QUALITY})
def _(spark, sf):
    rows = CH.with_outcome(CH.resolve_prediction(V.outputs(spark, sf), None), vocab_with_failure(spark, sf))
    return rounded(M.parse_quality(rows))


_TALLY = ["plant b_high", "plant b_healthy"]


@query("ag17_outcome_tally", f"""
select case when label in ('{_TALLY[0]}', '{_TALLY[1]}') then label else 'other' end as outcome, count(*) as n from sliced group by 1
union all select 'total', count(*) from sliced""", ("positioned", "predictions"), {
    "sliced": "select c.label from positioned s join predictions p on s.sample_id = p.sample_id join classes c on p.y_pred = c.class_id"
    " where s.pos >= 1324 and s.pos < 1370"})
def _(spark, sf):
    vocab = V.classes(spark, sf)
    picked = P.rank_range(V.samples(spark, sf), ORDER, 1324, 1370).select("sample_id")
    preds = V.shape_predictions(V.labelled(spark, sf, vocab)).join(picked, "sample_id", "left_semi")
    return M.outcome_tally(decode_labels(preds, vocab, "y_pred"), _TALLY)


_LOSSES = {"losses": "select run_id, epoch, metric, avg(value) as mean_value, count(*) as steps from epoch_log group by all"}


@query("ag18_epoch_losses", "select run_id, epoch, metric, round(mean_value, 6) as mean_value, steps from losses", ("epoch_log",), _LOSSES)
def _(spark, sf):
    return rounded(R.epoch_losses(V.epoch_log(spark, sf)))


@query("ag19_best_checkpoint", """
select run_id, metric, epoch as best_epoch, round(mean_value, 6) as best_value from losses
qualify row_number() over (partition by run_id, metric order by round(mean_value, 6), epoch) = 1""", ("epoch_log",), _LOSSES)
def _(spark, sf):
    return R.best_checkpoint(R.epoch_losses(V.epoch_log(spark, sf)), decimals=6)


@query("ag20_matrix_to_metrics", macro_sql(), ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    return rounded(M.matrix_to_metrics(M.confusion_matrix(_counts(spark, sf), N), N))


@query("ag21_macro_accuracy", f"select view, balanced_accuracy as macro_accuracy from ({macro_sql()}) m", ("predictions",), {**CONFUSION, **PER_CLASS})
def _(spark, sf):
    return rounded(M.macro_accuracy(V.predictions(spark, sf)))


@query("sw10_top_confusions", """
select y_true::int as y_true, y_pred::int as y_pred, n from confusion where view = 'main' and y_true <> y_pred
order by n desc, y_true, y_pred limit 20""", ("predictions",), CONFUSION)
def _(spark, sf):
    return M.top_confusions(_counts(spark, sf), 20)


# ---------------------------------------------------------------- baselines

_MAJORITY = {"top1": "select y_true as c from predictions group by y_true order by count(*) desc, y_true limit 1",
             "majority": "select sample_id, source, y_true, c as y_pred from predictions, top1"}
_RANDOM = {"random": f"select sample_id, source, y_true, ('0x' || substr(md5(concat('42:', sample_id::varchar)), 1, 8))::bigint % {N} as y_pred from predictions"}


@query("br1_predict_majority", "select sample_id, y_pred::int as y_pred from majority", ("predictions",), _MAJORITY)
def _(spark, sf):
    return B.predict_majority(V.predictions(spark, sf)).select("sample_id", "y_pred")


@query("br2_predict_random", "select sample_id, y_pred::int as y_pred from random", ("predictions",), _RANDOM)
def _(spark, sf):
    return B.predict_random(V.predictions(spark, sf), N).select("sample_id", "y_pred")


@query("br3_evaluate_majority", f"select *, 'majority' as baseline, 1.0::double as success_rate from ({macro_sql()}) m",
       ("predictions",), {**_MAJORITY, **confusion_sql("majority"), **per_class_sql()})
def _(spark, sf):
    return rounded(B.evaluate_baseline(V.predictions(spark, sf), "majority", N))


@query("br3_evaluate_random", f"select *, 'random' as baseline, 1.0::double as success_rate from ({macro_sql()}) m",
       ("predictions",), {**_RANDOM, **confusion_sql("random"), **per_class_sql()})
def _(spark, sf):
    return rounded(B.evaluate_baseline(V.predictions(spark, sf), "random", N))


# ---------------------------------------------------------------- runs

SPACE = {
    "learning_rate": {"distribution": "log_uniform_values", "min": 5e-5, "max": 2e-4},
    "r": {"distribution": "categorical", "values": [32, 64, 128]},
    "weight_decay": {"distribution": "uniform", "min": 0.0, "max": 0.1},
}


def _u(name: str) -> str:
    return f"(('0x' || substr(md5(concat('42:{name}:', p_partkey::varchar)), 1, 13))::bigint::double / 4503599627370496.0::double)"


@query("br4_trial_table", f"""
select p_partkey as trial_id, round(exp(ln(5e-5::double) + {_u('learning_rate')} * (ln(2e-4::double) - ln(5e-5::double))), 9) as learning_rate,
  ([32, 64, 128])[floor({_u('r')} * 3)::int + 1]::int as r, round({_u('weight_decay')} * 0.1::double, 9) as weight_decay from part""")
def _(spark, sf):
    # One trial per row of the given table.
    trials = V.table(spark, sf, "part").select(F.col("p_partkey").alias("trial_id"))
    drawn = R.trial_table(trials, SPACE, 42)
    return drawn.select("trial_id", F.round("learning_rate", 9).alias("learning_rate"), "r", F.round("weight_decay", 9).alias("weight_decay"))


_RUNS = {"run_preds": "select *, sample_id % 9 as run_id from predictions"}


@query("br5_run_summary", macro_sql("run_id"), ("predictions",), {**_RUNS, **confusion_sql("run_preds", "run_id"), **per_class_sql("run_id")})
def _(spark, sf):
    return rounded(R.run_summary(V.predictions(spark, sf).withColumn("run_id", F.col("sample_id") % 9)))


# ---------------------------------------------------------------- whole flows

_NEAREST = {**PROTOTYPES, **SCORES, "nearest": _BEST.format(src="scores")}


@query("flow_feature_evaluation", macro_sql(), ("features",), {**_NEAREST, **confusion_sql("nearest"), **per_class_sql()})
def _(spark, sf):
    return rounded(feature_eval.zero_shot_metrics(V.features(spark, sf)))


_TEXT = {**PARSED, "judged": "select c.sample_id, c.source, t.class_id as y_true, c.y_pred from coded c join vocab t on c.crop_disease_label = t.label"}


@query("flow_text_evaluation", f"""
select m.*, q.success_rate, q.false_parse, q.fallback, q.out_of_vocabulary from ({macro_sql()}) m join (
  select view, round((count(*) - count(*) filter (label = 'false_parse'))::double / count(*), 6) as success_rate,
    count(*) filter (label = 'false_parse') as false_parse, count(*) filter (y_pred is not null and is_fallback) as fallback,
    count(*) filter (y_pred is null) as out_of_vocabulary from cv group by view) q on m.view = q.view""",
       PARSED_VIEWS, {**_TEXT, **_QUALITY, **confusion_sql("judged"), **per_class_sql()})
def _(spark, sf):
    return rounded(text_eval.summary(V.outputs(spark, sf), vocab_with_failure(spark, sf)))


_RUN_TEXT = {**PARSED, "judged": "select c.sample_id % 9 as run_id, c.sample_id, c.source, c.label, c.is_fallback, t.class_id as y_true, c.y_pred"
             " from coded c join vocab t on c.crop_disease_label = t.label"}


@query("flow_text_evaluation_by_run", f"""
select m.*, q.success_rate, q.false_parse, q.fallback, q.out_of_vocabulary from ({macro_sql("run_id")}) m join (
  select run_id, view, round((count(*) - count(*) filter (label = 'false_parse'))::double / count(*), 6) as success_rate,
    count(*) filter (label = 'false_parse') as false_parse, count(*) filter (y_pred is not null and is_fallback) as fallback,
    count(*) filter (y_pred is null) as out_of_vocabulary from pv group by all) q on m.view = q.view and m.run_id = q.run_id""",
       PARSED_VIEWS, {**_RUN_TEXT, **confusion_sql("judged", "run_id"), **per_class_sql("run_id")})
def _(spark, sf):
    outs = V.outputs(spark, sf).withColumn("run_id", F.col("sample_id") % 9)
    return rounded(text_eval.summary(outs, vocab_with_failure(spark, sf), keys=["run_id"]))


def text_matrix_sql(src: str = "confusion") -> str:
    """Wide matrix per view with the failure class as the last row and column."""
    cells = ", ".join(f"coalesce(sum(n) filter (y_pred = {i}), 0)::bigint as p{i}" for i in range(N + 1))
    return f"""select v.view, r.i::int as y_true, {cells} from (select unnest(['main', 'lab', 'field']) as view) v cross join range({N + 1}) r(i)
  left join {src} c on c.view = v.view and c.y_true = r.i group by all"""


# From outputs to the matrix over all classes and the failure class.
@query("flow_text_matrix", text_matrix_sql(), PARSED_VIEWS, {**_TEXT, **confusion_sql("judged")})
def _(spark, sf):
    judged = text_eval.judge(V.outputs(spark, sf), vocab_with_failure(spark, sf), strict=True)
    return text_eval.failure_matrix(text_eval.condense(judged).frame, N)


_REGIMES = ("none", "pure", "context", "mcq")
_BY_REGIME = {**PARSED, **ZERO_SHOT, **CHOICES, "resolved": """
select o.sample_id, o.source, o.crop_disease_label, case o.sample_id % 4 when 0 then 'none' when 1 then 'pure' when 2 then 'context' else 'mcq' end as regime,
  case o.sample_id % 4 when 0 then p.label when 1 then z.label
    when 2 then coalesce((select arg_min(label, list_pos) from classes c where contains(o.output, c.label)), 'false_parse')
    else case o.sample_id % 5 when 4 then 'false_parse' else opts[o.sample_id % 5 + 1] end end as label,
  o.sample_id % 4 = 0 and p.is_fallback as is_fallback
from outputs o join parsed p on o.sample_id = p.sample_id join zero_shot z on o.sample_id = z.sample_id
join choices h on o.sample_id = h.sample_id""",
              "judged": "select r.*, t.class_id as y_true, v.class_id as y_pred from resolved r join vocab t on r.crop_disease_label = t.label left join vocab v on r.label = v.label",
              "jv": "select 'main' as view, * from judged union all select source as view, * from judged"}


# All four regimes in one pass, to the metrics and parse counts of each.
@query("flow_text_by_regime", f"""
select m.*, q.success_rate, q.false_parse, q.fallback, q.out_of_vocabulary from ({macro_sql("regime")}) m join (
  select regime, view, round((count(*) - count(*) filter (y_pred is not null and label = 'false_parse'))::double / count(*), 6) as success_rate,
    count(*) filter (y_pred is not null and label = 'false_parse') as false_parse, count(*) filter (y_pred is not null and is_fallback) as fallback,
    count(*) filter (y_pred is null) as out_of_vocabulary from jv group by all) q on m.view = q.view and m.regime = q.regime""",
       ("outputs", "labelled"), {**_BY_REGIME, **confusion_sql("judged", "regime"), **per_class_sql("regime")})
def _(spark, sf):
    vocab = V.classes(spark, sf)
    rows = CH.build_choices(V.samples(spark, sf), vocab)
    regime = F.element_at(F.array(*[F.lit(x) for x in _REGIMES]), (F.col("sample_id") % 4 + 1).cast("int"))
    text = F.when(F.col("regime") == "mcq", V.choice_text()).otherwise(V.output_text())
    rows = rows.withColumn("regime", regime).withColumn("output", text)
    judged = text_eval.judge_by_regime(rows, vocab_with_failure(spark, sf), classes=vocab)
    return rounded(text_eval.summary_of(text_eval.condense(judged, ["regime"]).frame, ["regime"]))


# A head that is written, read, checked and evaluated; its scores are those of the normalised features.
_STORED_HEAD = {**PROTOTYPES, "probed": f"select sample_id, y_true, source, class_id, {dot_sql('u', 'p')} + class_id * 0.01::double as score from unit, prototypes",
                "predicted": _BEST.format(src="probed")}


def _evaluated(spark, sf, name):
    rows, path = V.features(spark, sf), scratch_path(spark, "head")
    heads.save_head(_head(rows), path, "feature-table")
    names = bounded(spark.range(V.N_FEATURE_CLASSES).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class "), F.col("id").cast("string")).alias("label")))
    return feature_eval.evaluate_stored_head(spark, path, rows, names)[name]


@query("flow_probe_evaluation", macro_sql(), ("features",), {**_STORED_HEAD, **confusion_sql("predicted"), **per_class_sql()})
def _(spark, sf):
    return rounded(_evaluated(spark, sf, "summary"))


@query("flow_probe_per_class", per_class_wide_sql(names="names"), ("features",), {
    **_STORED_HEAD, "names": f"select i as class_id, 'class ' || i::varchar as label from range({V.N_FEATURE_CLASSES}) r(i)",
    **confusion_sql("predicted"), **per_class_sql()})
def _(spark, sf):
    return rounded_table(_evaluated(spark, sf, "per_class"), "class_id", "label")
