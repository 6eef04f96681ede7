"""Vector, scoring and token-array queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curascore.catalog.base import query
from curascore.catalog.sqltext import LINEAR, PROTOTYPES, SCORES, UNIT, dot_sql
from curascore.functions import tokens as TK
from curascore.functions import vectors as VE
from curascore.operators import positions as P
from curascore.operators import probe as PB
from curascore.operators import runs as R
from curascore.operators import scoring as S
from curascore.plans import views as V
from curascore.session import scratch_path
from curascore.settings import CHANNEL_MEAN, CHANNEL_STD
from curascore.sources import heads


def _elements(df, vector):
    """One row per element, rounded."""
    return df.select("sample_id", F.posexplode(vector).alias("i", "x")).select("sample_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def _elements_sql(src: str, vector: str) -> str:
    return (
        f"select sample_id, (generate_subscripts({vector}, 1) - 1)::int as i, round(unnest({vector})::double, 6) as x from {src}"
    )


def _head(rows):
    """A linear head from the prototypes, with a bias that grows with the class id."""
    return S.class_prototypes(rows).select(
        F.col("class_id").cast("int").alias("class_id"), F.col("prototype").alias("weights"), (F.col("class_id") * 0.01).alias("bias"))


def _logits(spark, sf):
    rows = V.features(spark, sf)
    return S.with_logits(rows, _head(rows))


@query("ve1_l2_normalize", _elements_sql("unit", "u"), ("features",), UNIT)
def _(spark, sf):
    return _elements(V.features(spark, sf), VE.l2_normalize("features"))


@query("ve2_class_prototypes", """
select class_id::int as class_id, (generate_subscripts(p, 1) - 1)::int as i, round(unnest(p), 6) as x from prototypes""",
       ("features",), PROTOTYPES)
def _(spark, sf):
    protos = S.class_prototypes(V.features(spark, sf))
    return protos.select("class_id", F.posexplode("prototype").alias("i", "x")).select("class_id", "i", F.round("x", 6).alias("x"))


_BEST = """select sample_id, y_true, source, round(score, 6) as score, class_id::int as y_pred from {src}
qualify row_number() over (partition by sample_id order by round(score, 6) desc, class_id) = 1"""


@query("ve3_nearest_prototype", f"select sample_id, y_pred, score from ({_BEST.format(src='scores')}) b", ("features",), {**PROTOTYPES, **SCORES})
def _(spark, sf):
    rows = V.features(spark, sf)
    return S.nearest_prototype(rows, S.class_prototypes(rows)).select("sample_id", "y_pred", "score")


@query("ve4_linear_scores", "select sample_id, class_id::int as class_id, round(score, 6) as score from linear",
       ("features",), {**PROTOTYPES, **LINEAR})
def _(spark, sf):
    rows = V.features(spark, sf)
    return S.linear_scores(rows, _head(rows)).select("sample_id", "class_id", F.round("score", 6).alias("score"))


_SOFTMAX = {
    **PROTOTYPES, **LINEAR,
    "peak": "select sample_id, y_true, max(score) as top from linear group by all",
    "exps": "select l.sample_id, l.class_id, exp(score - top) as e from linear l join peak p on l.sample_id = p.sample_id",
    "probs": "select sample_id, class_id, e / sum(e) over (partition by sample_id) as prob from exps",
}


@query("ve5_softmax", "select sample_id, class_id::int as class_id, round(prob, 6) as prob from probs", ("features",), _SOFTMAX)
def _(spark, sf):
    rows = _logits(spark, sf).select("sample_id", F.posexplode(VE.softmax("logits")).alias("class_id", "prob"))
    return rows.select("sample_id", "class_id", F.round("prob", 6).alias("prob"))


@query("ve6_cross_entropy", """
select (pos // 64) as batch, count(*) as n, round(avg(loss), 6) as mean_loss from (
  select p.sample_id, row_number() over (order by p.sample_id) - 1 as pos,
    ln(sum(exp(l.score - p.top))) + p.top - max(case when l.class_id = p.y_true then l.score end) as loss
  from linear l join peak p on l.sample_id = p.sample_id group by p.sample_id, p.top) x group by 1""", ("features",), _SOFTMAX)
def _(spark, sf):
    # Ids are numbered on their own; vectors join the batches, and logits exist only after that.
    rows = V.features(spark, sf)
    placed = P.assign_batches(P.positions(rows.select("sample_id", "y_true", "features"), ["sample_id"], row_id="sample_id"), 64)
    rows = S.with_logits(placed, _head(rows))
    loss = VE.cross_entropy("logits", "y_true")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"))


@query("ve7_fit_linear_probe")
def _(spark, sf):
    rows = V.features(spark, sf)
    head = PB.head_of(PB.fit_linear_probe(rows), rows)
    return S.predict_linear(rows, head, unit=True).select("sample_id", "y_true", "y_pred")


# What SQL can state about a fit: all rows are predicted, with more hits than the largest class has rows.
@query("ve7_probe_beats_majority", "select y_true, count(*) as n_rows, true as beats_majority from features group by y_true", ("features",))
def _(spark, sf):
    rows = V.features(spark, sf)
    found = S.predict_linear(rows, PB.head_of(PB.fit_linear_probe(rows), rows), unit=True)
    counts = found.groupBy("y_true").agg(F.count("*").alias("n_rows"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("hits"))
    every = Window.partitionBy()  # one row per class
    return counts.select("y_true", "n_rows", (F.sum("hits").over(every) > F.max("n_rows").over(every)).alias("beats_majority"))


@query("ve8_sweep_probe")
def _(spark, sf):
    rows = V.features(spark, sf)
    table, _model = PB.sweep_probe(rows.where("split = 'train'"), rows.where("split = 'validation'"), [1e-4, 1e-3, 1e-2], max_iter=20)
    return table


@query("ve8_sweep_has_one_best", "select 3::bigint as n_settings, 1::bigint as n_best, true as best_is_lowest")
def _(spark, sf):
    rows = V.features(spark, sf)
    table, _model = PB.sweep_probe(rows.where("split = 'train'"), rows.where("split = 'validation'"), [1e-4, 1e-3, 1e-2], max_iter=20)
    return table.agg(F.count("*").alias("n_settings"), F.count_if("is_best").alias("n_best"),
                     (F.min(F.when(F.col("is_best"), F.col("val_loss"))) == F.min("val_loss")).alias("best_is_lowest"))


# One gradient step from zero weights per rate: SQL states the weights of every head, and from them each validation loss.
_RATES = [0.5, 5.0, 50.0, 500.0]
_SWEEP = {
    **UNIT,
    "tr": "select u, y_true from unit where split = 'train'",
    "size": "select count(*)::double as n from tr",
    "e": "select y_true, unnest(u) as x, generate_subscripts(u, 1) as i from tr union all select y_true, 1.0, 65 from tr",
    "g": f"select k.k as class_id, i, sum(case when y_true = k.k then x else 0 end) - sum(x) / {V.N_FEATURE_CLASSES} as g from e, range({V.N_FEATURE_CLASSES}) k(k) group by all",
    "heads": f"select r.s as setting, class_id, i, ({_RATES})[r.s + 1] / n * g as w from g, size, range({len(_RATES)}) r(s)",
    "lists": "select setting, class_id, list(w order by i) as w from heads group by all",
    "z": f"select setting, sample_id, y_true, class_id, {dot_sql('w', 'list_append(u, 1.0)')} as z from lists, unit where split = 'validation'",
    "ce": "select setting, sample_id, max(z) + ln(sum(exp(z - top))) - max(case when class_id = y_true then z end) as loss"
    " from (select *, max(z) over (partition by setting, sample_id) as top from z) z group by setting, sample_id",
    "mean_loss": "select setting, avg(loss) as loss from ce group by setting",
}


@query("ve8_sweep_rates", f"""
select setting::int as setting, ({_RATES})[setting + 1]::double as rate, round(loss, 6) as val_loss, loss = (select min(loss) from mean_loss) as is_best
from mean_loss""", ("features",), _SWEEP)
def _(spark, sf):
    rows = V.features(spark, sf)
    table, _head = PB.sweep_rates(rows.where("split = 'train'"), rows.where("split = 'validation'"), _RATES, V.N_FEATURE_CLASSES, steps=1)
    return table.withColumn("val_loss", F.round("val_loss", 6))


@query("ve9_pooled_feature", _elements_sql("""(
  select sample_id, case when sample_id % 4 = 0 then list_reverse(features) else features end as v from features) s""", "v"), ("features",))
def _(spark, sf):
    rows = V.features(spark, sf)
    pooled = F.when(F.col("sample_id") % 4 != 0, F.col("features"))
    return _elements(rows, VE.pooled_feature(pooled, F.array(F.reverse("features"), F.col("features"))))


@query("ve10_check_dimensions", """
select width, count(*) as n, width = 64 as fits, 10::int as head_classes from (select len(features)::int as width from features) f
group by width""",
       ("features",))
def _(spark, sf):
    path = scratch_path(spark, "head")
    heads.save_head(_head(V.features(spark, sf)), path, "feature-table")
    _weights, meta = heads.load_head(spark, path)
    return S.check_dimensions(V.features(spark, sf), meta["num_classes"], meta["feature_dim"])


@query("ve11_standardize_channels", f"""
select sample_id, (g - 1)::int as i, round((x::double - {CHANNEL_MEAN}::double[][((g - 1) % 3) + 1]) / {CHANNEL_STD}::double[][((g - 1) % 3) + 1], 6) as x
from (select sample_id, unnest(features) as x, generate_subscripts(features, 1) as g from features) s""".replace(
    "::double[][", "["), ("features",))
def _(spark, sf):
    return _elements(V.features(spark, sf), VE.standardize_channels("features"))


# ---------------------------------------------------------------- top-k and argmax

@query("sw5_top_k", """
select sample_id, row_number() over (partition by sample_id order by round(prob, 6) desc, class_id)::int as rank,
  class_id::int as class_id, round(prob, 6) as prob from probs qualify rank <= 5""", ("features",), _SOFTMAX)
def _(spark, sf):
    top = S.top_k(_logits(spark, sf))
    return top.select("sample_id", "rank", "class_id", F.round("prob", 6).alias("prob"))


@query("sw6_argmax", f"select sample_id, y_pred, score from ({_BEST.format(src='linear')}) b", ("features",), {**PROTOTYPES, **LINEAR})
def _(spark, sf):
    rows = V.features(spark, sf)
    return S.argmax(S.score_arrays(rows, _head(rows)))


@query("sw6_predict_linear", f"select sample_id, y_pred, score from ({_BEST.format(src='linear')}) b", ("features",), {**PROTOTYPES, **LINEAR})
def _(spark, sf):
    rows = V.features(spark, sf)
    return S.predict_linear(rows, _head(rows)).select("sample_id", "y_pred", "score")


# ---------------------------------------------------------------- token arrays

def _ids(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias("ids")


def _ids_sql(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: x::varchar), ' ') as ids"


_ANCHORED = {"anchored": "select *, list_filter(range(1, len(ids)), lambda i: ids[i:i+1] = [5, 2])[1] as start_at from tokens"}


@query("ve12_mask_before_anchor", f"""
select conv_id, turn, {_ids_sql('list_transform(ids, lambda x, i: case when i < start_at then -100 else x end)')} from anchored where start_at is not null""",
       ("tokens",), _ANCHORED)
def _(spark, sf):
    rows = V.tokens(spark, sf).withColumn("masked", TK.mask_before_anchor("ids", V.ANCHOR))
    return rows.where(F.col("masked").isNotNull()).select("conv_id", "turn", _ids(F.col("masked")))


@query("ve12_missing_anchor", f"select conv_id, turn, {_ids_sql('ids')} from anchored where start_at is null", ("tokens",), _ANCHORED)
def _(spark, sf):
    rows = V.tokens(spark, sf).withColumn("at", TK.anchor_position("ids", V.ANCHOR))
    return rows.where(F.col("at").isNull()).select("conv_id", "turn", _ids(F.col("ids")))


@query("ve13_mask_tokens", f"""
select conv_id, turn, {_ids_sql('list_transform(ids, lambda x: case when x in (1, 12) then -100 else x end)')} from tokens""", ("tokens",))
def _(spark, sf):
    return V.tokens(spark, sf).select("conv_id", "turn", _ids(TK.mask_tokens("ids", V.SPECIALS)))


@query("ve14_truncate_sequence", f"select conv_id, turn, {_ids_sql('ids[1:16]')} from tokens", ("tokens",))
def _(spark, sf):
    return V.tokens(spark, sf).select("conv_id", "turn", _ids(TK.truncate_sequence("ids", 16)))


@query("ve15_pad_sequence", f"""
select conv_id, turn, batch, len(padded)::int as length, {_ids_sql('padded')} from (
  select conv_id, turn, batch, list_concat(list_transform(range(0, most - len(ids)), lambda i: 0), ids) as padded from (
    select *, max(len(ids)) over (partition by batch) as most from (
      select *, (row_number() over (order by conv_id, turn) - 1) // 8 as batch from tokens) a) b) c""", ("tokens",))
def _(spark, sf):
    rows = P.assign_batches(P.positions(V.tokens(spark, sf), ["conv_id", "turn"]), 8)
    padded = R.with_batch_length(rows, "batch", F.size("ids")).withColumn("padded", TK.pad_to("ids", F.col("batch_length")))
    return padded.select("conv_id", "turn", "batch", F.size("padded").alias("length"), _ids(F.col("padded")))


@query("ve16_strip_prompt", f"select conv_id, turn, {_ids_sql('ids[4:]')} from tokens", ("tokens",))
def _(spark, sf):
    return V.tokens(spark, sf).select("conv_id", "turn", _ids(TK.strip_prompt("ids", 3)))
