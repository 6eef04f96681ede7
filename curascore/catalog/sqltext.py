"""SQL pieces that several registered queries share."""

from __future__ import annotations

from curascore.plans.views import N_CLASSES
from curascore.settings import CURATION_SEED, EVALUATION_SEED

# RE2 forms of the output patterns: linear-time, so without possessive marks.
_W = r"[\p{L}\p{N}_]"
_S = r"[\t-\r\x1c-\x1f\x{85}\p{Z} ]"
_PHRASE = rf"({_W}+(?: {_W}+)*)"
_P = [
    rf"(?i)(?:Class|Answer|Crop):{_S}*{_PHRASE}{_S}*[\r\n]+Disease:{_S}*({_W}+)",
    rf"(?i)Answer:{_S}*[\r\n]+{_PHRASE}{_S}*[\r\n]+({_W}+)",
    rf"(?i)Disease:{_S}*({_W}+){_S}*[\r\n]+(?:Crop|Class|Answer):{_S}*{_PHRASE}",
]
_CROP = r"(?i)crop[^\p{L}\p{N}_]*([a-z]+(?: [a-z]+)*)"
_DISEASE = r"(?i)disease[^\p{L}\p{N}_]*([a-z]+(?:_[a-z]+)*)"
_ZERO = (
    rf"(?is)^{_S}*(?:Class|Crop):{_S}*\*?([\p{{L}}\p{{N}}_\t-\r\x1c-\x1f\x{{85}}\p{{Z}} -]+?)\*?{_S}*[\r\n]+"
    rf"Disease:{_S}*\*?(.*?)(?:{_S}*\(.*\))?\*?{_S}*\z"
)
_LINES = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

_VOCAB = f"select label, class_id from classes union all select 'false_parse', {N_CLASSES}"
VOCAB = {"vocab": _VOCAB}


def _joined(a: str, b: str) -> str:
    return f"case when contains({a}, '_') then concat(lower({b}), '_', {a}) else concat(lower({a}), '_', {b}) end"


PARSED_VIEWS = ("outputs", "classes")
PARSED = {
    **VOCAB,
    "kv": "select *, "
    + ", ".join(f"regexp_extract(output, '{p}', {g}) as g{i}{g}" for i, p in enumerate(_P) for g in (1, 2))
    + f", regexp_extract(coalesce(list_filter(string_split_regex(output, '{_LINES}'), lambda l: contains(lower(l), 'crop')"
    f" and regexp_matches(l, '{_CROP}'))[-1], ''), '{_CROP}', 1) as kv_crop"
    f", regexp_extract(coalesce(list_filter(string_split_regex(output, '{_LINES}'), lambda l: contains(lower(l), 'disease')"
    f" and regexp_matches(l, '{_DISEASE}'))[-1], ''), '{_DISEASE}', 1) as kv_disease from outputs",
    "parsed": "select sample_id, source, crop_disease_label, output, case "
    + " ".join(f"when g{i}1 <> '' then {_joined(f'g{i}1', f'g{i}2')}" for i in range(3))
    + " when kv_crop <> '' and kv_disease <> '' then concat(lower(kv_crop), '_', kv_disease) else 'false_parse' end as label"
    ", g01 = '' and g11 = '' and g21 = '' as is_fallback, kv_crop, kv_disease from kv",
    "coded": "select p.*, v.class_id as y_pred from parsed p left join vocab v on p.label = v.label",
}


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '\\A{_S}+|{_S}+\\z', '', 'g')"


ZERO_SHOT = {
    "zs": f"select sample_id, regexp_extract(output, '{_ZERO}', 1) as raw,"
    f" {strip_sql(f'''regexp_extract(output, '{_ZERO}', 1)''')} as c,"
    f" {strip_sql(f'''regexp_extract(output, '{_ZERO}', 2)''')} as d from outputs",
    "zero_shot": "select sample_id, case when raw <> '' then concat(replace(lower(c), ' ', '_'), '_', replace(lower("
    "case when contains(d, c) then replace(d, concat(c, ' '), '') else d end), ' ', '_')) else 'false_parse' end as label from zs",
}

_word = "('0x' || substr(h, {}, 8))::bigint"
CHOICES = {
    "c0": f"select sample_id, crop_disease_label, numeric_label as p, md5(concat('{EVALUATION_SEED}:', sample_id::varchar)) as h from labelled",
    "c1": f"select sample_id, crop_disease_label, p, {_word.format(1)} % {N_CLASSES - 1} as a,"
    f" {_word.format(9)} % {N_CLASSES - 2} as b0, {_word.format(17)} % {N_CLASSES - 3} as x0, {_word.format(25)} % 4 as k from c0",
    "c2": "select *, case when b0 >= a then b0 + 1 else b0 end as b from c1",
    "c3": "select *, case when x0 >= least(a, b) then x0 + 1 else x0 end as x1 from c2",
    "c4": "select *, case when x1 >= greatest(a, b) then x1 + 1 else x1 end as x from c3",
    "c5": "select sample_id, crop_disease_label, p, k, list_transform([a, b, x], lambda i: case when i >= p then i + 1 else i end) as drawn from c4",
    "choices": "select sample_id, crop_disease_label, list_transform(list_concat(list_concat(drawn[1:k], [p]), drawn[k+1:3]),"
    " lambda i: names[i + 1]) as opts from c5, (select list(label order by class_id) as names from classes) n",
}

# ---------------------------------------------------------------- metrics

_PRED_VIEWS = "select 'main' as view, * from {src} union all select source as view, * from {src}"


def confusion_sql(src: str = "predictions", keys: str = "") -> dict[str, str]:
    k = f"{keys}, " if keys else ""
    return {
        "pv": _PRED_VIEWS.format(src=src),
        "confusion": f"select {k}view, y_true, y_pred, count(*) as n from pv where y_true is not null and y_pred is not null group by all",
    }


def per_class_sql(keys: str = "") -> dict[str, str]:
    k = f"{keys}, " if keys else ""
    return {
        "cells": f"select {k}view, y_true as class_id, case when y_true = y_pred then n else 0 end as tp, 0 as fp,"
        f" case when y_true = y_pred then 0 else n end as fn from confusion"
        f" union all select {k}view, y_pred, 0, n, 0 from confusion where y_true <> y_pred",
        "class_counts": f"select {k}view, class_id, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from cells group by all",
        "per_class": "select *, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as precision,"
        " case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as recall,"
        " case when 2 * tp + fp + fn = 0 then 0 else 2 * tp::double / (2 * tp + fp + fn) end as f1 from class_counts",
    }


CONFUSION = confusion_sql()
PER_CLASS = per_class_sql()


def macro_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"select {k}view, round(avg(recall), 6) as balanced_accuracy, round(avg(precision), 6) as precision,"
        f" round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, count(*) as n_classes from per_class"
        f" where tp + fp + fn > 0 group by {k}view"
    )


# ---------------------------------------------------------------- vectors

def _unit(v: str) -> str:
    return (
        f"list_transform({v}, lambda x: x::double / greatest(sqrt(list_sum(list_transform({v}, lambda y: y::double * y::double))), 1e-12))"
    )


UNIT = {"unit": f"select sample_id, y_true, source, split, {_unit('features')} as u from features"}
PROTOTYPES = {
    **UNIT,
    "elements": "select y_true as class_id, unnest(u) as x, generate_subscripts(u, 1) as i from unit",
    "means": "select class_id, i, avg(x) as m from elements group by class_id, i",
    "mean_lists": "select class_id, list(m order by i) as v from means group by class_id",
    "prototypes": f"select class_id, {_unit('v')} as p from mean_lists",
}


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


SCORES = {"scores": f"select sample_id, y_true, source, class_id, {dot_sql('u', 'p')} as score from unit, prototypes"}
# A linear head made of the prototypes and a bias per class.
LINEAR = {
    "linear": f"select sample_id, y_true, source, class_id, {dot_sql('features::double[]', 'p')} + class_id * 0.01::double as score"
    " from features, prototypes",
    "logits": "select sample_id, y_true, list(score order by class_id) as v from linear group by all",
}
SEED = CURATION_SEED
