"""Class counts, the balance rule, sampling and ordering."""

from __future__ import annotations

from curascore.catalog.base import query
from curascore.operators import curation as C
from curascore.operators import positions as P
from curascore.plans import views as V
from curascore.settings import OVER_MARGIN, UNDER_MARGIN

SAMPLE_COLUMNS = "sample_id, crop, disease, source, split, crop_disease_label"
T = V.VIEW_TARGETS
U, O = UNDER_MARGIN, OVER_MARGIN

BALANCE = {
    "bal": "select split, crop, disease, count(*) as n_total, count(*) filter (source = 'lab') as n_lab,"
    " count(*) filter (source = 'field') as n_field from samples group by all",
    "tgt": "select *, case split " + " ".join(f"when '{s}' then {t}" for s, t in T.items()) + " end as t,"
    " case split " + " ".join(f"when '{s}' then {t // 2}" for s, t in T.items()) + " end as h from bal",
    "cases0": f"""select *, case
    when (n_lab = 0 or n_field = 0) and n_total <= t - {U} then '1A'
    when (n_lab = 0 or n_field = 0) and n_total < t + {O} then '1B'
    when n_lab = 0 or n_field = 0 then '1C'
    when n_lab < h and n_total < t then '2LA'
    when n_lab < h then '2LB'
    when n_field < h and n_total < t then '2FA'
    when n_field < h then '2FB'
    else '4' end as balance_case from tgt""",
    "cases": """select split, crop, disease, n_total, n_lab, n_field, balance_case,
    (case when balance_case = '1C' and n_lab > 0 then t when balance_case = '2FB' then t - n_field
      when balance_case = '4' then h else n_lab end)::bigint as quota_lab,
    (case when balance_case = '1C' and n_field > 0 then t when balance_case = '2LB' then t - n_lab
      when balance_case = '4' then h else n_field end)::bigint as quota_field from cases0""",
}
RANKED = {
    "ranked": "select *, row_number() over (partition by split, crop, disease, source"
    " order by md5(concat('42:', sample_id::varchar)), sample_id) as rn from samples"
}


def cases(spark, sf):
    return C.balance_case(C.source_balance(V.samples(spark, sf)), T)


@query("ag1_class_counts", """
select numeric_label::int as numeric_label, arg_max(crop_disease_label, sample_id) as label, count(*) as n from labelled group by 1""",
       ("labelled",))
def _(spark, sf):
    return C.class_counts(V.labelled(spark, sf), "sample_id")


@query("ag2_class_counts_total", """
select numeric_label::int as numeric_label, count(*) as n, grouping(numeric_label)::int as is_total
from labelled group by rollup (numeric_label)""", ("labelled",))
def _(spark, sf):
    return C.class_counts_total(V.labelled(spark, sf))


@query("ag3_class_by_source", f"""
select r.i::int as numeric_label, count(*) filter (source = 'lab') as lab, count(*) filter (source = 'field') as field
from range({V.N_CLASSES}) r(i) left join labelled l on l.numeric_label = r.i group by r.i""", ("labelled",))
def _(spark, sf):
    return C.class_by_source(V.labelled(spark, sf), V.N_CLASSES)


@query("ag4_majority_class", """
select crop_disease_label as label, count(*) as n from samples group by 1 order by n desc, label limit 1""", ("samples",))
def _(spark, sf):
    return C.majority_class(V.samples(spark, sf))


@query("ag5_source_balance", "select * from bal", ("samples",), BALANCE)
def _(spark, sf):
    return C.source_balance(V.samples(spark, sf))


@query("ag6_balance_case", "select * from cases", ("samples",), BALANCE)
def _(spark, sf):
    return cases(spark, sf)


@query("ag7_flagged_groups", """
select split, crop, disease, case when n_field = 0 then 'lab' else 'field' end as source, n_total, 'CASE 1' as reason
from cases where balance_case = '1A'""", ("samples",), BALANCE)
def _(spark, sf):
    return C.flagged_groups(cases(spark, sf))


@query("ag8_split_sizes", "select split, count(*) as n from samples group by split", ("samples",))
def _(spark, sf):
    return C.split_sizes(V.samples(spark, sf))


@query("ag8_kept_totals", """
select split, crop, disease, balance_case, quota_lab + quota_field as n_kept,
  sum(quota_lab + quota_field) over (partition by split order by crop, disease)::bigint as running_total from cases""",
       ("samples",), BALANCE)
def _(spark, sf):
    return C.kept_totals(cases(spark, sf))


@query("sw1_seeded_shuffle", """
select sample_id, row_number() over (order by md5(concat('42:', sample_id::varchar)), sample_id) - 1 as pos from samples""",
       ("samples",))
def _(spark, sf):
    return C.seeded_shuffle(V.samples(spark, sf).select("sample_id"), 42)


@query("sw2_sample_n", f"select {SAMPLE_COLUMNS} from ranked where rn <= 20", ("samples",), RANKED)
def _(spark, sf):
    return C.sample_n(V.samples(spark, sf), 20, ["split", "crop", "disease", "source"])


@query("sw3_balanced_downsample", f"""
select {', '.join('r.' + c.strip() for c in SAMPLE_COLUMNS.split(','))}, c.balance_case
from ranked r join cases c on r.split = c.split and r.crop = c.crop and r.disease = c.disease
where rn <= case source when 'lab' then quota_lab else quota_field end""", ("samples",), {**BALANCE, **RANKED})
def _(spark, sf):
    return C.balanced_downsample(V.samples(spark, sf), T)


@query("sw7_first_n", """
select sample_id, crop_disease_label,
  row_number() over (order by md5(concat('3407:', sample_id::varchar)), sample_id) - 1 as pos from samples qualify pos < 100""",
       ("samples",))
def _(spark, sf):
    return C.first_n(V.samples(spark, sf).select("sample_id", "crop_disease_label"), 100, 3407)


@query("sw8_assign_batches", """
select sample_id, pos, pos // 32 as batch from (
  select sample_id, row_number() over (order by md5(concat('3407:', sample_id::varchar)), sample_id) - 1 as pos from samples) s""",
       ("samples",))
def _(spark, sf):
    return P.assign_batches(C.seeded_shuffle(V.samples(spark, sf).select("sample_id"), 3407), 32)


@query("sw9_sort_classes", "select class_id::int as class_id, label, crop, disease from classes", ("classes",))
def _(spark, sf):
    from curascore.operators.metrics import sort_classes
    return sort_classes(V.classes(spark, sf).frame.select("class_id", "label", "crop", "disease"))
