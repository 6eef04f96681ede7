"""Sources, sinks and streams. Each query writes what it needs to the scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from curascore.catalog.base import query
from curascore.catalog.curation import BALANCE, RANKED, SAMPLE_COLUMNS
from curascore.catalog.labels import per_class_wide_sql, rounded_table, vocab_with_failure
from curascore.catalog.metrics import _QUALITY, _TEXT, WIDE, rounded, text_matrix_sql
from curascore.catalog.sqltext import CONFUSION, PARSED, PARSED_VIEWS, PROTOTYPES, confusion_sql, per_class_sql
from curascore.catalog.text import quoted
from curascore.catalog.vectors import _head
from curascore.functions.text import escape_output
from curascore.operators import labels as L
from curascore.operators import metrics as M
from curascore.operators.lookup import bounded
from curascore.plans import curate, text_eval
from curascore.plans import views as V
from curascore.session import scratch_path
from curascore.settings import EVALUATION_SEED, QUESTION, TRAIN_SYSTEM, VIEWS
from curascore.sources import heads, readers, writers
from curascore.streaming import evaluation as ST

_ALL = f"{SAMPLE_COLUMNS}, numeric_label::int as numeric_label"


def _published(spark, sf) -> str:
    path = scratch_path(spark, "samples")
    writers.publish(V.labelled(spark, sf), path)
    return path


@query("io1_load_samples", f"select {_ALL} from labelled", ("labelled",))
def _(spark, sf):
    return readers.load_samples(spark, _published(spark, sf))


@query("io1_load_one_split", f"select {_ALL} from labelled where split = 'test'", ("labelled",))
def _(spark, sf):
    return readers.load_samples(spark, _published(spark, sf), "test")


@query("io2_load_variant", f"""
select 'full_lora' as job_type, {_ALL} from labelled union all select 'lab_lora', {_ALL} from labelled where source = 'lab'
union all select 'field_lora', {_ALL} from labelled where source = 'field'""", ("labelled",))
def _(spark, sf):
    rows = V.labelled(spark, sf)
    parts = [L.load_variant(rows, job).withColumn("job_type", F.lit(job)) for job in ("full_lora", "lab_lora", "field_lora")]
    return L.concat(*parts)


_CSV = ["True Label", "True Label (Text)", "Parsed Output"]


def _outputs_csv(spark, sf, output) -> str:
    path = scratch_path(spark, "outputs")
    vocab = V.classes(spark, sf)
    rows = L.encode_labels(V.outputs(spark, sf), vocab).select(
        output.alias(_CSV[2]), F.col("class_id").alias(_CSV[0]), F.col("crop_disease_label").alias(_CSV[1]))
    writers.write_csv(rows, path, _CSV)
    return path


_CSV_SQL = """select c.class_id::int as "True Label", o.crop_disease_label as "True Label (Text)", {} as "Parsed Output"
from outputs o join classes c on o.crop_disease_label = c.label"""


@query("io3_read_outputs_csv", _CSV_SQL.format("'''' || replace(o.output, chr(10), '\\n') || ''''"), ("outputs", "classes"))
def _(spark, sf):
    return readers.read_outputs_csv(spark, _outputs_csv(spark, sf, escape_output("output")))


# Raw outputs, so that fields with quotes and line breaks are exercised.
@query("io3_read_raw_outputs_csv", _CSV_SQL.format("o.output"), ("outputs", "classes"))
def _(spark, sf):
    return readers.read_outputs_csv(spark, _outputs_csv(spark, sf, F.col("output")), multi_line=True)


@query("io4_read_matrix_csv", "select * from wide", ("predictions",), {**CONFUSION, **WIDE})
def _(spark, sf):
    # One file per view, as the matrices are published.
    matrix = M.confusion_matrix(M.confusion_long(V.predictions(spark, sf)), V.N_CLASSES)
    parts = []
    for view in VIEWS:
        path = scratch_path(spark, f"matrix-{view}")
        writers.write_matrix_csv(matrix.where(F.col("view") == view), path, V.N_CLASSES)
        read = readers.read_matrix_csv(spark, path, V.N_CLASSES)
        parts.append(read.select(F.lit(view).alias("view"), F.col("y_true").cast("int").alias("y_true"), *[f"p{i}" for i in range(V.N_CLASSES)]))
    return L.concat(*parts)


@query("io5_write_csv", """
select c.class_id::int as class_id, o.sample_id, o.crop_disease_label from outputs o join classes c on o.crop_disease_label = c.label""",
       ("outputs", "classes"))
def _(spark, sf):
    # Written in another column order than the frame has, then read back.
    path = scratch_path(spark, "csv")
    rows = L.encode_labels(V.outputs(spark, sf), V.classes(spark, sf))
    writers.write_csv(rows, path, ["class_id", "sample_id", "crop_disease_label"])
    return spark.read.schema("class_id int, sample_id long, crop_disease_label string").option("header", True).csv(path)


@query("io6_publish", f"""
select {', '.join('r.' + c.strip() for c in SAMPLE_COLUMNS.split(','))}, k.class_id::int as numeric_label, c.balance_case
from ranked r join cases c on r.split = c.split and r.crop = c.crop and r.disease = c.disease
join classes k on k.label = r.crop_disease_label
where rn <= case source when 'lab' then quota_lab else quota_field end""", ("classes",), {**BALANCE, **RANKED})
def _(spark, sf):
    # The whole curation flow: balance, sample, label, publish by split; read back.
    path = scratch_path(spark, "curated")
    curate.build_dataset(V.samples(spark, sf), path, V.VIEW_TARGETS)
    return readers.load_samples(spark, path, schema=readers.CURATED_SCHEMA)


# A folder per run name of the part table, with a file that holds how many rows have the name.
@query("io7_list_checkpoints", """
select path as run, (length(count(*)::varchar) + 1)::bigint as length from run_files where contains(path, '_model_exp_') group by path""", ("run_files",))
def _(spark, sf):
    folder = scratch_path(spark, "checkpoints")
    names = V.run_files(spark, sf).where(F.contains("path", F.lit("_model_exp_"))).groupBy(F.col("path").alias("run")).agg(F.count("*").cast("string").alias("rows"))
    names.repartition("run").write.partitionBy("run").text(folder)
    files = readers.list_checkpoints(spark, folder, "*.txt")
    return files.select(F.regexp_extract("path", "/run=([^/]*)/", 1).alias("run"), "length")


def _report(spark, sf, name):
    """A table of the report as it was written and read back."""
    tables = text_eval.report_tables(V.outputs(spark, sf), vocab_with_failure(spark, sf))
    return spark.read.parquet(writers.write_report({name: tables[name]}, scratch_path(spark, "report"))[name])


@query("io8_write_report", f"""
select 'summary' as table_name, count(distinct view) as n_rows from cv
union all select 'per_class', count(*) from vocab
union all select 'matrix', 3 * count(*) from vocab
union all select 'failed_outputs', count(*) from coded where label = 'false_parse'
union all select 'parse_samples', least(100, count(*)) from coded
union all select 'unknown_labels', count(distinct crop_disease_label) from coded where crop_disease_label not in (select label from vocab)""",
       PARSED_VIEWS, {**PARSED, **_QUALITY})
def _(spark, sf):
    tables = text_eval.report_tables(V.outputs(spark, sf), vocab_with_failure(spark, sf))
    written = writers.write_report(tables, scratch_path(spark, "report"))
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, p in written.items()]
    return L.concat(*counts)


@query("io8_report_per_class", per_class_wide_sql(names="vocab"), PARSED_VIEWS, {**_TEXT, **confusion_sql("judged"), **per_class_sql()})
def _(spark, sf):
    return rounded_table(_report(spark, sf, "per_class"), "class_id", "label")


@query("io8_report_matrix", text_matrix_sql(), PARSED_VIEWS, {**_TEXT, **confusion_sql("judged")})
def _(spark, sf):
    return _report(spark, sf, "matrix")


@query("io8_report_parse_samples", f"""
select row_number() over (order by md5(concat('{EVALUATION_SEED}:', sample_id::varchar)), sample_id) - 1 as pos, y_true::int as y_true,
  '''' || replace(output, chr(10), '\\n') || '''' as parsed_output
from (select p.sample_id, t.class_id as y_true, p.output from parsed p join vocab t on p.crop_disease_label = t.label) x
qualify pos < 100""", PARSED_VIEWS, PARSED)
def _(spark, sf):
    return _report(spark, sf, "parse_samples")


# True labels of which some are unknown: the vocabulary leaves out every seventh class.
@query("io8_report_unknown_labels", """
select label, count(*) as n from (select crop_disease_label as label from outputs) o
where label in (select label from classes where class_id % 7 = 3) group by label""", PARSED_VIEWS)
def _(spark, sf):
    vocab = bounded(V.classes(spark, sf).frame.where("class_id % 7 <> 3").select("label", "class_id"))
    return text_eval.unknown_labels(text_eval.judge(V.outputs(spark, sf), vocab))


@query("io8_failed_outputs", """
select sample_id, '''' || replace(output, chr(10), '\\n') || '''' as failed_output from parsed where label = 'false_parse'""",
       PARSED_VIEWS, PARSED)
def _(spark, sf):
    return text_eval.failed_outputs(text_eval.judge(V.outputs(spark, sf), vocab_with_failure(spark, sf)))


@query("io9_head_round_trip", """
select class_id::int as class_id, (generate_subscripts(p, 1) - 1)::int as i, round(unnest(p), 6) as weight,
  round(class_id * 0.01::double, 6) as bias, 10::int as num_classes, 64::int as feature_dim, 'linear' as head_type from prototypes""",
       ("features",), PROTOTYPES)
def _(spark, sf):
    path = scratch_path(spark, "head")
    heads.save_head(_head(V.features(spark, sf)), path, "feature-table")
    weights, meta = heads.load_head(spark, path, V.N_FEATURE_CLASSES)
    rows = weights.select("class_id", "bias", F.posexplode("weights").alias("i", "weight"))
    return rounded(rows, "weight", "bias").select(
        "*", *[F.lit(meta[k]).alias(k) for k in ("num_classes", "feature_dim", "head_type")])


def _message_sql(role: str, *parts: str) -> str:
    return '{"role":"' + role + '","content":[' + ",".join(parts) + "]}"


_SFT = (
    '{"messages":['
    + ",".join([
        _message_sql("system", '{"type":"text","text":"' + TRAIN_SYSTEM + '"}'),
        _message_sql("user", '{"type":"text","text":"' + QUESTION + '"}', '{"type":"image"}'),
        _message_sql("assistant", '{"type":"text","text":"@answer@"}'),
    ])
    + "]}"
)


@query("io10_export_sft_jsonl", f"""
select replace({quoted(_SFT)}, '@answer@', concat('Class: ', crop, '\\nDisease: ', disease)) as value from samples""", ("samples",))
def _(spark, sf):
    path = scratch_path(spark, "sft")
    writers.export_sft_jsonl(V.samples(spark, sf), path)
    return spark.read.text(path)


# ---------------------------------------------------------------- streams

def _stream_orders(spark, sf):
    return ST.stream_table(spark, f"{sf}/orders.parquet", V.table(spark, sf, "orders").schema)


@query("s1_streaming_confusion", "select view, y_true::int as y_true, y_pred::int as y_pred, n from confusion", ("predictions",), CONFUSION)
def _(spark, sf):
    stream = V.shape_samples(_stream_orders(spark, sf), V.table(spark, sf, "customer"), V.table(spark, sf, "nation"))
    coded = L.encode_labels(stream, V.classes(spark, sf), how="inner").withColumnRenamed("class_id", "numeric_label")
    return ST.run_confusion(V.shape_predictions(coded), scratch_path(spark, "stream"))


@query("s2_streaming_parse", "select sample_id, output, label, is_fallback from parsed", PARSED_VIEWS, PARSED)
def _(spark, sf):
    stream = V.shape_samples(_stream_orders(spark, sf), V.table(spark, sf, "customer"), V.table(spark, sf, "nation"))
    parsed = ST.streaming_parse(V.shape_outputs(stream).select("sample_id", "output"))
    return ST.run_parse(parsed, scratch_path(spark, "stream"))
