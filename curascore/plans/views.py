"""Views over the test tables in the shapes that the operators work on, as Spark frames and as SQL.

Each view covers its whole tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curascore.functions.text import compose_label
from curascore.operators.labels import class_table, encode_labels
from curascore.operators.lookup import Dimension, bounded
from curascore.session import spread

N_CROPS, N_DISEASES = 25, 5
N_CLASSES = N_CROPS * N_DISEASES
N_FEATURE_CLASSES = 10
VIEW_TARGETS = {"train": 100, "test": 12, "validation": 12}
ANCHOR = [5, 2]
SPECIALS = [1, 12]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fact(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The listed columns of a table whose rows are worked on one by one."""
    return spread(table(spark, sf_dir, name).select(*columns))


def shape_samples(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Samples from orders; also used with a stream of orders.

    Neither join is hinted: both tables may be large, so the planner and adaptive execution (with its split of
    skewed partitions) choose by their real size.
    """
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")
    nk, ok = F.col("n_nationkey"), F.col("o_orderkey")
    joined = orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(who, F.col("o_custkey") == F.col("c_custkey"))
    if not orders.isStreaming:
        joined = spread(joined, orders)
    return (
        joined.select(
            ok.alias("sample_id"),
            F.concat(F.when(nk % 2 == 0, "Plant").otherwise("Plant "), F.char(nk + 65)).alias("crop"),
            F.replace(
                F.lower(F.replace(F.substring("o_orderpriority", 3, 100), F.lit(" "), F.lit("_"))), F.lit("low"), F.lit("healthy")
            ).alias("disease"),
            F.when(ok % 10 < nk % 11, "lab").otherwise("field").alias("source"),
            F.when(ok % 20 == 7, "test").when(ok % 20 == 13, "validation").otherwise("train").alias("split"),
        )
        .withColumn("crop_disease_label", compose_label())
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_samples(*(table(spark, sf_dir, t) for t in ("orders", "customer", "nation")))


def classes(spark: SparkSession, sf_dir: str) -> Dimension:
    """(label, crop, disease, class_id, list_pos); the list order is deliberately unsorted."""
    return bounded(class_table(samples(spark, sf_dir), F.md5("label")))


def labelled(spark: SparkSession, sf_dir: str, vocab: Dimension | None = None) -> DataFrame:
    """Samples with ``numeric_label``."""
    vocab = vocab or classes(spark, sf_dir)
    return encode_labels(samples(spark, sf_dir), vocab, how="inner").withColumnRenamed("class_id", "numeric_label")


def shape_predictions(coded: DataFrame) -> DataFrame:
    sid, y = F.col("sample_id"), F.col("numeric_label")
    wrong = ((y + sid % 3) % N_CLASSES).cast("int")
    return coded.select(
        "sample_id", "source", "split", y.alias("y_true"), F.when((sid % 7).isin(0, 1), wrong).otherwise(y).alias("y_pred")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_predictions(labelled(spark, sf_dir))


def output_text() -> Column:
    """Model output of a sample, one branch of the parsers per residue of the id."""
    crop, disease, nl = F.col("crop"), F.col("disease"), F.lit("\n")
    cases = [
        F.concat(F.lit("Disease: "), disease, nl, F.lit("Crop: "), F.upper(crop)),
        F.concat(F.lit("Answer:"), nl, crop, nl, disease),
        F.concat(F.lit('the crop = "'), crop, F.lit('"'), nl, F.lit("disease = "), disease),
        F.lit("no idea"),
        F.concat(F.lit("Class: "), crop, nl, F.lit("Disease: unseen_"), disease),
        F.concat(nl, F.lit(" Class: "), crop, nl, F.lit("Disease: *"), disease, F.lit(" (likely)*")),
        F.concat(F.lit("Class: "), F.replace(crop, F.lit(" "), F.lit("_")), nl, F.lit("Disease: "), disease),
        F.concat(F.lit("I think it is "), F.col("crop_disease_label"), F.lit(".")),
    ]
    out = F.concat(F.lit("Class: "), F.upper(crop), nl, F.lit("Disease: "), disease)
    for residue, text in enumerate(cases):
        out = F.when(F.col("sample_id") % 11 == residue, text).otherwise(out)
    return out


def shape_outputs(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "source", "crop_disease_label", output_text().alias("output"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_outputs(samples(spark, sf_dir))


def choice_text() -> Column:
    """Letters with whitespace in lower case; E is not a valid key."""
    return F.concat(F.lit(" "), F.lower(F.char(F.lit(65) + F.col("sample_id") % 5)), F.lit("\n"))


def choice_outputs(df: DataFrame) -> DataFrame:
    return df.withColumn("output", choice_text())


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features"), F.col("label").alias("y_true"),
        F.when(F.col("vec_id") % 3 == 0, "lab").otherwise("field").alias("source"),
        F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train").alias("split"),
    )


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint names in both forms, ids outside the grid, and names to skip."""
    key = F.col("p_partkey")
    full = F.concat(F.lower("p_type"), F.lit("_model_exp_0.000"), (key % 5 + 1).cast("string"), F.lit("_"),
                    ((F.col("p_size") % 4 + 1) * 16).cast("string"), F.lit(".pth"))
    short = F.concat(F.lower("p_type"), F.lit("_model_exp_"), (key % 11).cast("string"), F.lit(".pth"))
    odd = F.concat(F.lit("notes_"), key.cast("string"), F.lit(".pth"))
    other = F.concat(F.lit("notes_"), key.cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "part").select(
        key.alias("run_pos"),
        F.when(key % 4 == 0, full).when(key % 4 == 1, short).when(key % 4 == 2, odd).otherwise(other).alias("path"),
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 9).cast("int").alias("run_id"), (F.dayofmonth("ts") % 10).cast("int").alias("epoch"),
        F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value",
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for token ids."""
    return fact(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids")
    )


# ---------------------------------------------------------------- the same views as SQL

SQL = {
    "samples": """
select sample_id, crop, disease, source, split, concat(lower(crop),'_',disease) as crop_disease_label
from (select o_orderkey as sample_id,
    concat(case when n_nationkey % 2 = 0 then 'Plant' else 'Plant ' end, chr(65 + n_nationkey)) as crop,
    replace(lower(replace(substr(o_orderpriority,3),' ','_')),'low','healthy') as disease,
    case when o_orderkey % 10 < n_nationkey % 11 then 'lab' else 'field' end as source,
    case when o_orderkey % 20 = 7 then 'test' when o_orderkey % 20 = 13 then 'validation' else 'train' end as split
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) s""",
    "classes": """
select label, crop, disease, dense_rank() over (order by label) - 1 as class_id,
  row_number() over (order by md5(label), label) - 1 as list_pos
from (select distinct crop_disease_label as label, crop, disease from samples) c""",
    "labelled": """
select s.*, c.class_id as numeric_label from samples s join classes c on s.crop_disease_label = c.label""",
    "predictions": f"""
select sample_id, source, split, numeric_label as y_true,
  case when sample_id % 7 in (0,1) then (numeric_label + sample_id % 3) % {N_CLASSES} else numeric_label end as y_pred
from labelled""",
    "outputs": """
select sample_id, source, crop_disease_label, case sample_id % 11
  when 0 then concat('Disease: ',disease,chr(10),'Crop: ',upper(crop))
  when 1 then concat('Answer:',chr(10),crop,chr(10),disease)
  when 2 then concat('the crop = "',crop,'"',chr(10),'disease = ',disease)
  when 3 then 'no idea'
  when 4 then concat('Class: ',crop,chr(10),'Disease: unseen_',disease)
  when 5 then concat(chr(10),' Class: ',crop,chr(10),'Disease: *',disease,' (likely)*')
  when 6 then concat('Class: ',replace(crop,' ','_'),chr(10),'Disease: ',disease)
  when 7 then concat('I think it is ',crop_disease_label,'.')
  else concat('Class: ',upper(crop),chr(10),'Disease: ',disease) end as output
from samples""",
    "features": """
select vec_id as sample_id, embedding as features, label as y_true,
  case when vec_id % 3 = 0 then 'lab' else 'field' end as source,
  case when vec_id % 5 = 0 then 'validation' else 'train' end as split
from embeddings""",
    "run_files": """
select p_partkey as run_pos, case p_partkey % 4
  when 0 then concat(lower(p_type),'_model_exp_0.000',cast(1+p_partkey%5 as varchar),'_',cast(16*(1+p_size%4) as varchar),'.pth')
  when 1 then concat(lower(p_type),'_model_exp_',cast(p_partkey%11 as varchar),'.pth')
  when 2 then concat('notes_',cast(p_partkey as varchar),'.pth')
  else concat('notes_',cast(p_partkey as varchar),'.txt') end as path
from part""",
    "epoch_log": """
select cast(user_id % 9 as int) as run_id, cast(extract(day from ts) % 10 as int) as epoch, event_id as step,
  event_type as metric, value from events""",
    "tokens": """
select conv_id, turn, list_transform(string_split(text,' '), lambda w: length(w)::int) as ids from conversations""",
    "positioned": """
select *, row_number() over (order by split, crop_disease_label, sample_id) - 1 as pos from samples""",
}
_NEEDS = {
    "samples": [], "classes": ["samples"], "labelled": ["classes"], "predictions": ["labelled"], "outputs": ["samples"],
    "features": [], "run_files": [], "epoch_log": [], "tokens": [], "positioned": ["samples"],
}


def with_views_sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for view in views:
        visit(view)
    parts = [f"{name} as ({SQL[name]})" for name in order]
    parts += [f"{name} as ({text})" for name, text in (extra or {}).items()]
    return f"with {', '.join(parts)}\n{body}" if parts else body
