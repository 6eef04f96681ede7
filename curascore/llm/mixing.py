"""Mixing of sources to target weights with hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and hash bucket. Whole passes over a source need no choice; for the rest of its budget the
bucket in which the running sum crosses the budget is found, only that bucket is refined, and then its boundary one
once more. The outcome is one threshold per source, and documents are taken by comparing hashes: nothing is sorted
but 4,096 sums per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table
from curascore.operators.lookup import lookup_join

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12


def sized(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Columns of ``carry``, ``sk`` (source as a key without nulls), ``size`` in words and the hash ``h`` of id and text."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return docs.select(
        *carry, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("sk"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``target`` for each row of ``totals(sk, source_size)``: all words shared by weight, none above its cap.

    Weights follow the order of the keys. Sources are taken in the order in which they reach their caps; the common
    level per weight is what the capped ones leave to the others. The windows run over one row per source.
    """
    nth = (F.row_number().over(Window.orderBy("sk")) - 1) % len(weights)
    placed = totals.withColumn("w", F.get(F.array(*map(F.lit, weights)), nth).cast("double")).withColumn(
        "cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = placed.withColumn("all", F.sum("source_size").over(everything).cast("double")).withColumn(
        "level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "sk", "level"))
    return levels.withColumn("common", F.min(fits).over(everything)["level"]).select(
        "sk", "source_size", F.least("cap", F.col("common") * F.col("w")).alias("target"))


def _bucket(shift: int):
    return F.shiftright("h", shift)


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """Per source the first row of ``sums(sk, base, need, <by>, s)`` where ``base`` and the running sum exceed ``need``."""
    run = Window.partitionBy("sk").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.withColumn("cum", F.col("base") + F.sum("s").over(run)).where("cum > need")
    return cum.groupBy("sk").agg(F.min(F.struct(F.col(by), F.col("cum"), F.col("s"), F.col("need"))).alias("x")).select(
        "sk", F.col(f"x.{by}").alias(by), (F.col("x.cum") - F.col("x.s")).alias("base"), "x.need", "x.s")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS,
                carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: the columns of ``carry``, ``size, source_size, target, taken``.

    Every document is taken ``floor(target / source_size)`` times; those with the smallest hashes once more, up to
    the sum nearest to what is missing. The choice depends on ids and texts only, so a rerun repeats it. Null texts
    have no words; a null source is one of its own, last in order; null ids are hashed as empty, so rows that agree in
    id and text have one hash, and of those at the threshold as many as needed are taken. No rows give no rows; a
    source without words has target 0. Columns not in ``carry`` are not looked at;
    those in it must not be named like the results.
    """
    rows = stored(sized(docs, ("doc_id",)), "sizes")
    totals = rows.groupBy("sk").agg(F.sum("size").alias("source_size"))
    share = stored(targets(totals, weights, most), "targets").withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("need", F.when(F.col("passes") < most, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0)))
    left = share.where("need > 0").select("sk", F.lit(0).cast("long").alias("base"), "need")
    one, two = HASH_BITS - LEVEL_BITS, HASH_BITS - 2 * LEVEL_BITS
    first = _crossing(lookup_join(rows.groupBy("sk", _bucket(one).alias("b")).agg(F.sum("size").alias("s")), left, "sk"), "b")
    inside = lookup_join(rows.withColumn("b", _bucket(one)), first.select("sk", "b", "base", "need"), ["sk", "b"])
    second = _crossing(inside.groupBy("sk", "base", "need", _bucket(two).alias("b")).agg(F.sum("size").alias("s")), "b")
    inside = lookup_join(rows.withColumn("b", _bucket(two)), second.select("sk", "b", "base", "need"), ["sk", "b"])
    exact = inside.groupBy("sk", "base", "need", "h").agg(F.sum("size").alias("s"), F.count("*").alias("k"))
    last = _crossing(exact.select("sk", "base", "need", "h", "s"), "h").join(exact.select("sk", "h", "k"), ["sk", "h"])
    edges = last.select("sk", F.col("h").alias("edge"), F.floor((F.col("need") - F.col("base")) * F.col("k") / F.col("s") + F.lit(0.5)).alias("ties"))
    plan = stored(share.join(edges, "sk", "left").select("sk", "source_size", "target", "passes", "edge", F.coalesce("ties", F.lit(0)).alias("ties")), "thresholds")
    placed = lookup_join(rows if carry == ("doc_id",) else sized(docs, carry), plan, "sk", "left")
    at_edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    plain = placed.where(~at_edge).withColumn("more", F.coalesce(F.col("h") < F.col("edge"), F.lit(False)))
    tied = placed.where(at_edge).withColumn("more", F.row_number().over(Window.partitionBy("sk").orderBy(*carry)) <= F.col("ties"))
    return plain.union(tied).select(*carry, "size", "source_size", "target",
                                    (F.col("size") * (F.col("passes") + F.col("more").cast("long"))).alias("taken"))


SQL = r"""
with s as (select doc_id, coalesce('s' || source, 't') as sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h from documents),
t as (select sk, sum(size)::bigint as source_size from s group by sk),
p as (select sk, source_size, ([5, 2, 1])[((row_number() over (order by sk) - 1) % 3) + 1]::double as w, (source_size * 3)::double as cap from t),
l as (select *, ((select sum(source_size)::double from p) - coalesce(sum(cap) over (order by cap / w, sk rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, sk rows between current row and unbounded following) as lev from p),
c as (select arg_min(lev, {'r': cap / w, 'k': sk}) as common from l where lev <= cap / w),
g as (select sk, source_size, least(cap, common * w) as target from l, c),
k as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from g),
n as (select *, case when passes < 3 then target - passes * source_size else 0 end as need from k),
e as (select s.*, source_size, target, passes, need, sum(size) over (partition by sk order by h, doc_id, size rows unbounded preceding) as cum from s join n using (sk)),
f as (select sk, min(h) as edge from e where need > 0 and cum > need group by sk),
o as (select sk, edge, floor((any_value(need) - coalesce(sum(size) filter (h < edge), 0)) * count(*) filter (h = edge) / sum(size) filter (h = edge) + 0.5) as ties
    from e join f using (sk) group by sk, edge)
select doc_id, size, source_size, target, size * (passes + case when h < edge then 1 when h = edge and rn <= ties then 1 else 0 end)::bigint as taken
from (select e.*, row_number() over (partition by sk, h order by doc_id, size) as rn from e) left join o using (sk)"""


@query("op7_mix_sources", SQL)
def op7_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))
