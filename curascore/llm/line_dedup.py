"""Removal of repeated runs of lines by winnowing; DataFrame functions only.

From every line on, the fewest lines with at least ``GRAM`` words form a gram. Of the grams that start within
``WINDOW`` words of each other the one with the least hash is a fingerprint, so two texts that share a run of more than
``GRAM + WINDOW`` words share a fingerprint of it. Each occurrence of a fingerprint is joined to the first one (order of
ids, then of lines), the match is extended line by line both ways, and the later run is deleted. An extension looks no
further than a run that would hold another fingerprint, counted from the gram's first line to the left and from the end
of its last line to the right; that one is then deleted in its own right: no pairs of occurrences, and rows grow with
the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table

GRAM, WINDOW = 40, 10
REACH = GRAM + WINDOW
_LAST = 2**63 - 1
_BLANK = r"[\x20\x09-\x0D]"


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the order ``o`` (ids, null last) and ``k``, which tells apart texts with the same id."""
    return docs.withColumns({"_o": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_k": _hash(F.coalesce("text", F.lit("")))})


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with words: ``o, k, pos, h`` (hash of the line without blanks at its ends), ``w`` words, ``off`` words before."""
    line = F.regexp_replace("line", rf"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")
    rows = docs.select("_o", "_k", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")).select(
        F.col("_o").alias("o"), F.col("_k").alias("k"), "pos", line.alias("line")).where("line <> ''").select(
        "o", "k", "pos", _hash(F.col("line")).alias("h"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    # Rows that agree in id and text are one document.
    once = rows.repartition("o", "k").groupBy("o", "k", "pos").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    before = Window.partitionBy("o", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("off", F.coalesce(F.sum("w").over(before), F.lit(0)))


def fingerprints(lines: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Selected grams: ``g`` (hash), place (``o, k, off``), first and last line, and the lines around it."""
    place = Window.partitionBy("o", "k").orderBy("off")
    reach = gram + window
    here, left, ahead = place.rangeBetween(0, gram - 1), place.rangeBetween(-reach, -1), place.rangeBetween(0, reach)
    at = F.struct("h", "pos")
    grams = lines.select(
        "o", "k", "off", "pos", F.sum("w").over(here).alias("words"), F.collect_list("h").over(here).alias("gram"), F.max("pos").over(here).alias("end"),
        F.collect_list(at).over(left).alias("left"), F.collect_list(at).over(ahead).alias("ahead")).withColumn(
        "g", F.when(F.col("words") >= gram, _hash(F.array_join(F.col("gram").cast("array<string>"), ",")))).drop("gram", "words")
    # What is right of a gram starts at the line after its last one, however long that is.
    grams = grams.withColumn("ahead", F.lead("ahead").over(place)).withColumn("right", F.coalesce(F.last("ahead").over(here), F.array().cast(grams.schema["ahead"].dataType))).drop("ahead")
    # Rightmost least hash of each window; a gram is kept if some window picks it.
    chosen = grams.withColumn("least", F.min(F.when(F.col("g").isNotNull(), F.struct("g", (-F.col("off")).alias("m")))).over(place.rangeBetween(0, window)))
    picked = F.collect_set("least.m").over(place.rangeBetween(-window, 0))
    return chosen.withColumn("picked", picked).where(F.col("g").isNotNull() & F.array_contains("picked", -F.col("off"))).drop("picked", "least")


def _alike(a: Column, b: Column) -> Column:
    """How many lines agree from the start of both arrays on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise((stop - 1).cast("int"))


def repeated_runs(prints: DataFrame) -> DataFrame:
    """``(o, k, a, b)``: disjoint ranges of line numbers to delete."""
    first = prints.groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("o", "k", "off", "end", "left", "right")).alias("f")).where("n > 1").select("g", "f")
    later = prints.join(first, "g").where("o <> f.o or k <> f.k or off <> f.off")
    left, right = F.reverse("left"), F.col("right")
    grown = later.withColumn("l", _alike(left, F.reverse("f.left"))).withColumn("r", _alike(right, F.col("f.right")))
    start = F.when(F.col("l") > 0, F.element_at(left, F.col("l"))["pos"]).otherwise(F.col("pos"))
    end = F.when(F.col("r") > 0, F.element_at(right, F.col("r"))["pos"]).otherwise(F.col("end"))
    own = (F.col("o") == F.col("f.o")) & (F.col("k") == F.col("f.k"))
    ranges = grown.select("o", "k", F.when(own, F.greatest(start, F.col("f.end") + 1)).otherwise(start).alias("a"), end.alias("b")).where("a <= b")
    order = Window.partitionBy("o", "k").orderBy("a", "b")
    fresh = F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    return ranges.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order)).groupBy("o", "k", "island").agg(
        F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` (with ``doc_id, text``) with repeated runs deleted from ``text``, and ``n_lines, n_removed``.

    A run of lines repeats if it holds a gram that occurred before: in a row with a smaller id (null ids last; equal
    ids by hash of the text), or further up in the same text and without overlap. Lines are compared without blanks at
    their ends; blank lines inside a deleted run go with it. Every deleted line stays somewhere before. A null text
    stays null and has no lines; an empty text has one; a text may lose all its lines and is then empty. Rows that agree in id and text are
    treated as one and keep the same text. Columns ``n_lines`` and ``n_removed`` of ``docs`` are replaced.
    """
    docs = keyed(docs.drop("n_lines", "n_removed", "_o", "_k"))
    ranges = repeated_runs(stored(fingerprints(lines_of(docs), gram, window), "fingerprints")).groupBy("o", "k").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cut"))
    joined = docs.join(ranges.select(F.col("o").alias("_o"), F.col("k").alias("_k"), "_cut"), ["_o", "_k"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("_cut", lambda r: (i >= r["a"]) & (i <= r["b"])))
    gone = F.aggregate("_cut", F.lit(0), lambda n, r: n + (r["b"] - r["a"] + 1))
    columns = [c for c in docs.columns if c not in ("_o", "_k")]
    return joined.select(
        *(F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))


SQL = rf"""
with d as (select doc_id, text, coalesce(doc_id, {_LAST}) as o, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as k from documents),
x as (select o, k, unnest(string_split(t, chr(10))) as raw, unnest(range(len(string_split(t, chr(10)))))::int as pos
  from (select distinct o, k, coalesce(text, '') as t from d)),
t as (select o, k, pos, regexp_replace(raw, '^{_BLANK}+|{_BLANK}+$', '', 'g') as line from x),
l0 as (select o, k, pos, ('0x' || substr(md5(line), 1, 15))::bigint as h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::bigint as w from t where line <> ''),
l as (select *, coalesce(sum(w) over (partition by o, k order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as off from l0),
g1 as (select *, sum(w) over here as words, list(h) over here as gram, max(pos) over here as e,
    list({{'h': h, 'pos': pos}}) over (partition by o, k order by off range between {REACH} preceding and 1 preceding) as lf,
    list({{'h': h, 'pos': pos}}) over (partition by o, k order by off range between current row and {REACH} following) as ahead
  from l window here as (partition by o, k order by off range between current row and {GRAM - 1} following)),
g2 as (select *, lead(ahead) over (partition by o, k order by off) as nxt from g1),
g0 as (select * exclude (nxt), last(nxt) over (partition by o, k order by off range between current row and {GRAM - 1} following) as rt from g2),
g as (select o, k, off, pos, e, coalesce(lf, []) as lf, coalesce(rt, []) as rt,
    case when words >= {GRAM} then ('0x' || substr(md5(array_to_string(gram, ',')), 1, 15))::bigint end as g from g0),
c as (select o, k, unnest([min(case when g is not null then {{'g': g, 'm': -off}} end) over (partition by o, k order by off range between current row and {WINDOW} following)]) as least from g),
s as (select g.* from g join (select distinct o, k, -(least.m) as off from c where least is not null) q using (o, k, off) where g is not null),
f as (select g, min({{'o': o, 'k': k, 'off': off, 'e': e, 'lf': lf, 'rt': rt}}) as f from s group by g having count(*) > 1),
m as (select s.*, f.f, least(len(lf), len(f.lf)) as ln, least(len(rt), len(f.rt)) as rn from s join f using (g) where o <> f.o or k <> f.k or off <> f.off),
n as (select *, coalesce(list_min(list_filter(range(0, ln), lambda i: lf[len(lf) - i].h <> f.lf[len(f.lf) - i].h)), ln) as nl,
    coalesce(list_min(list_filter(range(0, rn), lambda i: rt[i + 1].h <> f.rt[i + 1].h)), rn) as nr from m),
r0 as (select o, k, case when nl > 0 then lf[len(lf) - nl + 1].pos else pos end as a0, case when nr > 0 then rt[nr].pos else e end as b, o = f.o and k = f.k as own, f.e as fe from n),
r as (select distinct o, k, p from (select o, k, unnest(range(case when own then greatest(a0, fe + 1) else a0 end, b + 1)) as p from r0)),
z as (select o, k, list(p) as gone from r group by o, k)
select doc_id, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda y, i: not list_contains(gone, i - 1)), chr(10)) end as text,
  coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed
from d left join z using (o, k)"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
