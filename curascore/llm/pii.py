"""Personal data by expression, and unseen identifiers by bootstrapped context patterns.

Base finds are the seeds. Every token with a digit is an instance; the words beside it are patterns. Scores go back
and forth over the graph of patterns and distinct instances: a pattern is as good as the share of its instances that
are known to be of a kind (with at least a number of different ones), an instance as good as its best pattern. Tokens
whose score passes the threshold are reported as identifiers of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table
from curascore.llm.secrets import digest_columns
from curascore.llm.spans import BASE_SPAN, kept, labelled, matches, touching

# Anchors and possessive marks keep long runs linear; they match what the plain expressions match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # a run with fewer digits fails as a whole
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
ROUNDS = 3
MIN_SEEDS = 3  # different known instances behind a pattern
MIN_SCORE = 0.8
_WORD = r"(\S+)"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(F.reverse(_digits(hit)), i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, digit).when(digit < 5, 2 * digit).otherwise(2 * digit - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(hit))), F.lit(0), add) % 10 == 0


def _card(hit: Column) -> Column:
    return F.length(_digits(hit)).between(14, 19) & _luhn(hit)


def _ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)


def base_spans(text: Column, hits: bool = False) -> Column:
    parts = [(EMAIL, None), (IP, _ip), (CARD, _card), (PHONE, lambda h: F.length(_digits(h)).between(10, 15))]
    return F.concat(*[labelled(kept(text, pattern, keep), kind, rank, hits) for rank, (kind, (pattern, keep)) in enumerate(zip(KINDS, parts, strict=True))])


def instances(text: Column) -> Column:
    """Tokens with a digit: place, value in lower case, and the word patterns around them."""

    def one(m: Column) -> Column:
        left, right = F.lower(F.right(m["left"], F.lit(64))), F.lower(F.left(m["right"], F.lit(64)))
        before, two = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
        after = F.regexp_extract(right, r"^\s*(\S+)", 1)
        patterns = F.array(F.when(before != "", F.concat(F.lit("1:"), before)), F.when(two != "", F.concat(F.lit("2:"), two)),
                           F.when((before != "") & (after != ""), F.concat(F.lit("b:"), before, F.lit(" _ "), after)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["hit"]).alias("value"), F.array_compact(patterns).alias("patterns"))

    return F.transform(matches(text, TOKEN), one)


def bootstrap(graph: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``(value, kind, score)`` of instances that patterns make likely, from ``graph(pattern, value, kind)``.

    ``kind`` is null for instances that are no seeds. Each (pattern, value) counts once, so copies of a text do not
    make a pattern. Rows are aggregated before they meet, and only written tables pass from round to round.
    """
    edges = stored(graph.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "patterns")
    seeds = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known, found = seeds, None
    for _ in range(rounds):
        good = edges.select("pattern", "value").join(known, "value").groupBy("pattern", F.col("kind")).agg(
            F.sum("score").alias("mass"), F.count("*").alias("k")).where(F.col("k") >= min_seeds).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("mass") / F.col("n")).alias("score")).where(F.col("score") >= min_score)
        found = stored(edges.where("kind is null").select("pattern", "value").join(good, "pattern").groupBy("value").agg(
            F.max(F.struct("score", "kind")).alias("x")).select("value", "x.kind", "x.score"), "found")
        known = seeds.union(found)
    return found


def personal_data(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, labelled ``base`` spans and ``linked`` spans of context finds
    (kinds ``ctx_email``, ``ctx_ip``, ``ctx_card``, ``ctx_phone``).

    A null or empty text has no spans; rows with a repeated or null id are scanned one by one. Instances that touch a
    base span are seeds and are not reported again. Other columns of ``docs`` are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", "text", base_spans(F.col("text"), hits=True).alias("base"), instances(F.col("text")).alias("tokens"),
        F.when(F.regexp_like("text", F.lit("[0-9]")), F.md5("text")).alias("key"))

    def labelled_token(met: Column) -> Column:
        t, seed = met["span"], met["base"]
        # Tokens of one base find are the same instance: the whole find.
        whole = F.lower(seed["hit"])
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.coalesce(whole, t["value"]).alias("value"),
                        t["patterns"].alias("patterns"), seed["kind"].alias("kind"))

    tokens = F.transform(touching(F.col("tokens"), F.col("base"), BASE_SPAN.replace(">", ",hit:string>")), labelled_token)
    plain = F.transform("base", lambda m: F.struct(*(m[f].alias(f) for f in ("start", "rank", "end", "kind"))))
    rows = stored(scanned.select("doc_id", plain.alias("base"), tokens.alias("tokens"), "key"), "personal")
    each = rows.select("key", F.explode("tokens").alias("t")).select("key", "t.*")
    found = bootstrap(each.select(F.explode("patterns").alias("pattern"), "value", "kind"), rounds, min_seeds, min_score)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("found")).cast("int") + len(KINDS) - 1
    spans = each.where("kind is null").select("key", "start", "end", "value").distinct().join(
        found.select("value", F.col("kind").alias("found")), "value").groupBy("key").agg(
        F.collect_list(F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("ctx_"), F.col("found")).alias("kind"))).alias("linked"))
    none = F.array().cast(spans.schema["linked"].dataType)
    alone = rows.where("key is null").select("doc_id", "base", none.alias("linked"))
    return alone.union(rows.where("key is not null").join(spans, "key", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked")))


@query("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    return digest_columns(personal_data(table(spark, sf_dir, "documents")), KINDS)
