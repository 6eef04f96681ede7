"""Secret scan with linking of credential parts; DataFrame functions only.

Base secrets are found by expression. Access identifiers, bare secrets and endpoints that are too weak to be reported
alone become parts with a position; parts of a text are joined by scope (a stretch of characters), and a bare secret
is reported only next to an identifier or endpoint, those only next to a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table
from curascore.llm.spans import BASE_SPAN, kept, labelled, matches, touching, written

# Anchors and possessive marks keep long runs linear; they match what the plain expressions match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # shorter runs fail as a whole
HEX = r"[0-9a-f]{24,}+"  # a run of hexadecimal digits is long enough or fails as a whole
KINDS = ("assign", "access", "hex")

WEAK_IDENT = r"(?<![A-Za-z0-9])(?:ASIA|AIDA|AROA|AGPA|AKIA)[A-Z0-9]{8,}+|(?i:client_?id|access_?key_?id|user(?:name)?)\x20?[:=]\x20?[A-Za-z0-9._@-]{3,}+"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]++|(?<![A-Za-z0-9.@-])(?:[a-z0-9-]++\.(?=[a-z0-9]))++(?:com|net|org|io|internal|local)(?![A-Za-z0-9.-])(?::[0-9]++)?"""
WEAK_KINDS = ("ident", "secret", "endpoint")
SCOPE = 256  # characters between the starts of parts that belong together

_PARTS = "array<struct<start:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text as labelled spans."""
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN_VALUE, 1)) >= 6
    return F.concat(labelled(kept(text, ASSIGN, long_value), "assign", 0), labelled(kept(text, ACCESS), "access", 1),
                    labelled(kept(text, HEX), "hex", 2))


def weak_parts(text: Column) -> Column:
    of = lambda pattern, kind: F.transform(matches(text, pattern), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.concat(of(WEAK_IDENT, "ident"), of(WEAK_SECRET, "secret"), of(ENDPOINT, "endpoint"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """From ``parts(key, start, end, kind, base)`` the weak parts that have a complement within ``scope``.

    A part meets those of its own stretch of ``scope`` characters and of the two beside it. Parts of a kind do not
    overlap, so a stretch holds a bounded number of them and pairs grow with the text.
    """
    cell = F.floor(F.col("start") / scope)
    role = F.when(F.col("kind").isin("secret", "assign", "hex"), "secret").otherwise("place")
    all_parts = parts.withColumn("cell", cell).withColumn("role", role)
    weak = all_parts.where("not base").select("key", "start", "end", "kind", "role", "cell")
    near = all_parts.select("key", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"),
                            F.col("start").alias("other"), F.col("role").alias("other_role"))
    together = (F.col("role") != F.col("other_role")) & (F.abs(F.col("start") - F.col("other")) <= scope)
    return weak.join(near, ["key", "cell"]).where(together).select("key", "start", "end", "kind").distinct()


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, labelled ``base`` spans and ``linked`` spans.

    Equal texts are linked once, by digest. A null or empty text has no spans. Rows with a repeated or null id are
    scanned one by one. Weak parts that touch a base span belong to it and are not reported again. Other columns of
    ``docs`` are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", "text", base_spans(F.col("text")).alias("base"), weak_parts(F.col("text")).alias("weak"))
    met = touching(F.array_sort("weak"), F.col("base"), BASE_SPAN)
    free = F.transform(F.filter(met, lambda x: x["base"].isNull()), lambda x: x["span"])
    rows = stored(
        scanned.withColumn("weak", free).select(
            "doc_id", "base", "weak", F.when((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1), F.md5("text")).alias("key")),
        "secrets")
    several = rows.where("key is not null").dropDuplicates(["key"])
    part = lambda column, is_base: several.select("key", F.explode(column).alias("p")).select(
        "key", "p.start", "p.end", "p.kind", F.lit(is_base).alias("base"))
    linked = link_parts(part("base", True).union(part("weak", False)), scope)
    rank = F.array_position(F.array(*map(F.lit, WEAK_KINDS)), F.col("kind")).cast("int") + len(KINDS) - 1
    spans = linked.groupBy("key").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")).alias("linked"))
    alone = rows.where("key is null").select("doc_id", "base", F.array().cast(spans.schema["linked"].dataType).alias("linked"))
    return alone.union(rows.where("key is not null").join(spans, "key", "left").select(
        "doc_id", "base", F.coalesce("linked", F.array().cast(spans.schema["linked"].dataType)).alias("linked")))


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.concat("base", "linked")).alias("spans"))


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    return digest_columns(secrets(table(spark, sf_dir, "documents")), KINDS)
