"""Positions of regular-expression matches as columns; DataFrame functions only.

Positions are code points, ends exclusive. Matches are leftmost and do not overlap, as the expression finds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curascore.functions.lets import let

_PLACES = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


SCAN_BLOCK = 128  # values that are scanned by appending one after the other


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive scan of an array with an associative ``step``: element i combines the values up to i.

    Appending copies an array, so blocks of ``SCAN_BLOCK`` values are scanned, then what the blocks come to, and each
    block is combined with all before it: the work grows with the values, not with their square.
    """

    def scanned(block: Column) -> Column:
        start = F.array(F.get(block, F.lit(0)))
        return F.aggregate(F.slice(block, 2, F.greatest(F.size(block) - 1, F.lit(0))), start, lambda out, x: F.array_append(out, step(F.element_at(out, -1), x)))

    def joined(inner: Column) -> Column:
        ends = scanned(F.transform(inner, lambda x: F.element_at(x, -1)))
        return let(ends, lambda e: F.flatten(F.transform(inner, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: step(F.get(e, i - 1), v))))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int")), lambda i: F.slice(v, i * SCAN_BLOCK + 1, SCAN_BLOCK))
        return F.when(F.size(v) <= SCAN_BLOCK, F.when(F.size(v) > 0, scanned(v)).otherwise(v)).otherwise(let(F.transform(blocks, scanned), joined))

    return let(values, whole)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, hit, left, right>>``: each match with the text from the match before and to the next.

    What lies between matches comes from splitting at them; positions are running lengths. A text without a match
    costs one search. A null text has none.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def place(both: Column) -> Column:
        steps = F.transform(both["hits"], lambda h, i: F.length(F.get(both["gaps"], i)) + F.length(h))

        def structs(ends: Column) -> Column:
            return F.transform(both["hits"], lambda h, i: F.struct(
                (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"),
                F.get(both["gaps"], i).alias("left"), F.get(both["gaps"], i + 1).alias("right")))

        return let(running(steps, lambda a, b: a + b), structs)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(joined, place)).otherwise(F.array().cast(_PLACES))


def touching(spans: Column, base: Column, kind: str) -> Column:
    """For spans sorted by start, ``array<struct<span, base>>``: each with a base span that it overlaps, or null.

    ``kind`` is the type of a base span. Both lists are merged in order of their starts; a span overlaps one that began
    earlier exactly if the latest end so far lies behind its start, and else a later one if the next start lies before
    its end. Nothing is compared pair by pair.
    """

    def merged(both: Column) -> Column:
        entry = lambda x, own, is_base: F.struct(
            x["start"].alias("s"), F.lit(0 if is_base else 1).alias("o"), own.alias("i"), x["end"].alias("e"),
            (x if is_base else F.lit(None).cast(kind)).alias("b"))
        rows = F.array_sort(F.concat(F.transform(both["base"], lambda x, i: entry(x, i, True)), F.transform(both["spans"], lambda x, i: entry(x, i, False))))

        def found(all_: Column) -> Column:
            latest = running(F.transform(all_, lambda x: F.when(x["o"] == 0, F.struct(x["e"].alias("at"), x["b"].alias("b")))), F.greatest)
            soonest = running(F.transform(F.reverse(all_), lambda x: F.when(x["o"] == 0, F.struct(x["s"].alias("at"), x["b"].alias("b")))), F.least)

            def chosen(sides: Column) -> Column:
                pick = F.transform(all_, lambda x, k: F.struct(x["o"].alias("o"), x["i"].alias("i"), F.coalesce(
                    F.when(F.get(sides["latest"], k)["at"] > x["s"], F.get(sides["latest"], k)["b"]),
                    F.when(F.get(sides["soonest"], k)["at"] < x["e"], F.get(sides["soonest"], k)["b"])).alias("b")))
                return F.transform(F.filter(pick, lambda x: x["o"] == 1), lambda x: F.struct(F.get(both["spans"], x["i"]).alias("span"), x["b"].alias("base")))

            return let(F.struct(latest.alias("latest"), F.reverse(soonest).alias("soonest")), chosen)

        return let(rows, found)

    alone = F.transform(spans, lambda x: F.struct(x.alias("span"), F.lit(None).cast(kind).alias("base")))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), alone).otherwise(let(F.struct(spans.alias("spans"), base.alias("base")), merged))


BASE_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def kept(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<start, end, hit>>`` of the matches whose string passes ``keep``; the others are dropped, not retried."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["hit"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit")))


def labelled(spans: Column, kind: str, rank: int, hits: bool = False) -> Column:
    """The spans as ``array<struct<start, rank, end, kind>>``, which sorts by start, then by kind as ranked; with ``hits``
    each holds its string as well."""
    own = lambda m: [m["hit"].alias("hit")] if hits else []
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), *own(m)))


def written(spans: Column) -> Column:
    """``kind:start:end`` of labelled spans, comma-joined in order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
