"""N-gram Jaccard join by grouped prefixes: sets of word shingles that overlap by at least a given share.

1. Texts become sets of hashed shingles; texts with equal sets form a class, which is handled once.
2. Shingles are dealt out by hash to count the classes that hold each. A shingle of one class only cannot be shared;
   what remains goes back to its class. Shingles found often within one batch are taken as frequent there and then:
   only a mark travels by hash, so no task gathers a shingle that a third of all texts hold.
   This is done in two rounds. The first one deals the lowest third of all hash values, of every class. A class that has
   more than ``n - ceil(t n)`` shingles to itself in that third alone cannot be linked, whatever the rest holds. The
   second one deals the other hash values of the classes that are left, which are all that a link can join.
3. Order every set from rare to frequent. Linked sets share one of their first ``n - ceil(t n) + 1`` shingles, so a
   class whose first shingles are all its own is done. The others collapse into groups with the same size and prefix.
4. Groups that share a prefix shingle and fit in size are paired, expanded to member classes and verified on the
   whole sets. First every list is only paired with one of its groups, which joins the bulk of large groups of near
   copies by a number of links linear in their size; then all remaining pairs of different components follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curascore.llm.base import query, stored, table, text_bytes
from curascore.llm.components import components
from curascore.llm.packing import pack, unpack
from curascore.llm.words import Words, blank_separated, byte_texts, chunks, lowered, runs_of

SHINGLE_WORDS = 5
PERCENT = 80
PART_BYTES = 8_000_000  # bytes of text whose shingles form one part
FLUSH = 600_000  # shingles that a task gathers before it deals them out
FREQUENT = 48  # classes of one flush that make a shingle frequent
FREQUENT_DF = 2**31 - 1
STAR_PIVOTS = 6
LONG_LIST, BLOCK = 64, 192  # lists above are compared block by block, with so many classes in a block
SLOTS = 1 << 24  # bits of the table that names the texts of the second round; where they are few, more texts pass it
HASHES = 1 << 32  # ranges of hashes are bounded by their upper halves
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    member, fold = blank_separated(), lowered()
    for start, end in chunks(texts):
        words = Words(texts[start:end], member, fold)
        hashes = words.hashes
        runs = runs_of(hashes, size)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield runs_of(hashes[a:b], b - a) if b > a else _EMPTY


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


_DEALT = "kind int, part int, doc_id long, n int, low int, class long, t long, e binary, f binary"
_DEALT_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("low", pa.int32()), ("class", pa.int64()), ("t", pa.int64()), ("e", pa.binary()), ("f", pa.binary())])
_DOC, _ENTRY, _HOT = 0, 1, 2


def pack_entries(h: np.ndarray, c: np.ndarray, s: np.ndarray, d: np.ndarray | None = None) -> bytes:
    """Entries (shingle hash, class, size of the class's set, count) as one value: hashes ascending, a class and its size
    once, with each entry the place of its class; about half of what the plain columns take."""
    order = np.argsort(h, kind="stable")
    classes, first, place = np.unique(c[order], return_index=True, return_inverse=True)
    parts = [pack(h[order], ascending=True), pack(classes.view(np.uint64), ascending=True), pack(s[order][first]), pack(place)]
    if d is not None:
        parts.append(pack(d[order]))
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_entries(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns (h, c, s, d) of some packed values, one after the other; d is 0 where it was not packed."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
    for data in values:
        parts, at = [], 0
        while data and at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        if parts:
            h, place = unpack(parts[0], ascending=True), unpack(parts[3]).astype(np.int64)
            found[0].append(h)
            found[1].append(unpack(parts[1], ascending=True).view(np.int64)[place])
            found[2].append(unpack(parts[2]).astype(np.int32)[place])
            found[3].append(unpack(parts[4]).astype(np.int32) if len(parts) > 4 else np.zeros(len(h), np.int32))
    h, c, s, d = (np.concatenate(x) for x in found)
    return h, c, s, d


def _rows(kind: int, part: list[int], e: list[bytes | None], f: list[bytes | None]) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(part, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
         pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(e, pa.binary()), pa.array(f, pa.binary())], schema=_DEALT_ARROW)


def _split(part: np.ndarray, *columns: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """The columns of each part that has entries."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    columns = [x[order] for x in columns]
    return [(int(part[a]), [x[a:b] for x in columns]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]


def _by_class(c: np.ndarray, parts: int) -> np.ndarray:
    return (c.view(np.uint64) % np.uint64(parts)).astype(np.int32)


def _deal(batches, parts: int, ranges: int, size: int, lo: int, hi: int, wanted: np.ndarray | None = None):
    """For each of ``ranges`` of the hashes from ``lo`` to ``hi`` its entries (hash, class, set size), and doc rows.

    Ranges follow each other, so what an entry's hash takes does not depend on their number. The first doc row that a
    task makes of a class goes to the class's part and names its text; copies are spread. With ``wanted``, a table of
    bits, only texts with their bit set are looked at and there are no doc rows.
    """
    seen: set[int] = set()
    held: list[tuple[np.ndarray, int, int]] = []
    copies = 0

    def range_of(h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) - np.uint64(lo)) * np.uint64(ranges) // np.uint64(hi - lo)).astype(np.int32)

    def flush():
        h = np.concatenate([x for x, _, _ in held])
        at = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x, _, _ in held])
        classes, sizes = np.array([c for _, c, _ in held], np.int64), np.array([n for _, _, n in held], np.int32)
        held.clear()
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        count = np.diff(np.append(first, len(h)))
        often = h[first[count >= FREQUENT]]
        if len(often):
            hot = np.repeat(count >= FREQUENT, count)
            c = classes[at[hot]]
            dealt = _split(_by_class(c, parts), h[hot], c, sizes[at[hot]])
            yield _rows(_HOT, [p for p, _ in dealt], [pack_entries(*x) for _, x in dealt], [None] * len(dealt))
            dealt = _split(range_of(often), often)
            yield _rows(_ENTRY, [p for p, _ in dealt], [None] * len(dealt), [x.tobytes() for _, (x,) in dealt])
            h, at = h[~hot], at[~hot]
        part = range_of(h)
        bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(h)]
        pieces = list(zip(bounds[:-1], bounds[1:], strict=True))
        yield _rows(_ENTRY, [int(part[a]) for a, _ in pieces], [pack_entries(h[a:b], classes[at[a:b]], sizes[at[a:b]]) for a, b in pieces], [None] * len(pieces))

    total = 0
    for batch in batches:
        if wanted is not None:
            slot = batch.column("t").to_numpy() & (SLOTS - 1)
            batch = batch.filter(pa.array(wanted[slot >> 6] >> (slot & 63) & 1 == 1))
        made: list[tuple[int, int, int, int, int | None]] = []
        for t, shingles in zip(batch.column("t").to_pylist(), shingle_sets(byte_texts(batch.column("text")), size), strict=True):
            key, n, low = class_of(shingles), len(shingles), 0
            if key in seen:
                made.append((copies % parts, n, low, key, None))
                copies += 1
                continue
            seen.add(key)
            if n:
                a, b = np.searchsorted(shingles >> np.uint64(32), np.array([lo, hi], np.uint64))
                low = int(b - a)
                if low:
                    held.append((shingles[a:b].copy(), key, n))
                    total += low
            made.append((key % (1 << 64) % parts, n, low, key, t))
            if total >= FLUSH:
                yield from flush()
                total = 0
        if wanted is None:
            n = len(made)
            blank = pa.nulls(n, pa.binary())
            part, sizes, lows, classes, texts = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, _DOC, np.int32)), pa.array(part, pa.int32()), batch.column("doc_id"), pa.array(sizes, pa.int32()),
                 pa.array(lows, pa.int32()), pa.array(classes, pa.int64()), pa.array(texts, pa.int64()), blank, blank], schema=_DEALT_ARROW)
    if held:
        yield from flush()


_SHARED = "part int, e binary"
_SHARED_ARROW = pa.schema([("part", pa.int32()), ("e", pa.binary())])


def _count(group: pa.Table, parts: int) -> pa.Table:
    """From the entries of a range of hashes, those of two classes or more or marked frequent, dealt by class."""
    h, c, s, _ = unpack_entries(group.column("e").to_pylist())
    often = np.frombuffer(b"".join(x for x in group.column("f").to_pylist() if x), np.uint64)
    often = np.unique(often)
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = np.diff(h[order]) == 0
    repeated = same[:-1] | same[1:]
    if len(often):
        at = np.minimum(np.searchsorted(often, h[order]), len(often) - 1)
        repeated |= often[at] == h[order]
    order = order[repeated]
    h, c, s = h[order], c[order], s[order]
    order = np.lexsort((c, h))
    h, c, s = h[order], c[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c, s = h[new], c[new], s[new]
    values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    d = count[inverse]
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        d = np.where(often[at] == h, FREQUENT_DF, d)
    keep = d >= 2
    h, c, s, d = h[keep], c[keep], s[keep], d[keep].astype(np.int32)
    dealt = _split(_by_class(c, parts), h, c, s, d)
    return pa.Table.from_arrays([pa.array([p for p, _ in dealt], pa.int32()), pa.array([pack_entries(*x) for _, x in dealt], pa.binary())], schema=_SHARED_ARROW)


_LEFT = "part int, e binary, slots array<int>, rest long"
_LEFT_ARROW = pa.schema([("part", pa.int32()), ("e", pa.binary()), ("slots", pa.list_(pa.int32())), ("rest", pa.int64())])


def _distinct_entries(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed entries by class, from rare to frequent, each once."""
    h, c, s, d = unpack_entries(values)
    order = np.lexsort((h, d, c))
    h, c, s, d = h[order], c[order], s[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h[new], c[new], s[new], d[new]


def _left(group: pa.Table, percent: int) -> pa.Table:
    """What the first round leaves of a part's classes: their entries, the slots of a text of each, and the number of
    their shingles that the second round deals."""
    rows = group.filter(pc.is_valid(group.column("t")))
    n, low, c, t = (rows.column(x).to_numpy().astype(np.int64) for x in ("n", "low", "class", "t"))
    classes, first = np.unique(c, return_index=True)
    n, low, t = n[first], low[first], t[first]
    h, c, s, d = _distinct_entries(group.column("e").to_pylist())
    at = np.searchsorted(classes, c)
    own = low - np.bincount(at, minlength=len(classes))
    left = (n > 0) & (own <= n - -(-percent * n // 100))
    keep = left[at]
    return pa.Table.from_arrays(
        [pa.array([group.column("part")[0].as_py()], pa.int32()), pa.array([pack_entries(h[keep], c[keep], s[keep], d[keep])], pa.binary()),
         pa.array([(t[left] & (SLOTS - 1)).astype(np.int32)], pa.list_(pa.int32())), pa.array([int((n - low)[left].sum())], pa.int64())], schema=_LEFT_ARROW)


_CANDIDATE = "class long, n int, grp long, m int, core double, prefix array<long>, shared binary"
_CANDIDATE_ARROW = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("grp", pa.int64()), ("m", pa.int32()), ("core", pa.float64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])


def _prefixes(group: pa.Table, percent: int) -> pa.Table:
    """Classes of a part whose prefix holds a shared shingle: group key, shared part of the prefix, shared shingles."""
    h, c, s, d = _distinct_entries(group.column("e").to_pylist())
    d = np.log2(d)
    bounds = [*np.flatnonzero(np.diff(c, prepend=c[:1] - 1)).tolist(), len(c)]
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(s[a])
        need = -(-percent * n // 100)
        k = n - need + 1 - (n - (b - a))
        if k > 0:
            prefix = h[a : min(b, a + k)]
            rows.append((int(c[a]), n, class_of(np.append(prefix, np.uint64(n))), int(b - a), float(d[a:b].sum()) / n, prefix.view(np.int64), np.sort(h[a:b]).tobytes()))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_CANDIDATE_ARROW.types)], schema=_CANDIDATE_ARROW)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose whole sets are similar enough."""
    side = lambda k: sets.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("shared").alias(f"s{k}"))

    def check(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(x).to_pylist() for x in ("a", "b", "na", "nb", "sa", "sb"))
            keep = []
            for i in range(batch.num_rows):
                both = len(np.intersect1d(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64), assume_unique=True))
                if 100 * both >= percent * (na[i] + nb[i] - both):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    # Sets grow with the texts: one join strategy at every size.
    wide = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return wide.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(check, "a long, b long")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, class)`` per row of ``docs(doc_id, text)``, and ``(class, root)`` of the classes with links.

    Classes are equal shingle sets; two classes have the same root exactly if links lead from one to the other.
    """
    total = text_bytes(docs)
    parts = max(4, -(-total // PART_BYTES))
    # A class passes by a share of hashes if (100 - percent) % of its shingles are its own there: the bound is 60 % of them.
    cut = min(HASHES, HASHES * (100 - percent) // 60)
    ranges = max(4, -(-total * cut // HASHES // PART_BYTES))
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    dealt = texts.mapInArrow(lambda x: _deal(x, parts, ranges, size, 0, cut), _DEALT)
    shared_rows = "kind int, doc_id long, n int, low int, class long, t long, " + _SHARED
    out_arrow = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("low", pa.int32()), ("class", pa.int64()), ("t", pa.int64()), *_SHARED_ARROW])

    def count(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        rows = group.filter(pa.array(kinds == _DOC))
        made = [pa.Table.from_arrays([*(rows.column(x) for x in ("kind", "doc_id", "n", "low", "class", "t", "part")), pa.nulls(rows.num_rows, pa.binary())], schema=out_arrow)]
        hot = []
        for e in group.filter(pa.array(kinds == _HOT)).column("e").to_pylist():
            h, c, s, _ = unpack_entries([e])
            hot.append(pack_entries(h, c, s, np.full(len(h), FREQUENT_DF, np.int32)))
        shared = _count(group.filter(pa.array(kinds == _ENTRY)), parts)
        for part, e in ((pa.array([group.column("part")[0].as_py()] * len(hot), pa.int32()), pa.array(hot, pa.binary())), shared.columns):
            n = len(e)
            blank = [pa.nulls(n, x) for x in out_arrow.types[1:6]]
            made.append(pa.Table.from_arrays([pa.array(np.full(n, 1, np.int32)), *blank, part, e], schema=out_arrow))
        return pa.concat_tables(made)

    counted = stored(dealt.groupBy("part").applyInArrow(count, shared_rows), "shingles", "kind")
    rows = counted.where("kind = 0").select("doc_id", "n", "class")
    left = stored(
        counted.where("kind = 1 or t is not null").select("part", "n", "low", "class", "t", "e").groupBy("part").applyInArrow(lambda x: _left(x, percent), _LEFT),
        "left")
    rest = left.agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("rest")).first()["rest"]
    entries = left.select("part", "e")
    if rest:
        wanted, more = _slots(left), max(4, -(-8 * rest // PART_BYTES))
        others = texts.mapInArrow(lambda x: _deal(x, parts, more, size, cut, HASHES, wanted), _DEALT)
        entries = entries.union(others.groupBy("part").applyInArrow(count, shared_rows).select("part", "e"))
    candidates = stored(entries.groupBy("part").applyInArrow(lambda x: _prefixes(x, percent), _CANDIDATE), "prefixes")
    return rows, _link(candidates, percent)


def _slots(left: DataFrame) -> np.ndarray:
    """The table of ``SLOTS`` bits in words of 64, bounded whatever the number of texts."""
    words = left.select(F.explode("slots").alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits")).toArrow()
    table = np.zeros(SLOTS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table


def _link(sets: DataFrame, percent: int) -> DataFrame:
    groups = sets.groupBy("grp", "n").agg(F.min("class").alias("leader"), F.max("m").alias("m"), F.max("core").alias("core"), F.first("prefix").alias("prefix"))
    postings = stored(groups.select("grp", "n", "m", "leader", "core", F.explode("prefix").alias("h")), "postings")
    # Shingles of a shared stretch are held by the same groups: one list stands for all with equal members.
    held = postings.groupBy("h").agg(F.count("*").alias("k"), F.sum(F.hash("grp").cast("long")).alias("x"), F.bit_xor(F.xxhash64("grp")).alias("y"))
    kept = held.where("k > 1").groupBy("k", "x", "y").agg(F.min("h").alias("h")).select("h")
    # The members of a group are a list as well, each as a unit of its own.
    several = sets.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    within = sets.join(several, "grp").select(F.col("grp").alias("h"), F.col("class").alias("grp"), "n", "m", F.col("class").alias("leader"), "core")
    lists = stored(postings.join(kept, "h").select("h", "grp", "n", "m", "leader", "core").union(within), "lists")
    members = stored(sets.select("grp", "class").union(within.select("grp", F.col("leader").alias("class"))), "members")
    # Both must be able to hold the overlap that two sets of their sizes need: at most what others hold too.
    close = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(ma, mb) >= {percent} * (na + nb)"
    # A few groups of each list against all others of it. Groups whose shingles are the most widely held are nearest to
    # the common origin of near copies; each pivot is the best of a share of the groups.
    share = F.pmod(F.xxhash64("grp"), F.lit(STAR_PIVOTS))
    best = [F.max(F.when(share == k, F.struct("core", "leader", "n", "m"))) for k in range(STAR_PIVOTS)]
    pivots = lists.groupBy("h").agg(F.transform(F.array_compact(F.array(*best)), lambda p: F.struct(
        p["leader"].alias("a"), p["n"].alias("na"), p["m"].alias("ma"))).alias("p"))
    star = lists.join(pivots, "h").select("leader", F.col("n").alias("nb"), F.col("m").alias("mb"), F.explode("p").alias("p")).select(
        "leader", "nb", "mb", "p.*").where("leader <> a").where(close).select(F.least("a", "leader").alias("a"), F.greatest("a", "leader").alias("b"))
    links = stored(_verify(star.distinct(), sets, percent), "links")
    # What is left: pairs of groups that share a list and are not of one component, then pairs of their members.
    known, mixed, spread = _known(members, lists, links)
    open_ = stored(lists.join(mixed, "h").join(spread, "grp").select("h", "grp", "n", "m", "lo", "hi"), "open")
    counted = open_.groupBy("h").agg(F.count("*").alias("k"))
    long_ = _blocks(open_.join(counted.where(f"k > {LONG_LIST}"), "h").join(known, "grp").select("h", "class", "root"), sets, percent)
    open_ = open_.join(counted.where(f"k <= {LONG_LIST}").select("h"), "h")
    left, right = (open_.select("h", *(F.col(x).alias(x + k) for x in ("grp", "n", "m", "lo", "hi"))) for k in ("a", "b"))
    outer = left.join(right, "h").where("grpa < grpb and not (loa = hia and lob = hib and loa = lob)").where(close).select(F.col("grpa").alias("ga"), F.col("grpb").alias("gb"))
    group_pairs = outer.distinct()
    side = lambda k: known.select(F.col("grp").alias(f"g{k}"), F.col("class").alias(k), F.col("root").alias(f"r{k}"))
    pairs = group_pairs.join(side("a"), "ga").join(side("b"), "gb").where("ra <> rb").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return components(links.union(stored(_verify(pairs, sets, percent).union(long_), "links")))


def _blocks(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within long lists, from ``units(h, class, root)``: each pair of blocks of a list is one small group.

    A class travels once per block of its list, pairs are never rows, and a pair that is already connected is skipped.
    """
    units = units.distinct()
    size = units.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    own = units.join(size, "h").withColumn("own", F.pmod(F.xxhash64("class"), F.col("nb")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "root")

    def check(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(x).to_pylist() for x in ("n", "class", "root", "own", "shared")), strict=True), key=lambda r: r[:2])
        held = [np.frombuffer(r[4], np.uint64) for r in rows]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        overlap = _overlaps(held)
        one_block = len({r[3] for r in rows}) == 1
        a, b = [], []
        for y, (n, key, root, block, _) in enumerate(rows):
            for x in range(y - 1, -1, -1):
                m = rows[x][0]
                if 100 * m < percent * n:
                    break
                least = min(len(held[x]), len(held[y]))
                if (one_block or rows[x][3] != block) and (100 + percent) * least >= percent * (m + n) and top(rows[x][2]) != top(root):
                    both = overlap[x, y]
                    if 100 * both >= percent * (m + n - both):
                        a.append(rows[x][1])
                        b.append(key)
                        parent[top(rows[x][2])] = top(root)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    wide = dealt.join(sets.select("class", "n", "shared").hint("merge"), "class")
    return wide.groupBy("h", "i", "j").applyInArrow(check, "a long, b long")


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block's sets, as products of 0/1 tables of ``width`` values at a time."""
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        ones = np.zeros((len(sets), width), np.float32)
        ones[row[a:b], column[a:b] - start] = 1
        total += (ones @ ones.T).astype(np.int64)
    return total


def _known(members: DataFrame, lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with their component so far; lists of more than one component; least and greatest one of each group."""
    known = members.join(components(links).select(F.col("node").alias("class"), "root"), "class", "left").select(
        "grp", "class", F.coalesce("root", "class").alias("root"))
    spread = stored(known.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "spread")
    mixed = lists.join(spread, "grp").groupBy("h").agg(F.min("lo").alias("l"), F.max("hi").alias("m")).where("l <> m").select("h")
    return known, stored(mixed, "mixed"), spread


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, class``.

    Two rows link when their sets of ``size``-word shingles have ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest doc_id that links lead to. Sets are compared by 64-bit hashes of their shingles.
    A null or empty text, or one without words, has no shingles and is its own component. Rows with a null doc_id
    take part; their component is the smallest id that is not null, and null if there is none. Rows with a repeated
    id are separate rows. Other columns of ``docs`` are not looked at.
    """
    rows, roots = jaccard_classes(docs, percent, size)
    placed = rows.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("low"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "class")


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row left of each component: that with the smallest id (null ids last), of equal ids the one
    with the smallest class. Rows without shingles all stay; rows that agree in id and shingles are one."""
    rows, roots = jaccard_classes(docs, percent, size)
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    placed = rows.where("n > 0").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    best = placed.groupBy("root").agg(F.min(F.struct(order.alias("_o"), F.col("class").alias("_class"))).alias("x")).select("x.*")
    names = docs.columns
    plain = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_o"))
    schema = StructType([f for f in plain.schema.fields if f.name != "text"] + StructType.fromDDL("_class long, _n int").fields)

    def classed(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sets = [(class_of(x), len(x)) for x in shingle_sets(byte_texts(batch.column("text")), size)]
            keep = []
            for i, (key, (c, n)) in enumerate(zip(batch.column("_o").to_pylist(), sets, strict=True)):
                if n == 0 or (key, c) not in seen:
                    seen.add((key, c))
                    keep.append(i)
            columns = {x: batch.column(x) for x in batch.schema.names if x != "text"}
            columns |= {"_class": pa.array([c for c, _ in sets], pa.int64()), "_n": pa.array([n for _, n in sets], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns).take(pa.array(keep, pa.int64()))

    made = plain.mapInArrow(classed, schema)
    chosen = made.where("_n > 0").join(best, ["_o", "_class"], "left_semi").dropDuplicates(["_o", "_class"])
    return made.where("_n = 0").unionByName(chosen).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class")
