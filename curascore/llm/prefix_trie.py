"""Prefix tries of conversations as double arrays, one per shard of prefixes, merged where shards share nodes.

1. Conversations are rebuilt as sequences of turns; equal sequences become one path with its members counted.
2. Paths are dealt out by their first turn into shards of about equal numbers of turns. A first turn with more turns
   than a shard holds is dealt out over several shards, which then share the upper nodes of its paths.
3. A shard numbers its turns densely, in the order in which a breadth-first walk meets them, and packs its trie into two
   arrays: the child of node ``s`` by turn ``t`` is ``BASE[s] + t`` if ``CHECK`` there is ``s``. Walking all paths
   through the arrays gives the nodes with their members; sums over subtrees go up level by level.
4. Nodes that several shards may share are merged by the digest of their prefix, and each goes to one of its shards as
   the owner. Only owners add to the sums that go up, and these are added up over the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curascore.llm.base import query, stored, table
from curascore.operators.lookup import lookup_join

FAMILY, MOST_LED = 5, 9
SHARD_TURNS = 100_000
TRIES = 64  # places that are tried for a node's children before they go to the end
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(c, s, keys, bytes)`` per conversation: digest of its rebuilt sequence, its turns' digests and text bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    led = (F.crc32(F.col("c").cast("string")) % MOST_LED).cast("int")
    order = Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "key")
    placed = stored(turns.withColumn("pos", F.row_number().over(order) - 1).drop("turn"), "turns")
    every = placed.select("c").distinct()
    own = placed.where(F.col("pos") >= led).select("c", "pos", "key", "bytes")
    # At most eight turns of a conversation lead at most nine others.
    first = placed.where(F.col("pos") < MOST_LED - 1).withColumnRenamed("c", "head")
    lead = every.select("c", led.alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("head")).join(first, "head").where("pos < h").select("c", "pos", "key", "bytes")
    mark = every.select("c", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("bytes"))
    parts = own.union(lead).union(mark).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "bytes"))).alias("t"))
    kept = parts.select("c", F.filter("t", lambda x: x["pos"] >= 0).alias("t"))
    return kept.select("c", F.md5(F.array_join("t.key", "")).alias("s"), F.col("t.key").alias("keys"), F.col("t.bytes").alias("bytes"))


def member_digests(members: DataFrame) -> DataFrame:
    """``(s, sha)`` of ``members(s, c)``: SHA-256 of the ids, ascending and comma-joined.

    Ids are sorted and written out over all tasks, so that even one group's are; only the pieces of text, in their
    order, stream through the one task that hashes them, whose memory is a piece and the state.
    """

    def write(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, c = batch.column("s").to_pylist(), batch.column("c").to_pylist()
            edges = [0, *(i for i in range(1, len(s)) if s[i] != s[i - 1]), len(s)]
            cut = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_pydict({"s": pa.array([s[a] for a, _ in cut]), "first": pa.array([c[a] for a, _ in cut], pa.int64()),
                                              "ids": pa.array([",".join(map(str, c[a:b])) for a, b in cut])})

    def digest(batches) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names, made = [], []
            for s, ids in zip(batch.column("s").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s == now:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    names.append(now)
                    made.append(state.hexdigest())
                now, state = s, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"s": pa.array(names, pa.string()), "sha": pa.array(made, pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"s": pa.array([now]), "sha": pa.array([state.hexdigest()])})

    pieces = members.repartitionByRange("s", "c").sortWithinPartitions("s", "c").mapInArrow(write, "s string, first long, ids string")
    return pieces.repartition("s").sortWithinPartitions("s", "first").mapInArrow(digest, "s string, sha string")


class DoubleArray:
    """A trie in two arrays; nodes are places, the root is place 0. Labels are dense numbers from 0."""

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        #: All below ``low`` is taken, all from ``end`` on is free; ``hint`` is where several children found room last.
        self.low, self.end, self.hint = 1, 1, 1

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, count: int, start: int) -> np.ndarray:
        """The first ``count`` free places from ``start`` on."""
        size = 2 * count + 64
        while True:
            self._reserve(start + size)
            free = start + np.flatnonzero(self.check[start : start + size] < 0)
            if len(free) >= count:
                return free[:count]
            size *= 2

    def _take(self, places: np.ndarray, parents) -> None:
        self.check[places] = parents
        self.end = max(self.end, int(places.max()) + 1)
        while self.low < len(self.check):
            free = self.check[self.low : self.low + 4096] < 0
            if free.any():
                self.low += int(free.argmax())
                break
            self.low += len(free)

    def add(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Children of nodes that have none yet, as distinct pairs in the order of parents and labels."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        size = np.diff([*first, len(parents)])
        for at, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            own = labels[at : at + k]
            shape = own - own[0]
            self._reserve(self.end + int(shape[-1]) + 1)
            place = self.end
            for f in (*self._free(TRIES, self.low).tolist(), *self._free(TRIES, max(self.low, self.hint)).tolist()):
                if f + shape[-1] < len(self.check) and (self.check[f + shape] < 0).all():
                    place = f
                    break
            self.base[parents[at]] = place - own[0]
            self.hint = place
            self._take(place + shape, parents[at])
        alone = first[size == 1]
        if len(alone):
            places = self._free(len(alone), self.low)
            self.base[parents[alone]] = places - labels[alone]
            self._take(places, parents[alone])

    def step(self, nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each node by its label, -1 where there is none."""
        to = self.base[nodes] + labels
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == nodes), to, -1)


def build(labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[DoubleArray, np.ndarray, np.ndarray]:
    """The trie of the sequences ``labels[starts[i]:][:sizes[i]]``, labels numbered anew, and each old label's number."""
    trie, number = DoubleArray(), np.full(int(labels.max(initial=-1)) + 1, -1, np.int64)
    known, rows, node, depth = 0, np.flatnonzero(sizes > 0), np.zeros(len(sizes), np.int64), 0
    while len(rows):
        here = labels[starts[rows] + depth]
        by_parent = np.lexsort((here, node[rows]))
        fresh = here[by_parent][number[here[by_parent]] < 0]
        _, at = np.unique(fresh, return_index=True)
        fresh = fresh[np.sort(at)]  # siblings that are met together get neighbouring numbers
        number[fresh] = np.arange(known, known + len(fresh))
        known += len(fresh)
        trie.add(*np.divmod(np.unique(node[rows] * known + number[here]), known))
        node[rows] = trie.step(node[rows], number[here])
        depth += 1
        rows = rows[sizes[rows] > depth]
    return trie, number[labels], number


class Nodes:
    """The nodes that paths lead to in a double array, upper levels first, with their members."""

    def __init__(self, trie: DoubleArray, labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray, members: np.ndarray, least: np.ndarray):
        size = len(trie.check)
        count, low, at = np.zeros(size, np.int64), np.full(size, 2**63 - 1, np.int64), np.full(size, -1, np.int64)
        place, parent, label, self.levels = [], [], [], [0]
        node, rows, depth = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes > 0), 0
        self.last = np.full(len(sizes), -1, np.int64)  # the node at which each path ends
        while len(rows):
            before, by = node[rows], labels[starts[rows] + depth]
            to = trie.step(before, by)
            if (to < 0).any():
                raise AssertionError("a path is not in its trie")
            node[rows] = to
            np.add.at(count, to, members[rows])
            np.minimum.at(low, to, least[rows])
            new, first = np.unique(to, return_index=True)
            at[new] = np.arange(self.levels[-1], self.levels[-1] + len(new))
            place.append(new)
            parent.append(at[before[first]] if depth else np.full(len(new), -1, np.int64))
            label.append(by[first])
            self.levels.append(self.levels[-1] + len(new))
            depth += 1
            done = sizes[rows] == depth
            self.last[rows[done]] = at[to[done]]
            rows = rows[~done]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        place, self.parent, self.label = join(place), join(parent), join(label)
        self.count, self.low = count[place], low[place]
        self.depth = np.repeat(np.arange(1, len(self.levels)), np.diff(self.levels))


def add_up(value: np.ndarray, parent: np.ndarray, levels: list[int]) -> np.ndarray:
    """Sums over subtrees, tops included; ``levels`` are the bounds of the levels, upper ones first."""
    total = value.copy()
    for a, b in reversed(list(zip(levels[1:-1], levels[2:], strict=True))):
        np.add.at(total, parent[a:b], total[a:b])
    return total


_BUILT = "kind int, shard long, idx long, parent long, node binary, bytes long, kids boolean, " + NODE
_BUILT_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("idx", pa.int64()), ("parent", pa.int64()), ("node", pa.binary()), ("bytes", pa.int64()), ("kids", pa.bool_()),
                          *((f.split()[0], pa.string() if "string" in f else pa.int64()) for f in NODE.split(", "))])
_FINAL, _SHARED = 0, 1


def _shard(root_low: int):
    def run(group: pa.Table) -> pa.Table:
        keys, sizes = group.column("keys").combine_chunks(), group.column("bytes").combine_chunks()
        lengths = np.diff(keys.offsets.to_numpy()).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        coded = keys.flatten().dictionary_encode()
        old = coded.indices.to_numpy().astype(np.int64)
        texts = coded.dictionary.to_pylist()
        turn_bytes = np.zeros(len(texts), np.int64)
        turn_bytes[old] = sizes.flatten().to_numpy()
        trie, labels, number = build(old, starts, lengths)
        was = np.empty(len(number), np.int64)
        was[number] = np.arange(len(number))
        members, least = group.column("n").to_numpy(), group.column("low").to_numpy()
        nodes = Nodes(trie, labels, starts, lengths, members, least)
        m = len(nodes.count)
        own_bytes = turn_bytes[was[nodes.label]] if m else np.zeros(0, np.int64)
        children = np.bincount(nodes.parent[nodes.parent >= 0], minlength=m)
        sha = np.full(m, None, object)
        ends = nodes.last >= 0
        sha[nodes.last[ends]] = np.array(group.column("sha").to_pylist(), object)[ends]
        # Which nodes lie below a first turn that other shards hold too, and the digests of their prefixes.
        shared = np.zeros(m, bool)
        top = np.arange(m)
        for a, b in zip(nodes.levels[1:-1], nodes.levels[2:], strict=True):
            top[a:b] = top[nodes.parent[a:b]]
        hot = np.array(group.column("salts").to_pylist(), object)
        wide = np.array([x is not None and x > 1 for x in hot], bool)
        shared[np.isin(top, top[nodes.last[ends & wide]])] = m > 0
        digest = np.full(m, None, object)
        for i in np.flatnonzero(shared).tolist():
            above = digest[nodes.parent[i]] if nodes.parent[i] >= 0 else b""
            digest[i] = hashlib.blake2b(above + texts[was[nodes.label[i]]].encode(), digest_size=16).digest()
        saved = add_up((nodes.count - 1) * own_bytes, nodes.parent, nodes.levels)
        leaves = add_up((children == 0).astype(np.int64), nodes.parent, nodes.levels)
        parent_low = np.where(nodes.parent >= 0, nodes.low[nodes.parent], root_low) if m else np.zeros(0, np.int64)
        plain = [np.where(shared, _SHARED, _FINAL), np.full(m, group.column("shard")[0].as_py()), np.arange(m), nodes.parent]
        found = [nodes.low, nodes.depth, parent_low, nodes.count, children, leaves, saved]
        return pa.Table.from_arrays(
            [*(pa.array(x, t) for x, t in zip(plain, _BUILT_ARROW.types, strict=False)), pa.array(digest, pa.binary()), pa.array(own_bytes, pa.int64()),
             pa.array(children > 0), *(pa.array(x, pa.int64()) for x in found), pa.array(sha, pa.string())], schema=_BUILT_ARROW)

    return run


_LIFTED = "node binary, " + NODE
_LIFTED_ARROW = pa.schema([("node", pa.binary()), *list(_BUILT_ARROW)[7:]])


def _lift(root_low: int):
    def run(group: pa.Table) -> pa.Table:
        """What this shard adds to its shared nodes: sums over those it owns."""
        group = group.sort_by([("depth", "ascending"), ("idx", "ascending")])
        g = lambda c: group.column(c).to_numpy()
        idx, owned, depth, low = g("idx"), g("owner") == g("shard"), g("depth"), g("all_low")
        at = np.full(int(idx.max()) + 1, -1, np.int64)
        at[idx] = np.arange(len(idx))
        parent = np.where(g("parent") >= 0, at[g("parent")], -1)
        levels = [0, *(np.flatnonzero(np.diff(depth)) + 1).tolist(), len(depth)]
        below = parent >= 0
        children = np.bincount(parent[below], weights=owned[below], minlength=len(idx)).astype(np.int64)
        leaves = add_up((owned & ~g("any_kids").astype(bool)).astype(np.int64), parent, levels)
        saved = add_up(np.where(owned, (g("all_n") - 1) * g("bytes"), 0), parent, levels)
        found = [low, depth, np.where(below, low[parent], root_low), g("all_n"), children, leaves, saved]
        return pa.Table.from_arrays([group.column("node"), *(pa.array(x, pa.int64()) for x in found), group.column("all_sha")], schema=_LIFTED_ARROW)

    return run


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node of the trie of rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; ``conversations`` has ``conv_id, turn, role, text``.

    Rows with a null conv_id belong to no conversation and are left out. Turns go by ``turn``, null first; equal ones go
    by the digest of role and text, so repeated rows are turns that repeat. Null roles and texts are empty, and an empty
    turn is a turn. A conversation without rebuilt turns ends at the root. No conversations give no rows, not even a
    root. Turns are told apart by 128-bit digests. Other columns are not looked at.
    """
    sequences = stored(rebuilt(conversations), "sequences")
    distinct = sequences.groupBy("s").agg(F.min("c").alias("low"), F.count("*").alias("n"))
    sha = stored(member_digests(sequences.select("s", "c")), "ends")
    paths = stored(
        sequences.withColumnRenamed("c", "low").join(distinct, ["s", "low"]).join(sha, "s").withColumn("first", F.get("keys", F.lit(0))), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum(F.size("keys")).alias("turns"), F.max(F.when(F.col("first").isNull(), F.col("sha"))).alias("sha")).first()
    if whole["n"] is None:
        return conversations.sparkSession.createDataFrame([], NODE)
    shards = max(1, -(-whole["turns"] // shard_turns))
    held = paths.where("first is not null").groupBy("first").agg(F.sum(F.size("keys")).alias("turns"))
    wide = held.where(F.col("turns") > shard_turns).select("first", F.ceil(F.col("turns") / shard_turns).cast("long").alias("salts"))
    dealt = lookup_join(paths.where("first is not null"), wide, "first", "left")
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("s"), F.col("salts"))).otherwise(F.lit(0).cast("long"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("first", salt), F.lit(shards)).cast("long"))
    built = stored(dealt.select("shard", "keys", "bytes", "n", "low", "sha", "salts").groupBy("shard").applyInArrow(_shard(whole["low"]), _BUILT), "nodes", "kind")
    shared = built.where(F.col("kind") == _SHARED)
    merged = shared.groupBy("node").agg(
        F.min("shard").alias("owner"), F.min("conv_id").alias("all_low"), F.sum("n_convs").alias("all_n"),
        F.max("kids").alias("any_kids"), F.max("ends_sha256").alias("all_sha"))
    back = shared.select("shard", "idx", "parent", "node", "bytes", "depth").join(merged, "node")
    lifted = back.groupBy("shard").applyInArrow(_lift(whole["low"]), _LIFTED)
    one = lambda *names: [F.min(x).alias(x) for x in names]
    total = lambda *names: [F.sum(x).alias(x) for x in names]
    joined = lifted.groupBy("node").agg(
        *one("conv_id", "depth", "parent_conv_id", "n_convs"), *total("n_children", "n_leaves", "saved_tokens"), *one("ends_sha256"))
    names = [f.split()[0] for f in NODE.split(", ")]
    lower = stored(built.where(F.col("kind") == _FINAL).select(*names).union(joined.select(*names)), "lower")
    return _root(lower, whole["n"], whole["low"], whole["sha"]).unionByName(lower).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))


def _root(lower: DataFrame, n: int, low: int, sha: str | None) -> DataFrame:
    """The one row of the root, from the nodes below it; ``sha`` is that of the conversations without turns."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    below = lower.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return below.select(
        F.lit(low).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.lit(sha).cast("string").alias("ends_sha256"))


SQL = rf"""
with crc as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
t0 as (select conv_id as c, turn, strlen(coalesce(text, ''))::bigint as bytes, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key
  from conversations where conv_id is not null),
t as (select c, key, bytes, row_number() over (partition by c order by turn nulls first, key) - 1 as pos from t0),
v0 as (select distinct c, c::varchar as w from t),
v as (select c, c - c % {FAMILY} as head, xor(list_reduce([4294967295] || list_transform(range(1, len(w) + 1), lambda i: ascii(substr(w, i, 1))::bigint),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {MOST_LED} as h from v0, crc),
r as (select v.c, pos, key, bytes from t join v using (c) where pos >= h union all select v.c, pos, key, bytes from t join v on t.c = v.head where pos < h),
q as (select c, bytes, row_number() over o as d, md5(string_agg(key, '') over o) as p from r window o as (partition by c order by pos)),
a as (select c, d, p, bytes, coalesce(lag(p) over (partition by c order by d), '') as pp from q union all select c, 0, '', 0, null from v),
n as (select p, any_value(pp) as pp, d, min(c) as low, count(*) as n, any_value(bytes) as bytes from a group by p, d),
k as (select pp as p, count(*) as kids from n where pp is not null group by pp),
m as (select n.*, coalesce(kids, 0) as kids from n left join k using (p)),
u as (select a.p, sum((m.n - 1) * m.bytes)::bigint as saved, count(*) filter (m.kids = 0) as leaves from m join a on a.c = m.low and a.d <= m.d group by a.p),
e as (select p, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select c, arg_max(p, d) as p from a group by c) group by p)
select m.low as conv_id, m.d::bigint as depth, f.low as parent_conv_id, m.n as n_convs, m.kids as n_children, u.leaves as n_leaves, u.saved as saved_tokens,
  coalesce(e.sha, sha256('')) as ends_sha256
from m join u using (p) left join e using (p) left join n f on f.p = m.pp"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_nodes(table(spark, sf_dir, "conversations"))
