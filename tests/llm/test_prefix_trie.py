"""The prefix trie against plain dictionaries, and double arrays by round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from curascore.llm.prefix_trie import DoubleArray, Nodes, add_up, build, prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, first int, s string"


def brute(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in of.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = turns.get(head, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        cost = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not children[node]
    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if len(paths[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], sha))
    return sorted(out, key=str)


def chats(seed, n, vocabulary=6, longest=12):
    rng, rows = random.Random(seed), []
    for c in range(n):
        c = c - n // 8 if rng.random() < 0.9 else c + 1000
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"t{min(rng.randrange(vocabulary), rng.randrange(vocabulary))} é" * (turn + 1)))
    return rows


def nodes_of(spark, rows, **kw):
    got = prefix_nodes(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), **kw)
    return got.columns, sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [100_000, 40, 3])
def test_equals_dictionaries(spark, shard_turns):
    rows = chats(shard_turns, 160)
    # One first turn, and one whole conversation, hold a third of all rows each.
    rows += [(5000 + 5 * i, k, "user", f"same {k}") for i in range(40) for k in range(6)]
    rows += [(7000 + 5 * i, k, "user", "same 0" if k == 0 else f"own {i}") for i in range(40) for k in range(9)]
    columns, got = nodes_of(spark, rows, shard_turns=shard_turns)
    assert columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, None, "x"), (2, 3, "user", None),
            (3, 0, "ab", "c"), (4, 0, "a", "bc"), (6, 0, "user", "é" * 70_000), (9, 1, "user", "only"), (12, 0, "u", "tie a"), (12, 0, "u", "tie b"), (-7, 0, "u", "minus"), (-5, 0, "u", "minus")]
    assert nodes_of(spark, rows)[1] == brute(rows)
    assert nodes_of(spark, rows, shard_turns=1)[1] == brute(rows)
    assert nodes_of(spark, [])[1] == [] and nodes_of(spark, rows[:1])[1] == []
    # Conversations whose turns all come from a missing head end at the root.
    short = [(c, 0, "u", "t") for c in range(1, 40) if c % 5]
    assert nodes_of(spark, short)[1] == brute(short)
    long_one = [(10, k, "u", f"turn {k % 7}") for k in range(300)] + [(15, k, "u", f"turn {k % 7}") for k in range(250)]
    assert nodes_of(spark, long_one)[1] == brute(long_one)


@pytest.mark.parametrize("seed", range(6))
def test_double_array_round_trip(seed):
    rng = random.Random(seed)
    paths = [[rng.randrange(rng.choice([3, 40, 400])) for _ in range(rng.randrange(0, 9))] for _ in range(600)]
    flat = np.array([x for p in paths for x in p], np.int64)
    _, flat = np.unique(flat, return_inverse=True)
    sizes = np.array([len(p) for p in paths])
    starts = np.cumsum(sizes) - sizes
    trie, labels, number = build(flat, starts, sizes)
    assert sorted(number.tolist()) == list(range(len(number)))
    want = {tuple(labels[a : a + d].tolist()) for a, n in zip(starts, sizes, strict=True) for d in range(1, n + 1)}
    # Every node has one place, its parent in CHECK and its label from BASE; no other place is taken.
    taken = np.flatnonzero(trie.check >= 0)[1:]
    def path(s):
        return () if s == 0 else (*path(int(trie.check[s])), int(s - trie.base[trie.check[s]]))
    assert sorted(path(int(s)) for s in taken) == sorted(want)
    assert len(trie.check) < 40 * len(want) + 4096
    nodes = Nodes(trie, labels, starts, sizes, np.ones(len(paths), np.int64), np.arange(len(paths)))
    assert len(nodes.count) == len(want) and nodes.count[nodes.depth == 1].sum() == (sizes > 0).sum()
    assert add_up(np.ones(len(want)), nodes.parent, nodes.levels)[: nodes.levels[1]].sum() == len(want)
    assert (trie.step(np.zeros(2, np.int64), np.array([10**9, len(number)])) == -1).all()


def test_double_array_wide_nodes_stay_compact():
    trie = DoubleArray()
    trie.add(np.zeros(5000, np.int64), np.arange(5000))
    nodes = trie.step(np.zeros(5000, np.int64), np.arange(5000))
    pairs = np.array([(n, x) for n in nodes.tolist() for x in (n % 7, 4000 + n % 11)])
    trie.add(pairs[:, 0], pairs[:, 1])
    assert (trie.step(pairs[:, 0], pairs[:, 1]) > 0).all() and trie.end < 100_000
