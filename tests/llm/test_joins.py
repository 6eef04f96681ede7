"""Jaccard join, line dedup, decontamination and neighbours against brute force on small tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from check import compare, duck
from curascore.llm import decontaminate, jaccard_join
from curascore.llm.ann import nearest_neighbours
from curascore.llm.base import stored
from curascore.llm.components import components
from curascore.llm.decontaminate import contamination
from curascore.llm.jaccard_join import jaccard_components, one_of_each
from curascore.llm.line_dedup import dedup_lines
from curascore.llm.queries import REGISTRY
from tests.conftest import SF
from tests.llm.conftest import ODD


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        if name is not None:
            ids[top(i)].append(name)
    return sorted(((n, len(sets[i]), (min(ids[top(i)]) if ids[top(i)] else None) if sets[i] else n) for i, (n, _) in enumerate(rows)), key=str)


def near_copies(seed, families=6, each=40, size=120):
    rng, rows = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(70))
    for f in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                text[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1000, " ".join(text) + (" " + passage if rng.random() < 0.3 else "")))
    for _ in range(40):
        rows.append((2000 + len(rows), passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 90])))))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_equals_brute_force(spark, make, monkeypatch, small):
    if small:  # many flushes, frequent shingles and blocks
        for name, value in (("FLUSH", 2_000), ("FREQUENT", 3), ("LONG_LIST", 3), ("BLOCK", 5), ("PART_BYTES", 20_000), ("STAR_PIVOTS", 1)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(1) + [r[:2] for r in ODD]
    got = jaccard_components(make([(*r, "en", "a") for r in rows])).drop("class").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_jaccard_one_of_each(make):
    rows = [(*r, "en", "a") for r in near_copies(2, 3, 20)] + ODD
    docs = make(rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = [r for r in kept.collect() if shingles(r["text"])]
    expect = {c for _, n, c in brute_components([r[:2] for r in rows]) if n}
    # Two texts of id 4 are groups of their own; its repeated row is one of them.
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([*expect, 4], key=str)
    assert kept.where("text is null").count() == 2


def test_jaccard_empty(make):
    assert jaccard_components(make([])).count() == 0


def test_jaccard_without_shared_shingles(make):
    """Ranges of hashes in which no shingle is shared send nothing on."""
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(n)), "en", "a") for i, n in enumerate([1, 3, 5, 40, 700])]
    got = jaccard_components(make(rows)).drop("class").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 36, 3), (4, 696, 4)]


@pytest.mark.parametrize("percent", [20, 50, 100])
def test_jaccard_other_shares(make, percent):
    """From all hashes in the first round (20 %) to none (100 %)."""
    rows = [*near_copies(4, 3, 12, 40), (5000, "one"), (5001, "ONE"), (5002, "one two three"), (5003, "")]
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    least = {r: min(n for (n, _), x in zip(rows, root, strict=True) if x == r) for r in root}
    got = jaccard_components(make([(*r, "en", "a") for r in rows]), percent).drop("class").collect()
    assert sorted(map(tuple, got)) == sorted((n, len(sets[i]), least[root[i]]) for i, (n, _) in enumerate(rows))


def test_jaccard_second_round_is_for_what_may_link(make, monkeypatch):
    """Texts whose shingles are mostly their own send a third of them; those that may be linked send the rest as well."""
    kept = {}
    monkeypatch.setattr(jaccard_join, "stored", lambda df, tag, *by: kept.setdefault(tag, stored(df, tag, *by)))
    alone = [(i, " ".join(f"w{i}_{k}" for k in range(300)) + " a passage that all of these texts hold at their end", "en", "a") for i in range(40)]
    copies = [(100 + i, " ".join(f"c{k}" for k in range(300)) + f" e{i}", "en", "a") for i in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(make(alone + copies)).collect()}
    assert got == {**{i: i for i in range(40)}, **dict.fromkeys(range(100, 105), 100)}
    rest = sum(r["rest"] for r in kept["left"].collect())
    assert 5 * 297 / 2 < rest < 5 * 297


def test_jaccard_entries_keep_their_size():
    """An entry's hash takes no more room in more ranges: within a range, hashes lie as close as among all."""
    shingles_of = np.unique(np.random.default_rng(1).integers(0, 2**64, 60_000, np.uint64))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [" ".join(map(str, shingles_of))], "t": pa.array([7], pa.int64())})

    def room(ranges):
        found = [e for b in jaccard_join._deal([batch], 4, ranges, 5, 0, jaccard_join.HASHES) for e in b.column("e").to_pylist() if e]
        assert len(found) == ranges and len(jaccard_join.unpack_entries(found)[0]) == 59_996
        return sum(len(e) for e in found)

    assert room(16) < 1.05 * room(1)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200), (None, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def brute_contamination(docs, items, size=13):
    take = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = defaultdict(set)
    for name, text in items:
        w = take(text)
        n = min(size, len(w))
        if name is not None and n:
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(name))
    lengths, out = {len(w) for w in windows}, []
    for name, text in docs:
        w, hit, found = take(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((name, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8_000_000, 200])
def test_contamination_equals_brute_force(spark, make, block):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["ab", "Cd", "ö", "x1", "of"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(3, 30)] + [(3, some(20)), (None, "lost one"), (90, None), (91, " -- ")]
    docs = [(i, some(rng.choice([0, 3, 30, 700])) + rng.choice(["", " ", ", ".join(t for _, t in rng.sample(items[:20], 2))])) for i in range(60)] + [r[:2] for r in ODD]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, hits string")
    got = contamination(make([(*r, "en", "a") for r in docs]), bench, block_bytes=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contamination(docs, items)
    # Passes are written one by one, however many blocks there are.
    plan = contamination(make([(1, "ab", "en", "a")]), bench, block_bytes=block)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert contamination(make([]), bench).count() == 0
    clean = contamination(make(ODD), bench.limit(0)).where("n_hit > 0 or contaminated or n_words is null")
    assert clean.count() == 0


def test_wu_manber_skips():
    """With long windows the shift table lets most positions go unread."""
    tables = decontaminate.tables([("a", b" ".join(b"w%d" % i for i in range(60)))])
    assert [t.length for t in tables] == [13]
    assert (tables[0].shift == 12).mean() > 0.7




def test_line_dedup_passages(make):
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = ["\n".join([line(20), line(18), line(15)]), line(55), "\n".join(line(1) for _ in range(60)), "\n".join([line(30), "", line(30)])]
    short = line(30)
    rows, planted = [], []
    for i in range(60):
        parts = [line(rng.choice([5, 30, 60])) for _ in range(4)]
        if i % 2:
            p = passages[i // 2 % len(passages)]
            planted.append((i, p))
            parts.insert(rng.randrange(4), p)
        if i % 10 == 0:
            parts.insert(2, short)
        rows.append((i, "\n".join(parts), "en", "a"))
    got = {r["doc_id"]: r for r in dedup_lines(make(rows)).collect()}
    first = set()
    for i, p in planted:
        if p in first:
            assert all(x not in got[i]["text"].split("\n") for x in p.split("\n") if x), i
        else:
            assert p in got[i]["text"]
            first.add(p)
    for i, text, _, _ in rows:  # nothing else goes, short repeats stay
        lost = [x for x in text.split("\n") if x not in got[i]["text"].split("\n")]
        assert sum(len(x.split()) for x in lost) in (0, *(len(p.split()) for p in passages))
        assert i % 10 or short in got[i]["text"]
        assert got[i]["n_lines"] == len(text.split("\n")) and got[i]["n_chars"] == len(text)


def test_line_dedup_past_long_lines(make):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    runs = [[line(120), line(20)], [line(30), line(70), line(15), line(15)], [line(12), line(200), line(1), line(25), line(9)], [line(39), line(400), "", line(30)]]
    rows = []
    for i, run in enumerate(runs):
        rows += [(2 * i, "\n".join([line(25), *run, line(25)]), "en", "a"), (2 * i + 1, "\n".join([line(25), *run, line(25)]), "en", "a")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make(rows)).collect()}
    for i, run in enumerate(runs):
        text = rows[2 * i + 1][1].split("\n")
        assert got[2 * i] == rows[2 * i][1]
        assert got[2 * i + 1] == "\n".join([text[0], text[-1]]), len(run)


def test_line_dedup_odd_rows(make):
    rows = ODD + [(8, "\n".join(["again and again"] * 100), "en", "a"), (9, "a\n" * 5, "en", "a")]
    docs = make(rows)
    got = dedup_lines(docs)
    assert got.count() == len(rows) and got.columns == [*docs.columns, "n_lines", "n_removed"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0 and by[2]["text"] == "" and by[2]["n_lines"] == 1
    assert 14 <= by[8]["text"].count("again and again") < 100
    assert dedup_lines(make([])).count() == 0
    # The first of equal texts stays whole, the others are emptied; every lost line is still somewhere before.
    text = "\n".join(f"line {i} of a text with enough words in it" for i in range(20))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make([(i, text, "en", "a") for i in (7, 3, 5)])).collect()}
    assert got == {3: text, 5: "", 7: ""}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([rng.normal(size=(1500, 32)), centres[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 32))])
    x[1000:1300] = x[1000]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [None] + [1.0] * 31), (9005, [float("nan")] * 32), (9006, [float("inf")] * 32), (9007, [1.0] * 5), (None, [1.0] * 32)]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(*r, "clash") for r in odd]
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        s = (x * x[q]).sum(1)
        assert [v for _, v in found] == pytest.approx([s[i] for i, _ in found], abs=1e-12)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / 20 / len(by) >= 0.9
    assert [i for i, _ in by[1000]] == list(range(1001, 1021))
    few = spark.createDataFrame(rows[:3], vectors.schema)
    assert [tuple(r)[:3] for r in nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()][0][:2] == (0, 1)
    assert nearest_neighbours(few.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(k for k, q in REGISTRY.items() if q.sql))
def test_query_equals_sql(spark, name, sf):
    assert compare(REGISTRY[name].run(spark, sf).toArrow(), duck(sf).sql(REGISTRY[name].sql).to_arrow_table()) == []
