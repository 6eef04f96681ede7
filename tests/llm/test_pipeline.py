"""The whole pipeline against DuckDB and plain Python, stage by stage, on the test table with planted documents."""

import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from curascore.llm import decontaminate, line_dedup, mixing
from tests.llm.test_joins import brute_components

SF = "/root/testdata/sf0.01"  # languages are learned well enough to reject others
THAI = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์เช่นเดียวกับภาษาจีน และออกเสียงแยกคำต่อคำ "


def planted(docs: pa.Table, items: list[str]) -> list[tuple]:
    """Documents next to those of the table: (id, text, lang, source)."""
    rng = random.Random(11)
    plain = [r for r in docs.to_pylist() if r["text"] and r["lang"] and 60 < len(r["text"].split()) < 400 and r["doc_id"] % 7 == 1]
    shuffled = lambda r, n: " ".join(rng.choices(r["text"].replace("\n", " ").split(), k=n))
    rows = [(10**6 + i, THAI * 6, None, "web") for i in range(3)]  # unlabelled, so not learned
    base = plain[0]
    for i in range(4):  # near copies of each other, and one exact copy
        words = shuffled(base, 200).split() if i == 0 else rows[-i][1].split()
        rows.append((2 * 10**6 + i, " ".join(words[:i] + ["changed"] * (i > 1) + words[i + (i > 1):]), base["lang"], "news"))
    passage = shuffled(plain[1], 70)
    for i in range(3):  # a passage of 70 words as a line of otherwise different texts
        rows.append((3 * 10**6 + i, shuffled(plain[2 + i], 90) + "\n" + passage + "\n" + shuffled(plain[2 + i], 80), plain[2 + i]["lang"], "books"))
    window = max(items, key=len).split()
    rows.append((4 * 10**6, shuffled(plain[1], 60) + "\n" + " ".join(window), plain[1]["lang"], "web"))
    rows.append((4 * 10**6 + 1, shuffled(plain[1], 3000) + "\n" + " ".join(window[:14]), plain[1]["lang"], "web"))  # below the share
    return rows


def test_run_equals_brute_force(spark, tmp_path):
    docs, bench = pq.read_table(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/benchmark.parquet")
    items = [t for t in bench["text"].to_pylist() if t and len(t.split()) >= 20]
    extra = planted(docs, items)
    more = pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": len(t)} for i, t, lang, s in extra], docs.schema)
    folder = str(tmp_path)
    pq.write_table(pa.concat_tables([docs, more]), os.path.join(folder, "documents.parquet"))
    pq.write_table(bench, os.path.join(folder, "benchmark.parquet"))
    found = corpus_pipeline.run(spark, folder)

    # Stage 1 is learned; what it must do is planted. All others start from its rows.
    (_, language), *_ = corpus_pipeline.STAGES
    read = spark.read.parquet(f"{folder}/documents.parquet")
    now = language(spark, read, folder).toArrow()
    assert now.column_names == docs.column_names
    ids = set(now["doc_id"].to_pylist())
    assert not ids & {10**6, 10**6 + 1, 10**6 + 2} and {i for i, *_ in extra[3:]} <= ids
    assert len(ids) >= 0.97 * sum(any(c.isalpha() for c in t or "") for t in docs["text"].to_pylist())

    def sql(text: str, rows: list[dict]) -> list[dict]:
        con = duckdb.connect()
        con.register("documents", pa.Table.from_pylist(rows, docs.schema))
        con.register("benchmark", bench)
        return con.sql(text).to_arrow_table().to_pylist()

    rows = {r["doc_id"]: r for r in now.to_pylist()}
    for r in sql(line_dedup.SQL, list(rows.values())):
        own = rows[r["doc_id"]]
        if r["n_removed"]:
            own["text"], own["n_chars"] = r["text"], len(r["text"])
            if not r["text"].strip(" "):
                del rows[r["doc_id"]]
    assert "\n" in rows[3 * 10**6]["text"] and rows[3 * 10**6 + 1]["text"].count("\n") == 1  # the passage stays in the first only
    texts = [(i, r["text"]) for i, r in rows.items()]
    rows = {i: rows[i] for i, n, component in brute_components(texts) if n == 0 or component == i}
    assert 2 * 10**6 in rows and not {2 * 10**6 + 1, 2 * 10**6 + 2} & set(rows)
    bad = {r["doc_id"] for r in sql(decontaminate.SQL, list(rows.values())) if r["contaminated"]}
    assert 4 * 10**6 in bad and 4 * 10**6 + 1 not in bad
    rows = {i: r for i, r in rows.items() if i not in bad}
    mixed = {r["doc_id"]: r for r in sql(mixing.SQL, list(rows.values())) if r["taken"] > 0}
    want = {i: (rows[i]["text"], rows[i]["n_chars"], m["size"], m["taken"], m["taken"] // m["size"]) for i, m in mixed.items()}
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["mix_size"], r["mix_taken"], r["mix_repeats"]) for r in found.collect()}
    assert set(got) == set(want)
    assert got == want
