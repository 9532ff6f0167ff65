"""Search, the stored index, numbering, DOCX parts, reports and rebuilt texts against plain Python."""

import json
import random
import re

import numpy as np
import pytest

from clausediff.operators import diffing, index, numbering, reporting, vectors
from clausediff.sources import docx


# ---------------------------------------------------------------- search


def nearest(rows, queries, k):
    out = set()
    for q, v in queries:
        if v is not None:
            d = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(v, x)), c) for c, x in rows if x is not None and len(x) == len(v))[:k]
            out |= {(q, n, c, round(s, 9)) for n, (s, c) in enumerate(d, 1)}
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_in_blocks(spark, monkeypatch, broadcast):
    """Many query and index blocks; equal vectors, other lengths and nulls; both ways of joining."""
    rng = np.random.default_rng(1)
    rows = [(f"c{i:03}", np.round(rng.normal(size=5), 1).astype(np.float32).tolist()) for i in range(230)]
    rows += [(f"same{i:03}", rows[0][1]) for i in range(120)] + [("none", None), ("short", [1.0]), ("empty", [])]
    queries = [(i, rows[i * 7][1]) for i in range(30)] + [(100, None), (101, [0.5]), (102, rows[0][1])]
    monkeypatch.setattr(vectors, "INDEX_BLOCK", 16)
    monkeypatch.setattr(vectors, "HELD", 8)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 1 << 20 if broadcast else 0)
    ix = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    found = vectors.semantic_search(ix, q, 7, block=4)
    got = {(r.query_id, r.rank, r.chunk_id, round(r.distance, 9)) for r in found.collect()}
    assert got == nearest(rows, queries, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert vectors.semantic_search(ix.limit(0), q, 3).count() == 0 and vectors.semantic_search(ix, q.limit(0), 3).count() == 0
    one = vectors.semantic_search(ix, q, 1, {"chunk_id": "c003"}, block=1000).collect()
    assert {r.chunk_id for r in one} == {"c003"}


def test_search_scans_the_index_once(spark):
    ix = spark.range(500).selectExpr("cast(id as string) as chunk_id", "array(cast(id as float), 1f) as embedding")
    q = spark.range(3000).selectExpr("id as query_id", "array(cast(id as float), 1f) as embedding")
    found = vectors.semantic_search(ix, q, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Range \(0, 500", plan)) == 1
    assert found.where("distance = 0").count() == 500


# ---------------------------------------------------------------- stored index

ROWS = "chunk_id string, doc_id string, version string, article_number string, text string, at int"


def chunk(doc, version, no, text, at=0):
    return f"{doc}_{version}_{no:04}", doc, version, str(no), text, at


def files_of(path):
    return {p.name: p.stat().st_mtime_ns for p in path.rglob("part-*.parquet")}


def test_merge_rewrites_touched_parts_only(spark, tmp_path):
    path = tmp_path / "index"
    old = [chunk(f"d{d}", v, n, "old") for d in range(40) for v in ("v1", "v2") for n in range(5)]
    index.save_index(spark.createDataFrame(old, ROWS), str(path), parts=8)
    before = files_of(path)
    new = [chunk("d1", "v1", 0, "late", 2), chunk("d1", "v1", 0, "early", 1), chunk("d1", "v1", 9, "more"), chunk("d2", "v2", 1, "two")]
    table = spark.createDataFrame(new, ROWS)
    from pyspark.sql import functions as F

    assert index.merge_index(table, str(path), order=F.col("at")) == 3
    got = {r.chunk_id: r.text for r in index.load_index(spark, str(path)).collect()}
    assert got == {r[0]: r[4] for r in old} | {"d1_v1_0000": "late", "d1_v1_0009": "more", "d2_v2_0001": "two"}
    touched = {r.part for r in index.load_index(spark, str(path)).where("doc_id in ('d1', 'd2')").select("part").distinct().collect()}
    part = {p.name: int(p.parent.name.split("=")[1]) for p in path.rglob("part-*.parquet")}
    assert {f for f in before if f in part} == {f for f in part if part[f] not in touched}
    assert index.merge_index(table, str(path), order=F.col("at")) == 3  # again: nothing changes
    assert {r.chunk_id: r.text for r in index.load_index(spark, str(path)).collect()} == got
    shorter = spark.createDataFrame([chunk("d3", "v1", 0, "only")], ROWS)
    index.merge_index(shorter, str(path), replace_docs=True)
    d3 = index.load_index(spark, str(path)).where("doc_id = 'd3'").collect()
    assert sorted((r.version, r.text) for r in d3) == [("v1", "only")] + [("v2", "old")] * 5
    assert index.merge_index(table.limit(0), str(path)) == 0
    assert index.load_index(spark, str(path)).count() == len(old) + 1 - 4


def test_last_of_a_batch_wins(spark):
    new = spark.createDataFrame([chunk("d", "v1", 1, t) for t in "abc"], ROWS).coalesce(1)
    assert [r.text for r in index.index_upsert(new.limit(0), new).collect()] == ["c"]


def scanned(df):
    """Rows that a query's scan gave, after row groups were left out by their statistics."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookups_prune(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [chunk(f"d{d:04}", "v1", n, f"text {d} {n} " + "x" * 200) for d in range(300) for n in range(20)]
    index.save_index(spark.createDataFrame(rows, ROWS), path, parts=4, group_bytes=16 << 10)
    ix = index.load_index(spark, path)
    one = index.lookup_article(ix, "7")
    assert one.count() == 300 and scanned(index.lookup_article(ix, "7")) < len(rows) / 2
    in_doc = index.lookup_article(ix, "7", "d0123")
    assert [r.chunk_id for r in in_doc.collect()] == ["d0123_v1_0007"]
    assert scanned(index.lookup_article(ix, "7", "d0123")) < len(rows) / 8
    plan = in_doc._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part#", plan) and "EqualTo(article_number,7)" in plan


# ---------------------------------------------------------------- numbering


def test_style_chains_double(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(numbering, "stored", lambda df, name, s=numbering.stored: rounds.append(1) or s(df, name))
    chain = [("d", "v1", f"s{i}", None, f"s{i + 1}", None, None) for i in range(64)] + [("d", "v1", "s64", None, None, 9, None)]
    cycle = [("e", "v1", "a", None, "b", None, None), ("e", "v1", "b", None, "c", None, None), ("e", "v1", "c", None, "a", None, None), ("e", "v1", "self", None, "self", None, None), ("e", "v1", "lost", None, "gone", None, None)]
    mixed = [("f", "v1", "x", None, "y", None, 4), ("f", "v1", "y", None, "x", 5, 2), ("f", "v1", "z", None, "x", None, None)]
    styles = spark.createDataFrame(chain + cycle + mixed, "doc_id string, version string, style_id string, style_name string, based_on string, num_id int, ilvl int")
    got = {(r.doc_id, r.style_id): (r.num_id, r.ilvl) for r in numbering.resolve_styles(styles).collect()}
    assert got == {("d", f"s{i}"): (9, 0) for i in range(65)} | {("f", s): (5, 2) for s in "xyz"}
    assert len(rounds) == 8  # the first table, and a round for each doubling up to 65
    assert numbering.resolve_styles(styles.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 65_536])
def test_counters_in_blocks(spark, monkeypatch, block):
    rng = random.Random(4)
    monkeypatch.setattr(numbering, "BLOCK", block)
    rows, want = [], {}
    for doc in range(12):
        counts = {}
        for i in range(rng.randrange(1, 40)):
            num, level = rng.choice([None, 1, 2]), rng.choice([0, 0, 1, 2, 3, 8, None])
            rows.append((str(doc), "v1", i, "t", num, level))
            if num is not None and level is not None:
                c = counts.setdefault(num, {})
                c[level] = c.get(level, 0) + 1
                for deeper in [x for x in c if x > level]:
                    del c[deeper]
                want[str(doc), i] = [str(c[x]) for x in sorted(c)]
    p = spark.createDataFrame(rows, "doc_id string, version string, idx int, text string, num_id int, ilvl int")
    levels = spark.createDataFrame([], "doc_id string, version string, num_id int, level int, start int, num_fmt string, lvl_text string")
    labelled = numbering.numbering_labels(p, levels)
    assert {(r.doc_id, r.idx): r.numbering_path for r in labelled.collect() if r.numbering_label is not None} == want
    if block > 3:
        assert labelled._jdf.queryExecution().sparkPlan().toString().count("Window") == 2  # two frames of one order


# ---------------------------------------------------------------- files, reports, texts


def test_docx_is_parsed_once(spark, tmp_path):
    from clausediff.plans import fixture

    spark.createDataFrame([(1, "one\ntwo"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tables = docx.docx_tables(fixture.docx_files(spark, str(tmp_path)))
    for t, kind in zip(tables, ("paragraph", "style", "level")):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and re.search(rf"PartitionFilters: \[.*kind#\d+ = {kind}", plan)
    assert [t.count() for t in tables] == [2, 6, 0]


def test_reports_come_back(spark, tmp_path):
    rows = [(f"p{i}", f"a{i}_vs_b_report.json", json.dumps({"config": {"total_articles": 2}, "article_level_results": [{"status": "changed"}, {"status": s}]})) for i, s in enumerate(["added", "changed", "chữ"] * 9)]
    path = str(tmp_path / "reports")
    reporting.write_reports(spark.createDataFrame(rows, "pair_id string, report_name string, report string"), path)
    assert sorted((r.pair_id, r.report_name, r.report) for r in reporting.read_reports(spark, path).collect()) == sorted(rows)
    two = reporting.read_reports(spark, path, "a3_vs_b_report.json", "a5_vs_b_report.json")
    assert {(r.report_name, r.total, r.listed, r.statuses) for r in reporting.report_counts(two).collect()} == {("a3_vs_b_report.json", 2, 2, "added=1,changed=1"), ("a5_vs_b_report.json", 2, 2, "changed=1,chữ=1")}
    assert "PartitionFilters: [prefix" in two._jdf.queryExecution().executedPlan().toString()


def test_texts_are_rebuilt(spark):
    rng = random.Random(7)
    lines = ["a", "b", "", "c c", "ü"]
    texts = [(str(i), 1, *("\n".join(rng.choice(lines) for _ in range(rng.randrange(9))) for _ in range(2))) for i in range(80)]
    texts += [("n", 1, None, "x\ny"), ("m", 1, "x", None), ("e", 1, "same\r\nas this\n", "same\r\nas this\n"), ("z", 1, "", None)]
    pairs = spark.createDataFrame(texts, "pair_id string, seq int, v1_text string, v2_text string")
    got = {r.pair_id: (r.v1_text, r.v2_text) for r in diffing.rebuilt_texts(diffing.line_diff_rows(pairs)).collect()}
    joined = lambda t: "\n".join((t or "").splitlines())
    assert got == {p: (joined(a), joined(b)) for p, _, a, b in texts if (a or "").splitlines() or (b or "").splitlines()}
    blocks = {r.pair_id: r.n for r in diffing.diff_blocks(pairs).groupBy("pair_id").count().withColumnRenamed("count", "n").collect()}
    rows = {r.pair_id: r.blocks for r in diffing.rebuilt_texts(diffing.line_diff_rows(pairs)).collect()}
    assert all(rows[p] == n for p, n in blocks.items())


def test_equal_texts_are_encoded_once(spark, tmp_path):
    log = tmp_path / "calls"

    def encoder(texts):
        with log.open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, ["one", "three", None][i % 3]) for i in range(30)], "i int, text string").repartition(4)
    got = {(r.i, tuple(r.embedding)) for r in vectors.embed_once(rows, "text", encoder).collect()}
    assert got == {(i, ((3.0, 5.0, 0.0)[i % 3], 1.0)) for i in range(30)}
    assert sorted(log.read_text().split("\n")) == ["", "", "one", "three"]
