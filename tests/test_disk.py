"""What a job puts on the disk: how often texts are shuffled, and what stays when a step is done."""

import json
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausediff.functions.text import article_sort_key
from clausediff.operators import chunking, grounding, matching, numbering, reporting
from clausediff.plans import fixture, jobs, registry
from clausediff.sources import docx, files

DOCUMENT = "doc_id long, text string"
TEXTS = [(1, "a\nb. c\nd\ne\nf\ng\nh\ni"), (2, None), (3, "x\n1. y\na) z\n \nMục 2\nw"), (4, " ")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(key)
    out = files.stored(spark.range(1000).repartition(3, "id").withColumn("p", F.col("id") % 2), "t", "p")
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(key) == conf
    assert out.count() == 1000 and sum(r.id for r in out.collect()) == 499500


def test_docx_corpus_moves_texts_once_a_table(spark, tmp_path, monkeypatch):
    """Files are made where documents lie; numbering, styles and modes share one dealing by document."""
    spark.createDataFrame([(1, "a\nb. c\n"), (2, None), (3, "x\n1. y\na) z\n \nMục 2\nw")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in plan(fixture.versioned_files(spark, str(tmp_path)))
    given, kept = [], files.stored
    monkeypatch.setattr(files, "stored", lambda rows, *a: (given.append(plan(rows)), kept(rows, *a))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = jobs.corpus_to_chunks(*docx.docx_tables(fixture.versioned_files(spark, str(tmp_path))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (paragraphs,) = given
    assert paragraphs.count("REPARTITION_BY_COL") == 1
    above = paragraphs[: paragraphs.index("REPARTITION_BY_COL")].split("\n")  # and the joined styles and levels, which are aggregates
    assert not any("Exchange" in x and "Aggregate" not in above[i + 1] and "Project" not in above[i + 1] for i, x in enumerate(above[:-1]))
    key = ("doc_id", "version", "chunk_idx", "text", "article_title")
    expected = chunking.chunk_texts(fixture.versioned_texts(spark, str(tmp_path))).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(map(tuple, chunks.select(*key).collect())) == sorted(map(tuple, expected.select(*key).collect()))


def test_styles_and_levels_of_one_document(spark):
    """A paragraph's own number wins; styles and lists without a name or of other documents give nothing."""
    p = spark.createDataFrame([("d", "v1", 0, "a", "S", None, None), ("d", "v1", 1, "b", "T", 9, 1), ("d", "v1", 2, "c", None, None, None), ("e", "v1", 0, "x", "S", None, None)],
                              "doc_id string, version string, idx int, text string, style_id string, num_id int, ilvl int")
    styles = spark.createDataFrame([("d", "v1", "S", None, 4, 0), ("d", "v1", None, None, 5, 0), ("f", "v1", "S", None, 6, 0)], "doc_id string, version string, style_id string, based_on string, num_id int, ilvl int")
    levels = spark.createDataFrame([("d", "v1", 4, 0, 3, "upperRoman", "(%1)"), ("d", "v1", None, 0, 1, "decimal", "?"), ("e", "v1", 4, 0, 1, "decimal", "%1")], "doc_id string, version string, num_id int, level int, start int, num_fmt string, lvl_text string")
    got = numbering.numbering_labels(numbering.style_numbering(p, styles), levels).collect()
    assert {(r.doc_id, r.idx): (r.num_id, r.ilvl, r.numbering_label) for r in got} == {("d", 0): (4, 0, "(III)"), ("d", 1): (9, 1, "1"), ("d", 2): (None, None, None), ("e", 0): (None, None, None)}


def test_compared_articles_in_one_dealing(spark):
    """The rows of matches, removed and added articles put together, which one shuffle by pair makes."""
    rng = random.Random(8)
    sides = [[(p, str(n), rng.choice([None, f"{s}{n}"]), f"{s} text {p} {n}") for p in ("a", "b", None) for n in rng.sample(range(1, 30), 18)] for s in "lr"]
    left, right = (spark.createDataFrame(rows, "pair_id string, article_number string, article_title string, full_text string") for rows in sides)
    matches, texts = [], []
    for p in ("a", "b"):
        l, r = ([row[1] for row in rows if row[0] == p] for rows in sides)
        for i, (x, y) in enumerate(zip(rng.sample(l, 12), rng.sample(r, 10) + [" 7", "99"], strict=True)):
            matches.append((p, x, y, f"{p}{i}", rng.choice(["", None, "near"]), rng.random()))
        texts += [(p, f"{p}{i}", f"chunk {i}") for i in (10, 20)]
    matches = spark.createDataFrame(matches, "pair_id string, left_no string, right_no string, chunk_id string, title string, similarity double")
    chunks = spark.createDataFrame(texts, "pair_id string, chunk_id string, text string")
    for c in (chunks, None):
        old = matching.matched_pairs(matches, left, right, c).unionByName(matching.removed_articles(left, matches)).withColumn("_part", F.lit(0))
        old = old.unionByName(matching.added_articles(right, matches).withColumn("_part", F.lit(1)))
        old = old.withColumn("match_score", F.round("match_score", 4)).withColumn("seq", F.row_number().over(Window.partitionBy("pair_id").orderBy("_part", article_sort_key(F.col("article_number"))))).drop("_part")
        new = matching.compared_articles(left, right, matches, c)
        assert new.columns == old.columns and plan(new).count("Exchange") == 1
        assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect())) and new.count() > 60


def test_pairs_are_compared_from_stored_tables(spark, monkeypatch):
    """Of a number's chunks the last one counts; what makes chunks and matches is not run again for the texts."""
    rows = [("p", "v1", "a1", 1, "1", "t", "first try"), ("p", "v1", "a2", 2, " 1", "t", "one two three"), ("p", "v1", "a3", 3, "", "t", "no number"), ("p", "v2", "b1", 1, "4 ", "u", "one two three"), ("p", "v2", "b2", 2, None, "u", "one two three")]
    chunks = spark.createDataFrame(rows, "pair_id string, version string, chunk_id string, chunk_idx int, article_number string, article_title string, text string")
    names, kept = [], files.stored
    monkeypatch.setattr(files, "stored", lambda df, name, *a: (names.append(name), kept(df, name, *a))[1])
    got = jobs.matched_rows(chunks)
    assert names == ["pair-chunks", "matches"] and plan(got).count("Exchange") == 1 and "MapInArrow" not in plan(got)
    assert [tuple(r) for r in got.orderBy("seq").collect()] == [("p", "1", "u", "4 ", 1.0, "one two three", "one two three", 1), ("p", "4", "u", "4", 0.0, None, "one two three", 2)]


DOCUMENT = "doc_id long, text string"
TEXTS = [(1, "a\nb. c\nd\ne\nf\ng\nh\ni"), (2, None), (3, "x\n1. y\na) z\n \nMục 2\nw"), (4, " ")]


def test_answers_need_one_pass(spark):
    """Usable and unusable answers are told apart row by row, so pairs are read and compared once."""
    texts = [("a b", "a c"), ("same", "same"), ("gone", None), (None, "new"), ("x y", "x z"), ("p q", "p r"), ("k", "l")]
    pairs = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate(texts)], "pair_id string, seq int, v1_text string, v2_text string")
    good = json.dumps({"status": "odd", "conclusion": " said  so ", "evidence": [{"tag": "", "before": "a b", "after": ""}, 7], "diff_annotations": [{"block_id": "B1", "summary": "s", "severity": "HIGH"}, {"block_id": "B9", "summary": "s"}]})
    raw = [("p", 0, good), ("p", 1, good), ("p", 2, "so {\"status\": \"changed\"} it is"), ("p", 4, "[]"), ("p", 4, "{}"), ("p", 5, None), ("q", 6, good)]
    r = grounding.apply_responses(pairs, spark.createDataFrame(raw, "pair_id string, seq int, raw_response string"), "m")
    assert plan(r).count("ArrowEvalPython") == 1 and plan(r).count("Join") == 1
    assert r.columns == ["pair_id", "seq", "v1_text", "v2_text", "diff_blocks", "status", "evidence", "conclusion", "grounded", "diff_annotations", "llm_used", "fallback_reason", "llm_model"]
    got = sorted((x.seq, x.status, x.llm_used, x.fallback_reason, x.llm_model, x.conclusion, [e.before for e in x.evidence], [a.severity for a in x.diff_annotations], x.grounded) for x in r.collect())
    bad = (False, grounding.BAD_REASON, "m", grounding.BAD_RESPONSE)
    assert got == [
        (0, "changed", True, None, "m", "said so", ["a b"], ["high"], True), (1, "unchanged", False, "texts_equal", None, grounding.UNCHANGED, [], [], True),
        (2, "changed", True, None, "m", grounding.DEFAULTS["changed"], ["gone"], [], True), (3, "added", *bad, [""], [], True), (4, "changed", *bad, ["x y"], [], True),
        (4, "changed", *bad, ["x y"], [], True), (5, "changed", *bad, ["p q"], [], True), (6, "changed", *bad, ["k"], [], True),
    ]


def test_answered_pairs_are_made_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame(TEXTS, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    given, kept = [], files.stored
    monkeypatch.setattr(files, "stored", lambda rows, *a: (given.append(plan(rows)), kept(rows, *a))[1])
    for name in ("apply_responses", "annotate_blocks"):
        given.clear()
        out = registry.QUERIES[name](spark, str(tmp_path))
        assert [p.count("Exchange") for p in given] == [1] and f"{tmp_path}/documents" not in plan(out)
        assert out.count() > 0


def test_reports_are_counted_from_their_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(p, i, rng.choice(["added", "changed", "unchanged", "odd"]), rng.choice([True, False, None]), rng.choice([True, False, None])) for p in "abc" for i in range(9)]
    results = spark.createDataFrame(rows, "pair_id string, seq int, status string, grounded boolean, llm_used boolean")
    found = reporting.report_documents(results, {"k": 3})
    assert plan(found).count("Exchange") == 1
    head = {r.pair_id: r.h for r in reporting.build_report(results, {"k": 3}).select("pair_id", F.to_json(F.struct("total_articles", "status_counts", "llm_used_count", "fallback_count", "grounded_count", "ungrounded_count", "k", "principle"), {"ignoreNullFields": "false"}).alias("h")).collect()}
    sums = {r.pair_id: json.loads(r.report) for r in found.collect()}
    expected = {p: json.loads(h) for p, h in head.items()}
    for p, config in expected.items():
        assert sums[p]["config"] == config and [x["seq"] for x in sums[p]["article_level_results"]] == list(range(9))
    reporting.write_reports(found.withColumn("report_name", F.concat("pair_id", F.lit("_report.json"))), f"{tmp_path}/r")
    assert all(f.endswith(".json.gz") for f in spark.read.json(f"{tmp_path}/r").inputFiles())
    assert sorted(map(tuple, reporting.read_reports(spark, f"{tmp_path}/r").select("pair_id", "report").collect())) == sorted(map(tuple, found.collect()))


def test_results_move_texts_once(spark, tmp_path):
    spark.createDataFrame(TEXTS, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    found = plan(fixture.results(spark, str(tmp_path)))
    assert found.count("Exchange") == 1 and found.count("Scan parquet") == 1


def test_heading_chunks_against_a_fold(spark):
    """Articles, clauses and sub-items of random headings; one shuffle by document carries the paragraphs."""
    rng = random.Random(12)
    rows, want = [], []
    for doc in map(str, range(40)):
        articles = []
        for i in range(rng.randrange(30)):
            level, label = rng.choice([None, None, 1, 2, 3, 4]), rng.choice(["1.", "2.1", "", None, "x.."])
            path, text = rng.choice([None, [], ["1"], ["1", "2", "3"]]), rng.choice(["Tên: ", "chữ", "b", ""])
            rows.append((doc, "v1", i, text, f"{label} {text}".strip() if label else text, level, label, path))
            shown, bare, title = (rows[-1][4] or text).strip(), (label or "").rstrip("."), text.strip().rstrip(": ")
            h = level if label else None
            if h == 1:
                articles.append({"no": path[0] if path else bare, "title": title, "lines": [], "clauses": []})
            if not articles:
                continue
            a = articles[-1]
            if h == 2 or h == 3 and not a["clauses"]:
                a["clauses"].append({"no": bare if h == 2 or len(path or []) < 2 else ".".join(path[:2]), "title": title if h == 2 else "", "lines": [], "subs": []})
            for clause in a["clauses"][-1:]:
                if h == 3:
                    clause["subs"].append((bare, title, []))
                for lines in [clause["lines"], *[s[2] for s in clause["subs"][-1:]]]:
                    lines += [shown] if shown else []
            a["lines"] += [shown] if shown else []
        text = lambda lines: "\n".join(lines).strip()
        kept = [a for a in articles if text(a["lines"])]
        want += [(doc, n, a["no"], a["title"], text(a["lines"]), [(c["no"], c["title"], text(c["lines"]), [(x, y, text(z)) for x, y, z in c["subs"]]) for c in a["clauses"]]) for n, a in enumerate(kept, 1)]
    p = spark.createDataFrame(rows, "doc_id string, version string, idx int, text string, display_text string, heading_level int, numbering_label string, numbering_path array<string>")
    c = chunking.chunk_docx_headings(p.repartition(5))
    got = [(r.doc_id, r.chunk_idx, r.article_number, r.article_title, r.text, [(k.khoan_number, k.title, k.text, [tuple(t) for t in k.tieu_muc_items]) for k in r.khoan_items]) for r in c.collect()]
    assert sorted(got) == sorted(want) and len(got) > 50
    assert plan(chunking.chunk_docx_headings(p)).count("Exchange") == 1


def test_one_version_is_dealt_once(spark, tmp_path, monkeypatch):
    """Also where the plan knows the version, which it then leaves out of its keys."""
    spark.createDataFrame(TEXTS, DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    given, kept = [], files.stored
    monkeypatch.setattr(files, "stored", lambda rows, *a: (given.append(plan(rows)), kept(rows, *a))[1])
    assert registry.QUERIES["chunk_docx_headings"](spark, str(tmp_path)).count() > 0
    (paragraphs,) = given
    above = paragraphs[: paragraphs.index("REPARTITION_BY_COL")]
    assert "num_id" not in "".join(x for x in above.split("\n") if "Exchange hashpartitioning" in x) and above.count("Exchange hashpartitioning") == 1
