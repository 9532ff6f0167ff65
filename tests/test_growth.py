"""How often a job reads and moves its input: figures that grow with it."""

import difflib
import random
import re

from pyspark.sql import functions as F

from clausediff.functions import text as X
from clausediff.operators import chunking, diffing, index, matching
from clausediff.plans import fixture, jobs, registry
from clausediff.sources import docx, files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strip_takes_pythons_white_space(spark):
    """Every character below U+3100 alone, inside and at both ends."""
    odd = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    given = [c + "x" + c + "y" + c for c in odd] + odd + ["", " 　:\t: "]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    c = F.col("v")
    got = rows.select(X.strip(c).alias("s"), X.clean_heading(c).alias("h"), X.normalize_ws(c).alias("n")).collect()
    assert [r.s for r in got] == [v.strip() for v in given]
    blank = "".join(ch for ch in odd if ch.isspace())
    assert [r.h for r in got] == [v.strip().rstrip(blank + ":") for v in given]
    assert [r.n for r in got] == [re.sub(r"\s+", " ", v).strip(" ") for v in given]


def test_white_space_runs(spark):
    rng = random.Random(3)
    given = ["".join(rng.choice("a b\t\n   ") for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r.n for r in rows.select(X.normalize_ws(F.col("v")).alias("n")).collect()] == [" ".join(v.split()) for v in given]


def test_chunks_move_lines_once(spark, tmp_path):
    """Lines are made without a shuffle, and one carries them to their chunks."""
    spark.createDataFrame([(1, "a\nb"), (2, None), (3, " \n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = fixture.versioned_lines(spark, str(tmp_path))
    assert "Exchange" not in plan(lines)
    assert [(r.version, r.line_no, r.line) for r in lines.orderBy("version", "line_no").collect()] == [
        ("v1", 0, "Chương 1"), ("v1", 1, "Điều 1. a"), ("v1", 2, "1. a"), ("v1", 11, "Điều 2. b"), ("v1", 12, "1. b"),
        ("v2", 0, "Chương 1"), ("v2", 1, "Điều 1. a"), ("v2", 2, "1. a"), ("v2", 11, "Điều 2. b"), ("v2", 12, "1. b"),
        ("v2", 13, "Điều 3. Điều khoản bổ sung"), ("v2", 14, "1. Các bên cam kết bảo mật hồ sơ 1"),
    ]
    chunks = chunking.chunk_plain_text(lines)
    assert plan(chunks).count("Exchange hashpartitioning") == 1 and plan(chunks).count("Scan parquet") == 1


def test_versions_meet_in_one_grouping(spark, tmp_path):
    rows = [("p", "v1", "a", 1, "T", "x y"), ("p", "v1", "a", 2, "T2", "x  y"), ("p", "v2", "a", 1, "U", "x y"), ("p", "v1", "b", 3, "B", "b"), ("p", "v2", "c", 3, "C", "c"),
            ("p", "v1", None, 1, "N", "n"), ("p", "v2", None, 1, "N", "n"), ("p", "v3", "a", 9, "T", "z")]
    spark.createDataFrame(rows, "pair_id string, version string, clause_id string, chunk_idx int, article_title string, text string").write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    one, two = matching.compare_versions(c), matching.compare_by_clause(c.where("version = 'v1'"), c.where("version = 'v2'"))
    assert plan(one).count("Scan parquet") == 1
    expected = {("a", "unchanged", "U", "x  y", "x y"), ("b", "removed", "B", "b", None), ("c", "added", "C", None, "c"), (None, "removed", "N", "n", None), (None, "added", "N", None, "n")}
    for found in (one, two):
        assert {tuple(r)[1:] for r in found.collect()} == expected and found.count() == 5


def test_a_text_that_goes_on_needs_no_search(monkeypatch):
    """difflib's own opcodes, for lines and characters, rare and frequent ones; no search where one side goes on."""
    rng = random.Random(8)
    for trial in range(1500):
        letters = "ab" if trial % 3 else "abcdefghijklmnopqrstuvwxyz0123456789" * 8
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 320)))
        b = a + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 320)))
        for x, y in ((a, b), (b, a), (list(a), list(b)), (list(b), list(a)), ("", a), (a, ""), (a, a), (a, b[1:])) if trial < 300 else ((a, b), (b, a)):
            assert [tuple(op) for op in diffing._ops(x, y)] == difflib.SequenceMatcher(None, x, y).get_opcodes()
    monkeypatch.setattr(diffing.difflib, "SequenceMatcher", None)
    assert diffing.evidence_items("x" * 90000, "x" * 90000 + " more")[0]["tag"] == "insert"


def test_equal_texts_but_for_white_space(spark):
    given = [("a b", "a b"), ("a  b", " a b"), (None, " \t"), (None, None), ("", None), ("a", " "), (" ", "b"), ("a", "b"), (None, "b")]
    rows = spark.createDataFrame(given, "a string, b string")
    a, b = F.col("a"), F.col("b")
    n = X.normalize_ws
    for r in rows.select(X.same_text(a, b).alias("s"), (n(a) == n(b)).alias("t"), X.status_of_pair(a, b).alias("u"), X.status_from_texts(n(a), n(b)).alias("v")).collect():
        assert (r.s, r.u) == (r.t, r.v)


def test_normalised_text_with_and_without_marks(spark):
    rng = random.Random(5)
    given = ["".join(rng.choice(["a", "b", " ", "\n", "\t", "\r", " ", " "][: rng.choice([4, 8])]) for _ in range(rng.randrange(12))) for _ in range(2000)] + [None]
    rows = spark.createDataFrame([(v,) for v in given], "v string")

    def slow(t):
        t = re.sub(r"[ \t]+", " ", re.sub(r"\r\n|\r", "\n", t.replace(" ", " ")))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    got = [r.t for r in rows.select(X.normalize_text(F.col("v")).alias("t")).collect()]
    assert got == [None if v is None else slow(v) for v in given]


def test_paragraphs_are_numbered_once(spark, tmp_path):
    """The chunks of paragraphs are made from a stored table, not from what numbered them."""
    rows = [("d", "v1", 0, "One", "heading 1", "1."), ("d", "v1", 1, "a  b", "Normal", None), ("e", "v1", 0, "Điều 1. X", "Normal", None), ("e", "v1", 1, "1. y", "Normal", None)]
    p = spark.createDataFrame(rows, "doc_id string, version string, idx int, text string, style_name string, numbering_label string")
    p = p.withColumns({"display_text": F.col("text"), "heading_level": F.when(F.col("style_name") == "heading 1", 1), "numbering_path": F.array().cast("array<string>")})
    p.write.parquet(f"{tmp_path}/in")
    chunks = jobs.corpus_to_chunks(spark.read.parquet(f"{tmp_path}/in"))
    assert f"{tmp_path}/in" not in plan(chunks) and not any(f"{tmp_path}/in/" in f for f in chunks.inputFiles())
    assert {(r.doc_id, r.article_title, r.text) for r in chunks.collect()} == {("d", "One", "One\na b"), ("e", "X", "Điều 1. X\n1. y")}


def test_texts_are_cut_where_they_lie(spark, tmp_path):
    """The rows of whole texts are those of their lines, odd white space and unlabelled headings included, and nothing is shuffled."""
    rng = random.Random(11)
    gaps = [" ", "\t", "\x0b", "\x85", "\u2028", " \r ", "\x1c", ""]
    pool = ["Chương_II. A", "CHƯƠNG_3", "Chương_", "Mục_3 b", "MỤC_٣", "Điều_4. Tên_", "ĐIỀU_XII_z", "Điều_", "Điều 9._: ", "QUYỀN VÀ_NGHĨA VỤ", "QUYỀN CỦA_BÊN", "1._khoản.", "12)_", "1.1._x", "a)_điểm.", "Đ._z", "thường_thôi.", "5"]
    made = lambda i: [re.sub("_", lambda _: rng.choice(gaps), rng.choice([k for k in pool if i % 2 or k[:2] not in ("Đi", "ĐI")])).strip() for _ in range(rng.randrange(24))]
    texts = [(str(i), "v1", "\n".join(x for x in made(i) if x)) for i in range(400)] + [("n", "v1", None)]
    spark.createDataFrame(texts, "doc_id string, version string, text string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    by_line = chunking.chunk_plain_text(t.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''"))
    by_text = chunking.chunk_texts(t)
    found = [sorted(r.j for r in c.drop("created_at").select(F.to_json(F.struct("*")).alias("j")).collect()) for c in (by_line, by_text)]
    assert found[0] == found[1] and len(found[0]) > 400
    assert "Exchange" not in plan(by_text)


def test_chunks_of_texts_without_a_shuffle(spark):
    from clausediff.plans import registry

    for name in ("missing_metadata", "embed_chunks"):
        assert "Exchange" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_chunks_are_stored_before_ranges_are_sampled(spark, tmp_path, monkeypatch):
    """save_index() reads its rows twice, so lookups give it a table; chunks reach it, the upsert and
    the export without a shuffle."""
    spark.createDataFrame([(1, "a\nb. c\n"), (2, None), (3, "x\n1. y\na) z\n \nMục 2\nw")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, save, kept, export = [], index.save_index, files.stored, index.export_chunks
    monkeypatch.setattr(index, "save_index", lambda rows, path: (given.append(("index", plan(rows))), save(rows, path)))
    monkeypatch.setattr(files, "stored", lambda rows, *a: (given.append(("stored", plan(rows))), kept(rows, *a))[1])
    monkeypatch.setattr(index, "export_chunks", lambda rows, path: (given.append(("export", plan(rows))), export(rows, path))[1])
    for name in ("lookup_chapter", "index_upsert", "load_chunks", "export_chunks"):
        given.clear()
        assert registry.QUERIES[name](spark, str(tmp_path)).count() > 0
        assert given and all("Exchange" not in p and "Window" not in p for _, p in given)
        assert all("Generate" not in p for k, p in given if k == "index")


def test_strip_value_is_strip(spark):
    odd = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    given = [v for c in odd for v in (c, c + "x", "x" + c, c + "x" + c + "y" + c)] + ["", None, "a b", "\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    assert [r.s for r in rows.select(X.strip_value(F.col("v")).alias("s")).collect()] == [v if v is None else v.strip() for v in given]


def test_clauses_of_one_line_and_more(spark):
    """Numbers of other scripts, blanks behind the sign, a blank rest, points: the same from lines and from texts."""
    rng = random.Random(5)
    starts = ["1. ", "23) ", "٣.", "1.\t", "2.  ", "9.\x1f", "0" * 40 + ".", "3)"]
    texts, expected = [], {}
    for n in range(120):
        items = []
        for _ in range(rng.randrange(4)):
            start, rest, more = rng.choice(starts), rng.choice(["", "a", "a  b", "câu"]), rng.choices(["a) p", "tail", "đ. q"], k=rng.randrange(3))
            items.append(((start + rest).strip(), rest, more))
        texts.append((str(n), "v1", "\n".join(["Điều 1. T", *[x for first, _, more in items for x in (first, *more)]])))
        expected[str(n)] = [(re.match(r"\d+", first)[0], "\n".join(filter(None, [rest, *more])), len([m for m in more if m != "tail"])) for first, rest, more in items]
    frame = spark.createDataFrame(texts, "doc_id string, version string, text string")
    lines = frame.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    for chunks in (chunking.chunk_plain_text(lines), chunking.chunk_texts(frame)):
        found = {r.doc_id: [(k.khoan_number, k.text, len(k.diem_items)) for k in r.khoan_items] for r in chunks.collect()}
        assert found == expected


def test_many_small_files_make_few_tasks(spark, tmp_path):
    """A task reads many small files: Spark's own splits hold 32 of them."""
    for i in range(1500):
        (tmp_path / f"a{i}.docx").write_bytes(b"%d" % i)
    found = files.discover_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 16
    assert sorted(int(r.content) for r in found.select("content").collect()) == list(range(1500))


def test_folder_is_listed_in_parts_and_read_once(spark, tmp_path, monkeypatch):
    """Files are listed an inbox at a time; their paragraphs are counted where they are read, without
    a second scan, a stored table of paragraphs or a shuffle."""
    texts = {i: ["a\n \nb", None, "", "\x07", "x\r\n\n<y>&\tz"][i % 5] if i % 4 else "p\n" * i for i in range(200)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fixture, "INBOX_FILES", 50)
    listed, counted, discover, count = [], [], files.discover_files, docx.paragraph_counts
    monkeypatch.setattr(files, "discover_files", lambda s, *folders: (listed.append(folders), discover(s, *folders))[1])
    monkeypatch.setattr(docx, "paragraph_counts", lambda rows: (counted.append(count(rows)), counted[-1])[1])
    monkeypatch.setattr(docx, "docx_tables", None)
    got = registry.QUERIES["read_folder"](spark, str(tmp_path))
    assert len(listed) == len(counted) == 5
    assert all("Exchange" not in plan(c) and plan(c).count("FileScan binaryFile") == 1 for c in counted) and "binaryFile" not in plan(got)
    paragraphs = lambda t: sum(bool(re.sub(r"[\x00-\x08]", "", x).strip()) for x in (t or "").split("\n"))
    assert sorted(map(tuple, got.collect())) == sorted(
        (f"hd_{i}_V1" if i % 2 == 0 else f"hd_{i}_v2", "v1" if i % 2 == 0 else "v2", paragraphs(t), True) for i, t in texts.items() if i % 13 and i % 7 and i % 5
    )


def test_file_without_content_counts_none(spark):
    """Files that are not accepted stay as rows."""
    given = [("a", False, None), ("b", True, fixture._file_of("one\n\ntwo")), ("c", True, fixture._file_of(""))]
    rows = docx.paragraph_counts(spark.createDataFrame(given, "doc_id string, valid boolean, content binary"))
    assert sorted(map(tuple, rows.collect())) == [("a", False, 0), ("b", True, 2), ("c", True, 0)]
