"""The comparison operators against small state machines, difflib and hand-made rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clausediff.functions import predicates as P
from clausediff.functions import text as X
from clausediff.operators import chunking, diffing, grounding, index, matching, numbering, reporting, vectors
from clausediff.plans import fixture, jobs
from clausediff.sources import docx, files, lines


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_texts(spark):
    assert column(spark, ["\u00a0a \u2028\tb\r\n", None], X.normalize_ws) == ["a b", ""]
    assert column(spark, ["\u00a0a\u00a0 b\r\nc\r\n\n\n\nd \n"], X.normalize_text) == ["a b\nc\n\nd"]
    assert column(spark, ["x" * 241, "x" * 236 + "  y" + "z" * 9], X.shorten) == ["x" * 237 + "...", "x" * 236 + "..."]
    numbers = [0, 1, 4, 9, 26, 27, 52, 702, 703, 1994, 3999]
    assert column(spark, numbers, lambda c: X.format_counter(c, F.lit("upperRoman")), "int") == ["I", "I", "IV", "IX", "XXVI", "XXVII", "LII", "DCCII", "DCCIII", "MCMXCIV", "MMMCMXCIX"]
    assert column(spark, numbers, lambda c: X.format_counter(c, F.lit("lowerLetter")), "int")[:9] == ["a", "a", "d", "i", "z", "aa", "az", "zz", "aaa"]
    rows = spark.createDataFrame([(x,) for x in ("10a", "II", "2", "10", "1b", "")], "no string")
    assert [r.no for r in rows.orderBy(X.article_sort_key(F.col("no"))).collect()] == ["1b", "2", "10", "10a", "", "II"]
    assert column(spark, ["Heading 2", "heading", None], lambda c: X.heading_level(c, F.lit("Heading3"))) == [2, 3, 3]
    assert column(spark, ['{"a":1}', 'x {"a":2} y', "no", "{"], lambda c: F.try_variant_get(X.first_json_object(c), "$.a", "int")) == [1, 2, None, None]
    assert column(spark, ["GIẢI THÍCH TỪ NGỮ", "khác"], X.chunk_type) == ["definition", "article"]


def test_predicates(spark):
    given = ["CHƯƠNG II", "Mục 1: A", "Điều Lệ Công ty", "Điều 10a. X", "1.1. x", "đ) y", "điều 5", "QUYỀN VÀ NGHĨA VỤ", "Diện Tích 5 m²", "Quyền Của Các Bên", "Kết thúc."]
    assert column(spark, given, P.line_kind) == ["chuong", "muc", "dieu", "dieu", "khoan", "diem", "text", "text", "text", "text", "text"]
    assert column(spark, given, lambda c: P.line_number(c, P.line_kind(c)))[:6] == ["II", "1", "L", "10a", "1", "đ"]
    assert column(spark, given, P.contract_heading) == [False] * 7 + [True, False, True, False]


def article_machine(text):
    """(article_number, clause_id, chuong_so, muc_so, text) of a document, line by line."""
    import re

    rows = [x.strip() for x in text.split("\n") if x.strip()]
    di = re.compile(r"^(?:Điều|ĐIỀU|dieu|DIEU)\s+((?:\d+[A-Za-z]?|[IVXLCDM]+))[\.:]?\s*(.*)$")
    explicit = any(di.match(x) for x in rows)
    out, now, ch, mu, seen, seq, heads = [], None, "0", "0", False, 0, 0
    for x in rows:
        if m := re.match(r"(?i)^Chương\s+([IVXLCDM\d]+)", x):
            now, ch, mu, seen = None, m[1], "0", True
        elif m := re.match(r"(?i)^Mục\s+(\d+)", x):
            now, mu, seen = None, m[1], True
        elif m := di.match(x):
            now = {"no": m[1], "id": f"article_{m[1]}", "at": (ch, mu), "lines": [x], "body": 1}
            out.append(now)
        elif not explicit and seen and x.startswith("QUYỀN"):
            if now is None or now["body"]:
                seq += 1
                now = {"no": str(seq), "id": f"section_{seq:03d}", "at": (ch, mu), "lines": [], "body": 0}
                out.append(now)
            now["lines"].append(x)
        elif now is not None:
            now["lines"].append(x)
            now["body"] += 1
    return [(a["no"], a["id"], *a["at"], "\n".join(a["lines"])) for a in out if a["body"]]


def test_chunks_against_a_state_machine(spark):
    rng = random.Random(6)
    kinds = ["Chương II. A", "Mục 3", "Điều 4. Tên", "Điều 4", "QUYỀN VÀ NGHĨA VỤ", "QUYỀN CỦA CÁC BÊN", "1. một khoản.", "a) một điểm.", "thường thôi.", " "]
    texts = []
    for i in range(150):
        pool = [k for k in kinds if i % 2 or "Điều" not in k]
        texts.append("\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))))
    rows = spark.createDataFrame([(str(i), "v1", t) for i, t in enumerate(texts)], "doc_id string, version string, text string")
    got = {}
    for r in chunking.chunk_plain_text(lines.text_lines(rows)).orderBy("doc_id", "chunk_idx").collect():
        assert r.chunk_id == f"{r.doc_id}_v1_{r.chunk_idx:04d}" and r.char_len == len(r.text)
        got.setdefault(int(r.doc_id), []).append((r.article_number, r.clause_id, r.chuong_so, r.muc_so, r.text))
    assert got == {i: a for i, t in enumerate(texts) if (a := article_machine(t))}


def test_khoan_items(spark):
    text = "Chương I\nĐiều 1. Tên:\nlead\na) before\n1. first\na) point\nmore\n2)\nrest\n1.1. x"
    rows = spark.createDataFrame([("d", "v1", text)], "doc_id string, version string, text string")
    r = chunking.chunk_plain_text(lines.text_lines(rows)).first()
    assert (r.article_title, r.khoan_count, r.diem_count) == ("Tên", 3, 1)
    assert [(k.khoan_number, k.text) for k in r.khoan_items] == [("1", "first\na) point\nmore"), ("2", "rest"), ("1", "1. x")]
    assert r.khoan_items[0].diem_items[0].text == "point"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes():
    par = lambda t, s="", n="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{s}{chr(34)}/>' if s else ''}{n}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    style = lambda i, b="", n="": f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="heading {i[-1]}"/>{f"<w:basedOn w:val={chr(34)}{b}{chr(34)}/>" if b else ""}<w:pPr>{n}</w:pPr></w:style>'
    num = lambda i, l: f'<w:numPr><w:ilvl w:val="{l}"/><w:numId w:val="{i}"/></w:numPr>'
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate((("upperRoman", "Điều %1."), ("decimal", "%1.%2."), ("lowerLetter", "%1.%2.%3"))))
    parts = {
        "word/document.xml": f"<w:document {W}><w:body>" + par("before") + par("One:", "H1") + par("body") + par("Clause", "H2") + par("Sub", "H3") + par("deep") + par("", "H1") + par("Two", "H1") + par("Lone", "H3") + "</w:body></w:document>",
        "word/styles.xml": f"<w:styles {W}>{style('H1', '', num(7, 0))}{style('H2', '', num(7, 1))}{style('H3', 'X3')}{style('X3', 'H3', num(7, 2))}</w:styles>",
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="1">{levels}</w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "deal_v2.docx").write_bytes(docx_bytes())
    (tmp_path / "deal_changes.docx").write_bytes(b"")
    found = files.file_identity(files.discover_files(spark, str(tmp_path)))
    assert [(r.doc_id, r.version) for r in found.collect()] == [("deal_v2", "v2")]
    got = jobs.corpus_to_chunks(*docx.docx_tables(found)).orderBy("chunk_idx").collect()
    assert [(r.article_number, r.article_title, r.khoan_count, r.tieu_muc_count) for r in got] == [("I", "One", 1, 1), ("II", "Two", 1, 1)]
    assert got[0].text == "Điều I. One:\nbody\nI.1. Clause\nI.1.a Sub\ndeep"
    assert got[0].khoan_items[0].khoan_number == "I.1" and got[1].khoan_items[0].title == ""


def test_docx_of_documents(spark, tmp_path):
    texts = ["one\n\n  two & <three>\x07\r\nfour", None, "", "\n" * 7 + "seven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = docx.docx_tables(fixture.docx_files(spark, str(tmp_path)))[0].orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.idx, r.text, r.style_id, r.num_id, r.ilvl) for r in got] == [
        ("0", 0, "one", "H1", None, None), ("0", 2, "two & <three>", "Normal", None, None), ("0", 3, "four", "Normal", None, None), ("3", 7, "seven", "Normal", 7, 1),
    ]


def test_matching_diffs_and_reports(spark):
    v1 = {"1": "a b c d", "2": "one two three", "3": "gone entirely"}
    v2 = {"1": "a b c x", "2": "one two three", "9": "brand new words"}
    rows = [("p", f"d_{v}_{n}", "d", v, i, n, f"t{n}", t) for v, side in (("v1", v1), ("v2", v2)) for i, (n, t) in enumerate(side.items())]
    chunks = spark.createDataFrame(rows, "pair_id string, chunk_id string, doc_id string, version string, chunk_idx int, article_number string, article_title string, text string")
    got = jobs.compare_corpus(chunks).orderBy("seq").collect()
    assert [(r.article_number, r.matched_article_v2, r.status) for r in got] == [("1", "1", "changed"), ("2", "2", "unchanged"), ("3", None, "removed"), ("9", "9", "added")]
    assert [r.fallback_reason for r in got][1] == "texts_equal" and all(r.grounded for r in got)
    assert [(e.tag, e.before) for e in got[0].evidence] == [("changed", "a b c d")]
    results = spark.createDataFrame(got, jobs.compare_corpus(chunks).schema)
    head, summary, citations = jobs.reports(results)
    assert head.first().status_counts == {"added": 1, "changed": 1, "removed": 1, "unchanged": 1}
    assert summary.count() == 4 and citations.count() == 3
    raw = [("p", 1, 'ok {"status": "changed", "conclusion": "", "evidence": "x", "diff_annotations": [{"block_id": "B1", "summary": "s", "severity": "HIGH"}, {"block_id": "B7", "summary": "s"}, 5]}'), ("p", 3, "[]"), ("p", 4, "{}")]
    answers = spark.createDataFrame(raw, "pair_id string, seq int, raw_response string")
    got = {r.seq: r for r in jobs.compare_corpus(chunks, responses=answers).collect()}
    assert (got[1].llm_used, got[1].conclusion, [a.severity for a in got[1].diff_annotations]) == (True, grounding.DEFAULTS["changed"], ["high"])
    assert got[3].fallback_reason == got[4].fallback_reason == grounding.BAD_REASON and got[2].fallback_reason == "texts_equal"


def test_greedy_takes_each_right_once(spark):
    rng = random.Random(1)
    cands = [("p", str(i), k + 1, f"c{j}", str(j), "t", 0.0, rng.choice([0.4, 0.6, 0.9])) for i in range(40) for k, j in enumerate(rng.sample(range(25), 3))]
    table = spark.createDataFrame(cands, "pair_id string, left_no string, rank int, chunk_id string, article_number string, article_title string, distance double, similarity double")
    used, expected = set(), {}
    for i in range(40):
        for c in sorted(x for x in cands if x[1] == str(i)):
            if c[4] not in used and c[7] >= 0.5:
                used.add(c[4])
                expected[str(i)] = c[4]
                break
    assert {r.left_no: r.right_no for r in matching.greedy_match(table).collect()} == expected


def test_line_diff_and_index(spark):
    assert [r["op"] for r in diffing.side_by_side("a\nb\nc", "a\nx\ny\nc")] == ["equal", "replace", "replace", "equal"]
    assert diffing.evidence_items("", "b") == [{"tag": "added", "before": "", "after": "b"}]
    rows = spark.createDataFrame([("1", "d", "v1", "x"), ("2", "d", "v1", "y")], "chunk_id string, doc_id string, version string, text string")
    new = spark.createDataFrame([("1", "d", "v1", "z")], rows.schema)
    assert sorted(r.text for r in index.index_upsert(rows, new).collect()) == ["y", "z"]
    assert [r.text for r in index.index_upsert(rows, new, replace_docs=True).collect()] == ["z"]


def test_registry_is_complete():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


def test_greedy_match_against_a_fold(spark):
    import random

    from clausediff.operators import matching

    rng = random.Random(5)
    rows = [
        (p, str(left), rank, rng.choice(["", *map(str, range(1, 9))]), f"c{p}-{left}-{rank}", "t", rng.choice([0.3, 0.5, 0.9, None]))
        for p in (None, "a", "b", "c") for left in range(1, 14) for rank in (1, 2, 3)
    ]
    names = "pair_id string, left_no string, rank int, article_number string, chunk_id string, article_title string, similarity double"
    want, used, done = set(), set(), set()
    for p, left, _, no, chunk, _, s in sorted(rows, key=lambda r: (r[0] or "", int(r[1]), r[2])):
        if no and s is not None and s >= 0.5 and (p, no) not in used and (p, left) not in done:
            used.add((p, no))
            done.add((p, left))
            want.add((p, left, no, chunk))
    got = matching.greedy_match(spark.createDataFrame(rows, names).repartition(7)).collect()
    assert {(r.pair_id, r.left_no, r.right_no, r.chunk_id) for r in got} == want and len(got) == len(want)
    assert matching.greedy_match(spark.createDataFrame([], names)).count() == 0


def test_placed_numbers_over_ranges(spark):
    from clausediff.operators import index

    rows = spark.range(0, 5000, 1, 9).select("id", (F.col("id") * 7919 % 13).alias("k"))
    got = index.placed(rows, F.col("k"), F.col("id")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert index.placed(rows.where("id < 0"), F.col("k"), F.col("id")).count() == 0


def test_chunk_quality_rows(spark):
    from clausediff.operators import index

    chunks = spark.createDataFrame(
        [("1", "x1", "c1", "I", 10, "article"), ("1", "x1", "c1", "I", 99, "article"), ("2", "x2", "c2", None, 30, None)],
        "doc_id string, chunk_id string, clause_id string, chuong_so string, char_len int, chunk_type string",
    )
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    found = index.chunk_quality(docs, chunks)
    assert {tuple(r) for r in found.collect()} == {
        ("no_chunks", "3", 1), ("duplicate_id", "x1", 2), ("short_text", "c1", 1), ("short_text", "c2", 1), ("invalid_type", "x2", 1), ("chapters", "I", 2),
    }
    assert ("short_text", 2, 2) in {tuple(r) for r in index.quality_counts(found).collect()}
