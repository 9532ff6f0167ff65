"""Documents into articles with nested clauses and points.

All windows and groups are within a document, so one exchange on (doc_id, version) carries
the whole work; texts are put together only in the last collect_list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.predicates import CHUONG_HEAD, DIEM, DIEM_HEAD, DIEU_HEAD, KHOAN_HEAD, KHOAN_NUMBER, MUC_HEAD, before_line, contract_heading, line_kind, line_number, line_rest
from clausediff.functions.text import chunk_type, clean_heading, strip, strip_value
from clausediff.operators.numbering import document_texts, normalize_paragraphs
from clausediff.schemas import CHUNKS, KHOAN

KEY = ["doc_id", "version"]
_RUNNING = (Window.unboundedPreceding, 0)


def _running(cond: Column, w) -> Column:
    return F.sum(cond.cast("int")).over(w.rowsBetween(*_RUNNING))


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines (…, line) with kind, number and rest."""
    k = lines.withColumn("kind", line_kind(F.col("line")))
    return k.withColumn("number", line_number(F.col("line"), F.col("kind"))).withColumn("rest", line_rest(F.col("line"), F.col("kind")))


def article_lines(lines: DataFrame) -> DataFrame:
    """The lines (doc_id, version, line_no, line, kind) that belong to articles, with grp (the
    article within the document), is_head, section (its number where headings make the
    articles), chuong_so and muc_so. All are running values of one order, so one sort."""
    w = Window.partitionBy(*KEY).orderBy("line_no")
    running, whole = w.rowsBetween(*_RUNNING), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_ = lambda kind: F.col("kind") == kind
    p = lines.select(*KEY, "line_no", "line", line_kind(F.col("line")).alias("kind"))
    p = p.select("*", F.max(is_("dieu")).over(whole).alias("explicit"), F.max(is_("chuong") | is_("muc")).over(running).alias("opened"))
    p = p.withColumn("heading", F.when(~F.col("explicit") & F.col("opened") & is_("text"), contract_heading(F.col("line"))).otherwise(False))
    p = p.withColumn("section_start", F.col("heading") & ~F.coalesce(F.lag("heading").over(w), F.lit(False)))
    part, first = is_("chuong") | is_("muc"), is_("chuong") | is_("muc") | is_("dieu") | F.col("section_start")
    number = F.when(part, line_number(F.col("line"), F.col("kind")))
    p = p.withColumn("number", number).withColumn("_first", first)
    last = lambda c: F.last(c, ignorenulls=True).over(running)
    p = p.select(
        *KEY, "line_no", "line", "kind", "explicit", _running(F.col("_first"), w).alias("grp"), _running(F.col("section_start"), w).alias("section"),
        F.coalesce(last(F.when(is_("chuong"), F.col("number"))), F.lit("0")).alias("chuong_so"),
        F.coalesce(last(F.when(is_("chuong"), "0").when(is_("muc"), F.col("number"))), F.lit("0")).alias("muc_so"),
        last(F.when(F.col("_first"), part)).alias("_apart"),
        F.when(F.col("explicit"), F.col("_first")).otherwise(F.col("heading")).alias("is_head"),
    )
    return p.where("grp > 0 and not _apart").drop("_apart")


def khoan_items(rows: Column, starts: Column) -> Column:
    """The clauses in an article's rows (array of line, kind, in order), which begin at `starts`
    (from 1): khoan_items. A clause goes up to the next one's start, and what stands before the
    first is in none."""
    none = F.array().cast(KHOAN["tieu_muc_items"].dataType)

    def several(first: Column, more: Column) -> Column:
        parts = F.concat(F.array(_clause_rest(first)), F.transform(more, lambda x: x["line"]))
        points = F.transform(F.filter(more, lambda x: x["kind"] == "diem"), lambda x: _point(x["line"]))
        return F.struct(strip(F.array_join(F.filter(parts, lambda x: x != ""), "\n")).alias("text"), points.alias("points"))

    def item(span: Column) -> Column:
        first, more = F.get(rows, span["s"] - 1)["line"], F.slice(rows, span["s"] + 1, span["n"] - 1)
        one = F.struct(_clause_rest(first).alias("text"), F.array().cast(KHOAN["diem_items"].dataType).alias("points"))
        return _let(F.when(span["n"] == 1, one).otherwise(several(first, more)), lambda r: F.struct(
            F.regexp_extract(first, KHOAN_NUMBER, 1).alias("khoan_number"), F.lit(None).cast("string").alias("title"),
            r["text"].alias("text"), r["points"].alias("diem_items"), none.alias("tieu_muc_items"),
        ))

    return F.transform(_spans(starts, F.size(rows)), item)


def _point(line: Column) -> Column:
    number = line_number(line, F.lit("diem"))
    return F.struct(number.alias("diem_number"), number.alias("diem_key"), strip(line_rest(line, F.lit("diem"))).alias("text"))


def build_chunks(articles: DataFrame) -> DataFrame:
    """CHUNKS rows of articles (doc_id, version, grp, chuong_so, muc_so, clause_id,
    article_number, article_title, khoan_items, text): ids, counts, type and time."""
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("grp"))
    count = lambda c: F.aggregate("khoan_items", F.lit(0), lambda n, k: n + F.coalesce(F.size(k[c]), F.lit(0)))
    c = articles.withColumn("khoan_items", F.coalesce("khoan_items", F.array().cast(CHUNKS["khoan_items"].dataType))).withColumn("chunk_idx", order)
    c = c.withColumn("khoan_count", F.size("khoan_items")).withColumn("diem_count", count("diem_items")).withColumn("tieu_muc_count", count("tieu_muc_items"))
    return _identified(c)


def _identified(counted: DataFrame) -> DataFrame:
    c = counted.withColumn("doc_id", F.col("doc_id").cast("string"))
    c = c.withColumn("chunk_id", F.format_string("%s_%s_%04d", "doc_id", "version", "chunk_idx"))
    c = c.withColumn("chunk_type", chunk_type(F.col("article_title"))).withColumn("char_len", F.length("text"))
    return c.withColumn("created_at", F.current_timestamp()).select(*CHUNKS.names)


def chunk_plain_text(lines: DataFrame) -> DataFrame:
    """CHUNKS rows of plain-text documents, given as lines (doc_id, version, line_no, line).

    An article's lines are gathered once; its title, clauses and text come from that list."""
    same = ["explicit", "section", "chuong_so", "muc_so"]
    rows = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line_no", "line", "kind", "is_head"))))
    a = article_lines(lines).groupBy(*KEY, "grp").agg(*[F.first(c).alias(c) for c in same], rows.alias("rows"))
    a = a.withColumn("heads", F.transform(F.filter("rows", lambda x: x["is_head"]), lambda x: x["line"]))
    a = a.where(F.col("explicit") | (F.size("rows") > F.size("heads")))
    a = a.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: F.get("rows", i - 1)["kind"] == "khoan"))
    head, dieu = F.get("heads", 0), F.lit("dieu")
    a = a.withColumn("number", F.when(F.col("explicit"), line_number(head, dieu)))
    own = F.coalesce(F.nullif(strip(line_rest(head, dieu)), F.lit("")), F.concat(F.lit("Điều "), "number"))
    titles = F.filter(F.transform(F.when(F.col("explicit"), F.array(own)).otherwise(F.col("heads")), clean_heading), lambda x: x != "")
    a = a.withColumn("title", F.array_join(titles, " - "))
    a = a.withColumn("article_title", F.when(F.col("title") != "", F.col("title")).otherwise(F.array_join(F.transform("heads", clean_heading), " - ")))
    a = a.withColumn("article_number", F.when(F.col("explicit"), F.col("number")).otherwise(F.col("section").cast("string")))
    a = a.withColumn("clause_id", F.when(F.col("explicit"), F.concat(F.lit("article_"), "number")).otherwise(F.format_string("section_%03d", "section")))
    a = a.withColumn("text", strip(F.array_join(F.transform("rows", lambda x: x["line"]), "\n")))
    return build_chunks(a.withColumn("khoan_items", khoan_items(F.col("rows"), F.col("starts"))))


def _let(value: Column, then) -> Column:
    """then(value), where the value is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _parts(text: Column) -> Column:
    """A text cut before its chapters and their sections: chuong_so, muc_so, whether a heading came
    before (opened) and the text, which begins with that heading or else with a line end."""

    def part(c: Column, i: Column):
        chapter = F.when(i > 0, F.regexp_extract(c, CHUONG_HEAD, 1)).otherwise("0")
        return lambda m, j: F.struct(
            chapter.alias("chuong_so"), F.when(j > 0, F.regexp_extract(m, MUC_HEAD, 1)).otherwise("0").alias("muc_so"), ((i > 0) | (j > 0)).alias("opened"), m.alias("text")
        )

    sections = lambda c: F.when(c.rlike(before_line(MUC_HEAD)), F.split(c, before_line(MUC_HEAD))).otherwise(F.array(c))
    return F.flatten(F.transform(F.split(text, before_line(CHUONG_HEAD)), lambda c, i: F.transform(sections(c), part(c, i))))


def _article(part: Column, heads: Column, text: Column, bare: Column) -> Column:
    return F.struct(part["chuong_so"].alias("chuong_so"), part["muc_so"].alias("muc_so"), heads.alias("heads"), text.alias("text"), bare.alias("bare"))


def _labelled(part: Column) -> Column:
    """A part's articles, each from its "Điều" line on."""
    pieces = F.filter(F.split(part["text"], before_line(DIEU_HEAD)), lambda _, i: i > 0)
    return F.transform(pieces, lambda a: _article(part, F.array(F.substring_index(a, "\n", 1)), a, F.lit(False)))


def _sections(part: Column) -> Column:
    """A part's articles where no line is labelled: each from a run of headings on. Bare ones have no other line."""

    def cut(lines: Column, is_head: Column, starts: Column) -> Column:
        def article(s: Column, k: Column) -> Column:
            rows = F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s)
            heads = F.filter(rows, lambda _, i: F.get(is_head, s + i))
            return _article(part, heads, F.array_join(rows, "\n"), F.size(heads) == F.size(rows))

        return F.transform(starts, article)

    def found(lines: Column) -> Column:
        flags = F.transform(lines, lambda x, i: (i > 0) & contract_heading(x))
        begins = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i) & ~F.get(h, i - 1))
        return _let(flags, lambda h: _let(begins(h), lambda starts: cut(lines, h, starts)))

    return _let(F.split(part["text"], "\n"), found)


def _clauses(tail: Column, count: Column) -> Column:
    """The clauses in an article's text from its first clause on (null without one), of which there
    are `count`: khoan_items. split() compiles its pattern for every text, so a single one isn't split."""
    none = F.array().cast(KHOAN["tieu_muc_items"].dataType)

    def several(clause: Column) -> Column:
        more = F.filter(F.split(clause, "\n"), lambda _, i: i > 0)
        parts = F.concat(F.array(_clause_rest(F.substring_index(clause, "\n", 1))), more)
        points = F.transform(F.filter(more, lambda x: x.rlike(DIEM)), _point)
        return F.struct(strip(F.array_join(F.filter(parts, lambda x: x != ""), "\n")).alias("text"), points.alias("points"))

    def item(clause: Column) -> Column:
        no_points = F.array().cast(KHOAN["diem_items"].dataType)
        one = F.struct(_clause_rest(clause).alias("text"), no_points.alias("points"))
        read = F.when(F.contains(clause, F.lit("\n")), several(clause)).otherwise(one)
        return _let(read, lambda r: F.struct(
            F.regexp_extract(clause, KHOAN_NUMBER, 1).alias("khoan_number"), F.lit(None).cast("string").alias("title"),
            r["text"].alias("text"), r["points"].alias("diem_items"), none.alias("tieu_muc_items"),
        ))

    clauses = F.when(count == 1, F.array(tail)).otherwise(F.split(tail, before_line(KHOAN_HEAD)))
    return F.coalesce(F.transform(F.when(count > 0, clauses), item), F.array().cast(CHUNKS["khoan_items"].dataType))


def _clause_rest(line: Column) -> Column:
    """What a clause's first line holds after its number and the sign behind it, stripped."""
    number = F.length(F.regexp_extract(line, KHOAN_NUMBER, 1))
    return _let(F.substring(line, number + 2, F.length(line)), strip_value)


def chunk_texts(texts: DataFrame) -> DataFrame:
    """CHUNKS rows of plain-text documents, given as whole texts (doc_id, version, text) of stripped
    non-blank lines; the same rows as chunk_plain_text() of the lines. A text is cut before its headings
    where it lies, so nothing is shuffled, and counts come from line beginnings, so khoan_items are made
    only where they are read. What reads the rows twice, as sorting by range does, should store them first."""
    t = texts.where("text is not null").select(*KEY, F.concat(F.lit("\n"), "text").alias("text"))
    t = t.withColumn("explicit", F.col("text").rlike(before_line(DIEU_HEAD)))
    opened = F.filter(_parts(F.col("text")), lambda p: p["opened"])
    found = F.when(F.col("explicit"), F.flatten(F.transform(_parts(F.col("text")), _labelled))).otherwise(F.flatten(F.transform(opened, _sections)))
    numbered = F.transform(found, lambda a, i: F.struct(a.alias("a"), (i + 1).alias("section")))
    t = t.select(*KEY, "explicit", F.posexplode(F.filter(numbered, lambda x: ~x["a"]["bare"])).alias("at", "x"))
    a = t.select(*KEY, "explicit", (F.col("at") + 1).alias("chunk_idx"), "x.section", "x.a.chuong_so", "x.a.muc_so", "x.a.heads", F.col("x.a.text").alias("rows"))
    head, dieu = F.get("heads", 0), F.lit("dieu")
    a = a.withColumn("number", F.when(F.col("explicit"), line_number(head, dieu)))
    own = F.coalesce(F.nullif(strip(line_rest(head, dieu)), F.lit("")), F.concat(F.lit("Điều "), "number"))
    titles = F.filter(F.transform(F.when(F.col("explicit"), F.array(own)).otherwise(F.col("heads")), clean_heading), lambda x: x != "")
    a = a.withColumn("title", F.array_join(titles, " - "))
    a = a.withColumn("article_title", F.when(F.col("title") != "", F.col("title")).otherwise(F.array_join(F.transform("heads", clean_heading), " - ")))
    a = a.withColumn("article_number", F.when(F.col("explicit"), F.col("number")).otherwise(F.col("section").cast("string")))
    a = a.withColumn("clause_id", F.when(F.col("explicit"), F.concat(F.lit("article_"), "number")).otherwise(F.format_string("section_%03d", "section")))
    a = a.withColumn("text", strip_value(F.col("rows"))).withColumn("tail", F.nullif(F.regexp_extract("rows", rf"(?s)\n({KHOAN_HEAD}.*)", 1), F.lit("")))
    count = lambda head: F.regexp_count("tail", F.lit(before_line(head)))
    a = a.withColumn("khoan_count", F.coalesce(count(KHOAN_HEAD) + 1, F.lit(0))).withColumn("diem_count", F.coalesce(count(DIEM_HEAD), F.lit(0)))
    return _identified(a.withColumn("tieu_muc_count", F.lit(0)).withColumn("khoan_items", _clauses(F.col("tail"), F.col("khoan_count"))))


def chunk_mode(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with headings: whether the document has a labelled first-level heading."""
    labelled = (F.col("heading_level") == 1) & (F.coalesce("numbering_label", F.lit("")) != "")
    return paragraphs.withColumn("headings", F.max(F.coalesce(labelled, F.lit(False))).over(Window.partitionBy(*KEY)))


def chunk_docx_headings(paragraphs: DataFrame) -> DataFrame:
    """CHUNKS rows of documents whose numbered headings are their articles (level 1), clauses (2) and sub-items (3).

    An article's paragraphs are gathered once; its number, clauses, sub-items and text come from that list."""
    p = paragraphs.withColumn("label", F.coalesce("numbering_label", F.lit(""))).withColumn("shown", strip(F.coalesce(F.nullif("display_text", F.lit("")), "text")))
    p = p.withColumn("h", F.when(F.col("label") != "", F.col("heading_level")))
    p = p.withColumn("grp", _running(F.coalesce(F.col("h") == 1, F.lit(False)), Window.partitionBy(*KEY).orderBy("idx"))).where("grp > 0")
    path, bare = F.coalesce("numbering_path", F.array().cast("array<string>")), F.regexp_replace("label", r"\.+\z", "")
    head = F.when(F.col("h").isin(1, 2, 3), F.struct("h", path.alias("path"), bare.alias("bare"), clean_heading(F.col("text")).alias("title")))
    rows = F.sort_array(F.collect_list(F.struct("idx", F.nullif("shown", F.lit("")).alias("shown"), head.alias("head"))))
    a = p.groupBy(*KEY, "grp").agg(rows.alias("rows")).withColumn("text", _shown(F.col("rows"))).where("text <> ''")
    level = lambda i: F.get("rows", i - 1)["head"]["h"]
    below = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: level(i).isin(2, 3))
    a = a.withColumn("below", below).withColumn("starts", F.filter("below", lambda i, j: (j == 0) | (level(i) == 2)))
    a = a.withColumn("first", F.get("rows", 0)["head"])
    a = a.withColumn("article_number", F.when(F.size("first.path") > 0, F.get("first.path", 0)).otherwise(F.col("first.bare"))).withColumn("article_title", F.col("first.title"))
    a = a.withColumn("clause_id", F.concat(F.lit("article_"), F.col("article_number"))).withColumn("chuong_so", F.lit("0")).withColumn("muc_so", F.lit("0"))
    return build_chunks(a.withColumn("khoan_items", _heading_clauses(F.col("rows"), F.col("starts"))))


def _shown(rows: Column) -> Column:
    return strip(F.array_join(F.transform(rows, lambda x: x["shown"]), "\n"))


def _spans(starts: Column, size: Column) -> Column:
    """From each start (from 1) up to the next one: s and n."""
    return F.transform(starts, lambda s, j: F.struct(s.alias("s"), (F.coalesce(F.get(starts, j + 1), size + 1) - s).alias("n")))


def _heading_clauses(rows: Column, starts: Column) -> Column:
    """The clauses in an article's rows (array of shown and, of headings, head), which begin at `starts`:
    khoan_items. A clause that begins with a sub-item bears the first two numbers of its path and no title."""
    none = F.array().cast(KHOAN["diem_items"].dataType)

    def sub_item(part: Column):
        of = lambda s: F.get(part, s["s"] - 1)["head"]
        return lambda s: F.struct(of(s)["bare"].alias("tieu_muc_number"), of(s)["title"].alias("title"), _shown(F.slice(part, s["s"], s["n"])).alias("text"))

    def sub_items(part: Column) -> Column:
        marks = F.filter(F.sequence(F.lit(1), F.size(part)), lambda i: F.get(part, i - 1)["head"]["h"] == 3)
        return _let(marks, lambda m: F.transform(_spans(m, F.size(part)), sub_item(part)))

    def item(part: Column) -> Column:
        head = F.get(part, 0)["head"]
        made = F.when(F.size(head["path"]) >= 2, F.concat_ws(".", F.slice(head["path"], 1, 2))).otherwise(head["bare"])
        return F.struct(
            F.when(head["h"] == 2, head["bare"]).otherwise(made).alias("khoan_number"), F.when(head["h"] == 2, head["title"]).otherwise("").alias("title"),
            _shown(part).alias("text"), none.alias("diem_items"), sub_items(part).alias("tieu_muc_items"),
        )

    return F.transform(_spans(starts, F.size(rows)), lambda s: _let(F.slice(rows, s["s"], s["n"]), item))


def prepared_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """paragraphs normalised, with headings (chunk_mode()): what chunk_prepared() reads. Beside
    display_text, text is only kept where it names a heading that is chunked by."""
    p = chunk_mode(normalize_paragraphs(paragraphs))
    named = F.col("headings") & F.col("heading_level").isNotNull() & (F.coalesce("numbering_label", F.lit("")) != "")
    return p.withColumn("text", F.when(named, F.col("text")))


def chunk_documents(paragraphs: DataFrame) -> DataFrame:
    """CHUNKS rows of paragraphs: by headings where a document has labelled ones, else by its text's lines."""
    return chunk_prepared(prepared_paragraphs(paragraphs))


def chunk_prepared(p: DataFrame) -> DataFrame:
    """chunk_documents() of prepared_paragraphs()."""
    plain = document_texts(p.where("not headings"))
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    texts = plain.select(*KEY, F.array_join(lines, "\n").alias("text")).where("text <> ''")
    return chunk_docx_headings(p.where("headings")).unionByName(chunk_texts(texts))
