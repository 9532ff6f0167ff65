"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.functions import predicates as P
from clausediff.functions import text as X
from clausediff.operators import chunking, diffing, grounding, index, matching, numbering, reporting, vectors
from clausediff.plans import fixture, jobs
from clausediff.plans.fixture import CHUNKS_SQL, PAIRS_SQL, RESULTS_SQL, V_SQL, with_sql
from clausediff.schemas import INDEX_METADATA
from clausediff.sources import docx, files, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_ARTICLES_SQL = "select doc_id, version, article_number, arg_max(article_title, chunk_idx) as article_title, arg_max(text, chunk_idx) as full_text, arg_max(chunk_id, chunk_idx) as chunk_id from chunks where trim(article_number) <> '' group by doc_id, version, article_number"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _texts(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("v1").alias("version"), "text")


def _files(spark, sf_dir) -> DataFrame:
    """A listing of files as the documents table would give one: path and length."""
    name = F.concat(F.lit("/in/"), F.col("source"), F.when(F.col("doc_id") % 13 == 0, "/~$").otherwise("/"), F.lit("doc_"), "doc_id",
                    F.when(F.col("doc_id") % 3 == 0, "_V2").when(F.col("doc_id") % 3 == 1, "_v1").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "_Changes").otherwise(""),
                    F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".pdf").otherwise(".docx"))
    return _documents(spark, sf_dir).select(name.alias("path"), (F.col("n_chars") * 1000).alias("length"))


_FILES_SQL = """with f as (select '/in/' || source || case when doc_id % 13 = 0 then '/~$' else '/' end || 'doc_' || doc_id || case doc_id % 3 when 0 then '_V2' when 1 then '_v1' else '' end
  || case when doc_id % 7 = 0 then '_Changes' else '' end || case doc_id % 5 when 0 then '.txt' when 1 then '.pdf' else '.docx' end as path, n_chars * 1000 as length from documents),
n as (select *, regexp_extract(path, '([^/]*)$', 1) as name from f)"""


# ---------------------------------------------------------------- sources


@query(_FILES_SQL + "\nselect path, length from n where regexp_matches(name, '(?i)[.](docx|pdf)$') and not contains(lower(name), 'changes') and not starts_with(name, '~$')")
def discover_files(spark, sf_dir):
    return files.wanted(_files(spark, sf_dir))


@query(_FILES_SQL + "\nselect path, length, case when not regexp_matches(lower(path), '[.](docx|pdf)$') then 'extension' when length > 10485760 then 'size' end as reason, regexp_matches(lower(path), '[.](docx|pdf)$') and length <= 10485760 as valid from n")
def validate_files(spark, sf_dir):
    return files.validate_files(_files(spark, sf_dir))


@query(_FILES_SQL + "\nselect path, length, regexp_replace(name, '[.][^.]*$', '') as doc_id, case when contains(lower(name), 'v1') then 'v1' when contains(lower(name), 'v2') then 'v2' else 'v1' end as version from n")
def file_identity(spark, sf_dir):
    return files.file_identity(_files(spark, sf_dir))


@query("select doc_id::varchar as doc_id, 'v1' as version, (i - 1)::int as idx, trim(s) as text, trim(s) as display_text from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents)) where trim(s) <> ''")
def text_paragraphs(spark, sf_dir):
    return lines.text_paragraphs(_texts(spark, sf_dir)).select("doc_id", "version", "idx", "text", "display_text")


@query(r"""select doc_id::varchar as doc_id, 'v1' as version, (i - 1)::int as idx, trim(s) as text, case (i - 1) % 10 when 0 then 'heading 1' when 5 then 'heading 2' else 'Normal' end as style_name,
  case (i - 1) % 10 when 0 then 'H1' when 5 then 'H2' else 'Normal' end as style_id, case when (i - 1) % 10 = 7 then 7 end::int as num_id, case when (i - 1) % 10 = 7 then 1 end::int as ilvl
from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)) as a from documents)) where trim(s) <> ''""")
def docx_paragraphs(spark, sf_dir):
    return docx.docx_tables(fixture.docx_files(spark, sf_dir))[0]


@query("""select 'hd_' || doc_id || case when doc_id % 2 = 0 then '_V1' else '_v2' end as doc_id, case when doc_id % 2 = 0 then 'v1' else 'v2' end as version,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))::bigint as paragraphs, true as valid from documents where doc_id % 13 <> 0 and doc_id % 7 <> 0 and doc_id % 5 <> 0""")
def read_folder(spark, sf_dir):
    """A folder of files: which are contracts, of which version, acceptable, and with how many paragraphs.

    Each file is read once; the driver holds the listing of one inbox at a time."""
    out = files.scratch(spark, "found")
    for inbox in fixture.docx_folders(spark, sf_dir, files.scratch(spark, "inbox")):
        found = files.file_identity(files.validate_files(files.discover_files(spark, f"{inbox}/*")))
        found = docx.paragraph_counts(found.select("doc_id", "version", "valid", F.when(F.col("valid"), F.col("content")).alias("content")))
        found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out).select("doc_id", "version", "paragraphs", "valid")


# ---------------------------------------------------------------- texts


@query(f"select doc_id, {_WS.format('text')} as ws from documents")
def normalize_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.normalize_ws(F.col("text")).alias("ws"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents")
def normalize_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.normalize_text(F.col("text")).alias("t"))


@query(r"select doc_id::varchar as doc_id, 'v1' as version, string_agg(t, chr(10) order by i) as text from (select doc_id, i, trim(regexp_replace(s, '[ \t]+', ' ', 'g')) as t from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents))) where t <> '' group by doc_id")
def normalize_document(spark, sf_dir):
    return numbering.normalize_document(lines.text_paragraphs(_texts(spark, sf_dir)))


@query(f"select doc_id, case when length(w) <= 240 then w else rtrim(substring(w, 1, 237)) || '...' end as short from (select doc_id, {_WS.format('text')} as w from documents)")
def shorten(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.shorten(F.col("text")).alias("short"))


@query(f"select doc_id, case when length(w) <= 300 then w else rtrim(substring(w, 1, 297)) || '...' end as excerpt from (select doc_id, {_WS.format('substring(text, greatest(0, doc_id % 500 - 120) + 1, greatest(0, least(length(text), doc_id % 500 + 160) - greatest(0, doc_id % 500 - 120))::int)')} as w from documents)")
def diff_excerpt(spark, sf_dir):
    at = (F.col("doc_id") % 500).cast("int")
    return _documents(spark, sf_dir).select("doc_id", X.diff_excerpt(F.col("text"), at, at + 40).alias("excerpt"))


@query(with_sql(V_SQL, r"select doc_id, version, ord as line_no, regexp_replace(trim(line), '[:\s]+$', '') as heading from v"))
def clean_heading(spark, sf_dir):
    return fixture.versioned_lines(spark, sf_dir).select("doc_id", "version", "line_no", X.clean_heading(F.col("line")).alias("heading"))


def _styles(spark, sf_dir):
    d = _documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Heading "), F.col("doc_id") % 7)).when(F.col("doc_id") % 4 == 1, "Normal")
    return d.select("doc_id", name.alias("style_name"), F.concat(F.lit("HEADING"), F.col("doc_id") % 5).alias("style_id"))


@query("select doc_id, case when doc_id % 4 = 0 then (doc_id % 7)::int else (doc_id % 5)::int end as level from documents")
def heading_level(spark, sf_dir):
    return _styles(spark, sf_dir).select("doc_id", X.heading_level(F.col("style_name"), F.col("style_id")).alias("level"))


@query("""with recursive n as (select doc_id, (doc_id % 3999 + 1)::int as x, case doc_id % 5 when 0 then 'upperRoman' when 1 then 'lowerRoman' when 2 then 'upperLetter' when 3 then 'lowerLetter' else 'decimal' end as f from documents),
r as (select *, repeat('M', x // 1000) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(x // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(x // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][x % 10 + 1] as roman from n),
b(doc_id, left_over, s) as (select doc_id, x, '' from n union all select doc_id, (left_over - 1) // 26, chr((65 + (left_over - 1) % 26)::int) || s from b where left_over > 0),
l as (select doc_id, s from b where left_over = 0)
select doc_id, x as n, f as num_fmt, case f when 'upperRoman' then roman when 'lowerRoman' then lower(roman) when 'upperLetter' then s when 'lowerLetter' then lower(s) else x::varchar end as shown from r join l using (doc_id)""")
def format_counter(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "decimal")))
    d = _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3999 + 1).cast("int").alias("n"), kinds[(F.col("doc_id") % 5).cast("int")].alias("num_fmt"))
    return d.withColumn("shown", X.format_counter(F.col("n"), F.col("num_fmt")))


@query(r"""with n as (select doc_id, case doc_id % 4 when 0 then doc_id::varchar when 1 then (doc_id % 30)::varchar || 'a' when 2 then 'II' || doc_id else (doc_id % 30)::varchar end as no from documents)
select doc_id, no, row_number() over (order by case when regexp_matches(no, '^[0-9]+[A-Za-z]*$') then 0 else 1 end, case when regexp_matches(no, '^[0-9]+[A-Za-z]*$') then regexp_extract(no, '^([0-9]+)', 1)::bigint end,
  case when regexp_matches(no, '^[0-9]+[A-Za-z]*$') then regexp_extract(no, '^[0-9]+(.*)', 1) else no end, doc_id)::int as place from n""")
def article_sort_key(spark, sf_dir):
    i = F.col("doc_id")
    no = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(i % 30, F.lit("a"))).when(i % 4 == 2, F.concat(F.lit("II"), i)).otherwise((i % 30).cast("string"))
    d = _documents(spark, sf_dir).select("doc_id", no.alias("no"))
    return index.placed(d, X.article_sort_key(F.col("no")), F.col("doc_id")).withColumn("place", F.col("place").cast("int"))


@query("select vec_id, d as distance, case when d is null then 0.0::double else 1.0::double / (1.0::double + d) end as similarity, 1.0::double - d as score from (select vec_id, case when vec_id % 9 = 0 then null else (vec_id % 100)::double / 50.0::double end as d from embeddings)")
def similarity(spark, sf_dir):
    d = F.when(F.col("vec_id") % 9 != 0, (F.col("vec_id") % 100).cast("double") / 50.0)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", d.alias("distance"))
    return e.select("vec_id", "distance", X.distance_similarity(F.col("distance")).alias("similarity"), X.search_score(F.col("distance")).alias("score"))


@query("select doc_id, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then 'lone' else 'changed' end as status from documents")
def parse_json_object(spark, sf_dir):
    i = F.col("doc_id")
    good = F.to_json(F.struct(F.lit("changed").alias("status"), F.col("text").alias("conclusion")))
    raw = F.when(i % 4 == 0, good).when(i % 4 == 1, F.concat(F.lit("Answer:\n"), good, F.lit("\ndone"))).when(i % 4 == 2, ' {"status": "lone"} ').otherwise("{broken")
    v = X.first_json_object(raw)
    return _documents(spark, sf_dir).select("doc_id", F.try_variant_get(v, "$.status", "string").alias("status"))


@query(with_sql(PAIRS_SQL, "select pair_id, clause_id, case when n1 = n2 then 'unchanged' when n1 <> '' and n2 <> '' then 'changed' when n1 <> '' then 'removed' else 'added' end as status from j"))
def status_from_texts(spark, sf_dir):
    r = matching.compare_versions(fixture.chunks(spark, sf_dir))
    return r.select("pair_id", "clause_id", X.status_from_texts(X.normalize_ws(F.col("v1_text")), X.normalize_ws(F.col("v2_text"))).alias("status"))


@query("select doc_id, case when doc_id % 4 = 0 then '-' else array_to_string(list_transform(range(1, doc_id % 4 + 1), lambda x: x::varchar), ', ') end as refs from documents")
def line_refs(spark, sf_dir):
    n = (F.col("doc_id") % 4).cast("int")
    rows = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return _documents(spark, sf_dir).select("doc_id", X.line_refs(rows).alias("refs"))


@query("select doc_id, case when doc_id % 3 = 0 then 'definition' else 'article' end as chunk_type from documents")
def chunk_type(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("GIẢI THÍCH từ ngữ "), "text")).otherwise(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", X.chunk_type(title).alias("chunk_type"))


# ---------------------------------------------------------------- lines

_D = r"(?:Điều|ĐIỀU|dieu|DIEU)\s+((?:\d+[A-Za-z]?|[IVXLCDM]+))[.:]?\s*(.*)$"


@query(with_sql(V_SQL, rf"""select doc_id, version, ord as line_no, line,
 case when regexp_matches(line, '(?i)^chương\s+[IVXLCDM\d]+') then 'chuong' when regexp_matches(line, '(?i)^mục\s+\d+') then 'muc' when regexp_matches(line, '^{_D}') then 'dieu'
      when regexp_matches(line, '^\d+[.)]') then 'khoan' when regexp_matches(line, '(?i)^[a-zđ][.)]') then 'diem' else 'text' end as kind,
 case when regexp_matches(line, '(?i)^chương\s+[IVXLCDM\d]+') then regexp_extract(line, '(?i)^chương\s+([IVXLCDM\d]+)', 1) when regexp_matches(line, '^{_D}') then regexp_extract(line, '^{_D}', 1)
      when regexp_matches(line, '^\d+[.)]') then regexp_extract(line, '^(\d+)', 1) end as number from (select doc_id, version, ord, trim(line) as line from v)"""))
def classify_lines(spark, sf_dir):
    return chunking.classify_lines(fixture.versioned_lines(spark, sf_dir)).drop("rest")


def _plain_lines(spark, sf_dir):
    return lines.text_lines(_texts(spark, sf_dir))


_L = "with l as (select doc_id::varchar as doc_id, (i - 1)::int as line_no, trim(s) as s from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents)) where trim(s) <> ''), p as (select *, not regexp_matches(s, '[.;,:]$') and not regexp_matches(s, '[\\d²³¹]') as possible, list_filter(string_split(regexp_replace(s, '\\s+', ' ', 'g'), ' '), lambda w: w <> '') as words from l)"
_UPPER = r"possible and len(words) between 2 and 14 and length(regexp_replace(s, '\PL', '', 'g')) > 0 and length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(s, '[^\p{L}]', '', 'g'))"
_TITLE = r"""possible and not regexp_matches(s, '["''()\-•*]') and len(ws) between 2 and 14 and len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}'))) >= greatest(2, len(ws) - 1)"""
_TW = r", t as (select *, list_filter(list_transform(words, lambda w: regexp_replace(w, '[^\p{L}\p{N}_À-ỹĐđ-]', '', 'g')), lambda w: w <> '') as ws from p)"


@query(_L + f"\nselect doc_id, line_no, {_UPPER} as is_heading from p")
def upper_heading(spark, sf_dir):
    return _plain_lines(spark, sf_dir).select("doc_id", "line_no", P.upper_heading(F.col("line")).alias("is_heading"))


@query(_L + _TW + f"\nselect doc_id, line_no, {_TITLE} as is_heading from t")
def title_heading(spark, sf_dir):
    return _plain_lines(spark, sf_dir).select("doc_id", "line_no", P.title_heading(F.col("line")).alias("is_heading"))


@query(_L + _TW + rf"""
select doc_id, line_no, not regexp_matches(s, '(?i)^(chương\s+[IVXLCDM\d]+|mục\s+\d+)') and not regexp_matches(s, '^{_D}') and not regexp_matches(s, '^\d+[.)]') and not regexp_matches(s, '(?i)^[a-zđ][.)]')
  and not regexp_matches(s, '^[(\-•*"“]') and length(s) <= 120 and (({_UPPER}) or ({_TITLE})) as is_heading from t""")
def contract_heading(spark, sf_dir):
    return _plain_lines(spark, sf_dir).select("doc_id", "line_no", P.contract_heading(F.col("line")).alias("is_heading"))


# ---------------------------------------------------------------- structure

_CHUNK_COLUMNS = "chunk_id, doc_id, version, chunk_idx, chunk_type, chuong_so, muc_so, clause_id, article_number, article_title, khoan_count, diem_count, tieu_muc_count, text, char_len"


def _numbered(spark, sf_dir):
    p = lines.text_paragraphs(_texts(spark, sf_dir)).select("doc_id", "version", "idx", "text")
    k = F.col("idx") % 5
    p = p.withColumn("style_id", F.when(k < 3, F.concat(F.lit("Heading"), k + 1)).otherwise("Body")).withColumn("style_name", F.when(k < 3, F.concat(F.lit("heading "), k + 1)).otherwise("Body"))
    p = p.withColumn("num_id", F.when(k < 3, (1 + F.col("doc_id").cast("long") % 2).cast("int"))).withColumn("ilvl", F.when(k < 3, k.cast("int")))
    rows = [(n, l, 1, f, ".".join(f"%{i + 1}" for i in range(l + 1)) + ("." if n == 1 else "")) for n, fs in ((1, ("decimal",) * 3), (2, ("upperRoman", "decimal", "lowerLetter"))) for l, f in enumerate(fs)]
    spec = spark.createDataFrame(rows, "num_id int, level int, start int, num_fmt string, lvl_text string")
    return p, p.select("doc_id", "version").distinct().crossJoin(F.broadcast(spec))  # six rows of numbering levels


@query("select doc_id::varchar as doc_id, (i - 1)::int as idx, case when (i - 1) % 5 < 3 then 1 end as num_id, case when (i - 1) % 5 < 3 then 0 end as ilvl from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents)) where trim(s) <> ''")
def style_numbering(spark, sf_dir):
    p, _ = _numbered(spark, sf_dir)
    bare = p.withColumn("num_id", F.lit(None).cast("int")).withColumn("ilvl", F.lit(None).cast("int"))
    chain = spark.createDataFrame([("Heading1", None, 1, 0), ("Heading2", "Heading1", None, 1), ("Heading3", "Heading2", None, None), ("Body", "Loop", None, None), ("Loop", "Body", None, None)], "style_id string, based_on string, num_id int, ilvl int")
    styles = p.select("doc_id", "version").distinct().crossJoin(F.broadcast(chain))  # five styles
    return numbering.style_numbering(bare, styles).select("doc_id", "idx", "num_id", "ilvl")


_NUMBERED_SQL = r"""with l as (select doc_id, (i - 1)::int as idx, trim(s) as text from (select doc_id, unnest(a) as s, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents)) where trim(s) <> ''),
p as (select doc_id, idx, text, case when idx % 5 < 3 then idx % 5 end as ilvl, 1 + doc_id % 2 as num_id from l),
r as (select *, sum((ilvl = 0)::int) over w as r1, sum((ilvl < 2)::int) over w as r2 from p where ilvl is not null window w as (partition by doc_id order by idx)),
c as (select *, r1 as c0, sum((ilvl = 1)::int) over (partition by doc_id, r1 order by idx) as c1, sum((ilvl = 2)::int) over (partition by doc_id, r2 order by idx) as c2 from r),
f as (select *, case when num_id = 1 then c0::varchar else repeat('M', (c0 // 1000)::int) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][((c0 // 100) % 10 + 1)::int] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][((c0 // 10) % 10 + 1)::int] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][(c0 % 10 + 1)::int] end as f0,
  case when num_id = 1 then c2::varchar else chr((96 + c2)::int) end as f2 from c),
n as (select *, case when c0 > 0 then f0 else '%1' end as s0, case when c1 > 0 then c1::varchar else '%2' end as s1, case when num_id = 1 then '.' else '' end as dot from f),
labels as (select doc_id, idx, case ilvl when 0 then s0 || dot when 1 then s0 || '.' || s1 || dot else s0 || '.' || s1 || '.' || f2 || dot end as numbering_label,
  array_to_string(list_filter([case when c0 > 0 then f0 end, case when ilvl >= 1 and c1 > 0 then c1::varchar end, case when ilvl = 2 then f2 end], lambda x: x is not null), '/') as path from n)"""


@query(_NUMBERED_SQL + "\nselect p.doc_id::varchar as doc_id, p.idx, numbering_label, coalesce(path, '') as path from p left join labels using (doc_id, idx)")
def numbering_labels(spark, sf_dir):
    p, levels = _numbered(spark, sf_dir)
    return numbering.numbering_labels(p, levels).select("doc_id", "idx", "numbering_label", F.array_join("numbering_path", "/").alias("path"))


@query(_NUMBERED_SQL + "\nselect p.doc_id::varchar as doc_id, p.idx, case when numbering_label is null then text else numbering_label || ' ' || text end as display_text from p left join labels using (doc_id, idx)")
def display_text(spark, sf_dir):
    p, levels = _numbered(spark, sf_dir)
    return numbering.display_text(numbering.numbering_labels(p, levels)).select("doc_id", "idx", "display_text")


@query(_NUMBERED_SQL + "\nselect doc_id::varchar as doc_id, coalesce(bool_or(ilvl = 0), false) as headings from p group by doc_id")
def chunk_mode(spark, sf_dir):
    p, levels = _numbered(spark, sf_dir)
    return chunking.chunk_mode(numbering.display_text(numbering.numbering_labels(p, levels))).select("doc_id", "headings").distinct()


@query(with_sql(CHUNKS_SQL, f"select {_CHUNK_COLUMNS} from chunks"))
def chunk_plain_text(spark, sf_dir):
    return fixture.chunks(spark, sf_dir).select(*_CHUNK_COLUMNS.split(", "))


@query(with_sql(CHUNKS_SQL, "select doc_id, version, count(*) as chunks, sum(length(text))::bigint as characters, min(chunk_id) as first_id, max(chunk_idx)::int as last_idx from chunks group by doc_id, version"))
def build_chunks(spark, sf_dir):
    by = fixture.chunks(spark, sf_dir).groupBy("doc_id", "version")
    return by.agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"), F.min("chunk_id").alias("first_id"), F.max("chunk_idx").alias("last_idx"))


@query(with_sql(CHUNKS_SQL, """select count(*) as written, count(*) as read, true as left_out, count(*) filter (char_len <= 30 or chunk_idx % 9 = 0) as short_text,
  count(*) filter (chunk_idx % 50 = 0) as invalid_type, count(*) filter (chunk_idx % 5 = 0) as missing_metadata from chunks"""))
def export_chunks(spark, sf_dir):
    i = F.col("chunk_idx")
    faulty = {"char_len": F.when(i % 9 == 0, 1).otherwise(F.col("char_len")), "chunk_type": F.when(i % 50 != 0, F.col("chunk_type")), "muc_so": F.when(i % 5 != 0, F.col("muc_so"))}
    return index.export_chunks(fixture.text_chunks(spark, sf_dir).withColumns(faulty), files.scratch(spark, "chunks"))


@query(with_sql(CHUNKS_SQL, "select chunk_id, doc_id, version, article_number, article_title, text from chunks"))
def load_chunks(spark, sf_dir):
    path = files.scratch(spark, "chunks")
    index.export_chunks(fixture.text_chunks(spark, sf_dir), path)
    return index.load_chunks(spark, path).select("chunk_id", "doc_id", "version", "article_number", "article_title", "text")


@query(_NUMBERED_SQL + r""", art as (select *, sum((ilvl = 0)::int) over (partition by doc_id order by idx rows between unbounded preceding and current row) as grp from p left join labels using (doc_id, idx)),
kh as (select *, sum((ilvl = 1 or (ilvl = 2 and not early))::int) over (partition by doc_id, grp order by idx rows between unbounded preceding and current row) as kg from
  (select *, coalesce(bool_or(ilvl in (1, 2)) over (partition by doc_id, grp order by idx rows between unbounded preceding and 1 preceding), false) as early from art where grp > 0))
select doc_id::varchar as doc_id, row_number() over (partition by doc_id order by grp)::int as chunk_idx, string_split(arg_min(path, idx), '/')[1] as article_number, max(coalesce(kg, 0))::int as khoan_count,
 sum(coalesce(ilvl = 2, false)::int)::int as tieu_muc_count, string_agg(case when numbering_label is null then text else numbering_label || ' ' || text end, chr(10) order by idx) as text from kh group by doc_id, grp""")
def chunk_docx_headings(spark, sf_dir):
    p, levels = _numbered(spark, sf_dir)
    c = jobs.corpus_to_chunks(numbering.display_text(numbering.numbering_labels(p, levels)))
    return c.select("doc_id", "chunk_idx", "article_number", "khoan_count", "tieu_muc_count", "text")


@query(with_sql(CHUNKS_SQL, r"select chunk_id, (generate_subscripts(a, 1) - 1)::int as item, '1' as khoan_number, unnest(a) as text from (select chunk_id, [regexp_replace(text, '^[^\n]*\n1\. ', '')] as a from chunks)"))
def khoan_items(spark, sf_dir):
    c = fixture.chunks(spark, sf_dir).select("chunk_id", F.posexplode("khoan_items").alias("item", "k"))
    return c.select("chunk_id", "item", "k.khoan_number", "k.text")


@query(with_sql(CHUNKS_SQL, f"select {_CHUNK_COLUMNS} from chunks"))
def corpus_to_chunks(spark, sf_dir):
    """From the bytes of DOCX files of both versions to chunks: parts, numbering, mode and splitting."""
    tables = docx.docx_tables(fixture.versioned_files(spark, sf_dir))
    return jobs.corpus_to_chunks(*tables).select(*_CHUNK_COLUMNS.split(", "))


# ---------------------------------------------------------------- index


def _index(spark, sf_dir):
    return fixture.chunks(spark, sf_dir)


def _stored_index(spark, sf_dir):
    path = files.scratch(spark, "index")
    index.save_index(files.stored(fixture.text_chunks(spark, sf_dir).select("chunk_id", "text", *INDEX_METADATA), "chunks"), path)
    return index.load_index(spark, path)


_IX = with_sql(CHUNKS_SQL + ", ix as (select * from chunks)", "")


# A word's place in the vector: 32-bit MurmurHash3 of its UTF-8 bytes with seed 42, modulo the dimensions.
_U32 = 4294967295


def _rotated(x: str, n: int) -> str:
    return f"(((({x}) << {n}) & {_U32}) | (({x}) >> {32 - n}))"


def _mixed(k: str) -> str:
    return f"(({_rotated(f'(({k}) * 3432918353 & {_U32})', 15)}) * 461845907 & {_U32})"


_HASH_SQL = f"""w as (select distinct unnest(words) as word from t),
wb as (select word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::ubigint) as b from w),
wk as (select word, len(b) as n, list_transform(range(len(b) // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) as blocks,
  coalesce(list_sum(list_transform(range(len(b) % 4), lambda i: b[(len(b) // 4) * 4 + i + 1] * (256 ** i)::ubigint)), 0)::ubigint as rest from wb),
h1 as (select word, n, rest, list_reduce(blocks, lambda h, k: ({_rotated(f"xor(h, {_mixed('k')})", 13)} * 5 + 3864292196) & {_U32}, 42::ubigint) as h from wk),
h2 as (select word, xor(case when n % 4 > 0 then xor(h, {_mixed('rest')}) else h end, n::ubigint) as h from h1),
h3 as (select word, xor(h, h >> 16) * 2246822507 & {_U32} as h from h2),
h4 as (select word, xor(h, h >> 13) * 3266489909 & {_U32} as h from h3),
h5 as (select word, xor(h, h >> 16)::bigint as h from h4),
places as (select word, (((case when h > 2147483647 then h - 4294967296 else h end) % {vectors.DIMENSIONS} + {vectors.DIMENSIONS}) % {vectors.DIMENSIONS})::int as place from h5)"""
_VECTORS_SQL = f""", t as (select chunk_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as words from chunks), {_HASH_SQL},
tf as (select chunk_id, place, count(*)::double as n from (select chunk_id, unnest(words) as word from t) join places using (word) group by chunk_id, place),
unit as (select *, sqrt(sum(n * n) over (partition by chunk_id)) as length from tf)"""


@query(with_sql(CHUNKS_SQL + _VECTORS_SQL, "select chunk_id, string_agg(place || ':' || round((n / length)::float::double * 10000)::int, ' ' order by place) as vector from unit group by chunk_id"))
def embed_chunks(spark, sf_dir):
    """Vectors as their non-zero places, in order: place:value in ten-thousandths."""
    v = vectors.embed(fixture.text_chunks(spark, sf_dir))
    places = F.transform("embedding", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), F.round(x.cast("double") * 10000).cast("int").cast("string"))))
    return v.select("chunk_id", F.array_join(F.array_compact(places), " ").alias("vector"))


@query(with_sql(CHUNKS_SQL, "select chunk_id, version, case when version = 'v1' and chunk_idx % 2 = 0 then 'new ' || text else text end as text from chunks"))
def index_upsert(spark, sf_dir):
    c = files.stored(fixture.text_chunks(spark, sf_dir).select("chunk_id", "doc_id", "version", "chunk_idx", "article_number", "text"), "chunks")
    path = files.scratch(spark, "index")
    index.save_index(c.where("version = 'v1'"), path)
    new = c.where("version = 'v2' or chunk_idx % 2 = 0").withColumn("text", F.when(F.col("version") == "v1", F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    twice = new.where("version = 'v1'").withColumn("text", F.lit("an earlier row of the batch"))
    index.merge_index(twice.unionByName(new), path)
    return index.load_index(spark, path).select("chunk_id", "version", "text")


@query(_IX + "select chunk_id, doc_id, article_number, text from ix where version = 'v1' and chuong_so = '1' order by chunk_id limit 200")
def filter_lookup(spark, sf_dir):
    return index.filter_lookup(_stored_index(spark, sf_dir), {"$and": [{"version": "v1"}, {"chuong_so": "1"}]}).select("chunk_id", "doc_id", "article_number", "text")


@query(_IX + "select chunk_id, doc_id, text from ix where article_number = '5'")
def lookup_article(spark, sf_dir):
    return index.lookup_article(_stored_index(spark, sf_dir), "5").select("chunk_id", "doc_id", "text")


@query(_IX + "select chunk_id, doc_id, article_title, row_number() over (partition by doc_id, version order by chunk_id)::int as place from ix where chuong_so = '1'")
def lookup_chapter(spark, sf_dir):
    return index.lookup_chapter(_stored_index(spark, sf_dir), "1").select("chunk_id", "doc_id", "article_title", "place")


@query(_IX + "select chunk_id, doc_id, version, article_title, chunk_id = (select min(chunk_id) from ix where article_number = '1') as shown, case when chunk_id = (select min(chunk_id) from ix where article_number = '1') then text end as text from ix where article_number = '1'")
def view_article(spark, sf_dir):
    return index.view_article(_stored_index(spark, sf_dir), "1")


@query(with_sql(CHUNKS_SQL, "select chunk_type, min(chunk_id) as chunk_id from chunks group by chunk_type"))
def sample_per_type(spark, sf_dir):
    return index.sample_per_type(fixture.chunks(spark, sf_dir)).select("chunk_type", "chunk_id")


@query(_IX + "select 'all' as scope, null::varchar as name, count(*) as n from ix union all select 'document', doc_id, count(*) from ix group by doc_id union all select 'chapter', chuong_so, count(*) from ix group by chuong_so")
def index_counts(spark, sf_dir):
    return index.index_counts(_index(spark, sf_dir))


@query(_IX + "select min(length(text))::int as shortest, max(length(text))::int as longest, (sum(length(text)) // count(*))::bigint as average from ix")
def chunk_lengths(spark, sf_dir):
    return index.chunk_lengths(_index(spark, sf_dir))


@query(_IX + "select doc_id, chuong_so, count(*) as articles from ix group by grouping sets ((doc_id, chuong_so), (doc_id))")
def structure_map(spark, sf_dir):
    return index.structure_map(_index(spark, sf_dir))


@query(with_sql(CHUNKS_SQL, "select doc_id, version, count(*) as chunk_count, count(*) filter (chunk_type = 'article') as article_count, count(*) filter (chunk_type = 'definition') as definition_count, count(*) filter (chunk_type = 'header') as header_count from chunks group by doc_id, version"))
def type_counts(spark, sf_dir):
    return index.type_counts(fixture.chunks(spark, sf_dir))


# Faults are added to whole tables: a document without chunks, a repeated first chunk and, of
# every fiftieth chunk, one more of an odd type.
_BAD = ", q as (select chunk_id, doc_id, clause_id, chuong_so, char_len, chunk_type from chunks union all select chunk_id, doc_id, clause_id, chuong_so, char_len, chunk_type from chunks where chunk_idx = 1 union all select 'odd ' || chunk_id, doc_id, clause_id, chuong_so, char_len, 'odd' from chunks where chunk_idx % 50 = 0), d as (select doc_id::varchar as doc_id from documents union all select 'empty ' || doc_id from documents)"
_QUALITY_SQL = _BAD + """, found as (select 'no_chunks' as "check", doc_id as name, count(*) as n from d where doc_id not in (select doc_id from q) group by doc_id
union all select 'duplicate_id', chunk_id, count(*) from q group by chunk_id having count(*) > 1
union all select 'short_text', clause_id, count(*) from q where char_len <= 30 group by clause_id
union all select 'invalid_type', chunk_id, count(*) from q where chunk_type not in ('article', 'definition', 'header') group by chunk_id
union all select 'chapters', chuong_so, count(*) from q where chuong_so is not null group by chuong_so)
"""


def _quality(spark, sf_dir):
    path = files.scratch(spark, "quality")
    fixture.chunks(spark, sf_dir).select("chunk_id", "doc_id", "clause_id", "chuong_so", "char_len", "chunk_type", "chunk_idx").write.parquet(path)
    c = spark.read.parquet(path)
    odd = c.where("chunk_idx % 50 = 0").withColumn("chunk_type", F.lit("odd")).withColumn("chunk_id", F.concat(F.lit("odd "), "chunk_id"))
    ids = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    docs = ids.unionByName(ids.select(F.concat(F.lit("empty "), "doc_id").alias("doc_id")))
    return index.chunk_quality(docs, c.unionByName(c.where("chunk_idx = 1")).unionByName(odd))


@query(with_sql(CHUNKS_SQL + _QUALITY_SQL, 'select "check", name, n from found'))
def chunk_quality(spark, sf_dir):
    return _quality(spark, sf_dir)


@query(with_sql(CHUNKS_SQL + _QUALITY_SQL, 'select "check", count(*) as names, sum(n)::bigint as n from found group by "check"'))
def quality_counts(spark, sf_dir):
    return index.quality_counts(_quality(spark, sf_dir))


@query(_IX + "select chunk_id, array_to_string(list_filter([case when chunk_idx % 5 = 0 then 'muc_so' end, case when chunk_idx % 7 = 0 then 'article_title' end], lambda x: x is not null), ',') as missing from ix where chunk_idx % 5 = 0 or chunk_idx % 7 = 0")
def missing_metadata(spark, sf_dir):
    c = fixture.text_chunks(spark, sf_dir).withColumn("muc_so", F.when(F.col("chunk_idx") % 5 != 0, F.col("muc_so"))).withColumn("article_title", F.when(F.col("chunk_idx") % 7 != 0, F.col("article_title")))
    return index.missing_metadata(c).select("chunk_id", F.array_join("missing", ",").alias("missing"))


@query(with_sql(CHUNKS_SQL, _ARTICLES_SQL))
def build_articles(spark, sf_dir):
    return index.build_articles(fixture.chunks(spark, sf_dir))


# ---------------------------------------------------------------- search and matching


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


_DIST = "list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


def _search_sql(k: int, where: str = "true") -> str:
    return f"select query_id, rank, chunk_id, round(distance, 9) as distance, round(1 - distance, 9) as score from (select q.vec_id::varchar as query_id, x.vec_id::varchar as chunk_id, {_DIST} as distance, row_number() over (partition by q.vec_id order by {_DIST}, x.vec_id::varchar)::int as rank from embeddings q, embeddings x where q.vec_id % 50 = 0 and {where}) where rank <= {k}"


def _searched(spark, sf_dir, k, where=None):
    v = _vectors(spark, sf_dir)
    found = vectors.semantic_search(v, v.where("vec_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), k, where)
    return found.select("query_id", "rank", "chunk_id", F.round("distance", 9).alias("distance"), F.round("score", 9).alias("score"))


@query(_search_sql(10))
def semantic_search(spark, sf_dir):
    return _searched(spark, sf_dir, 10)


@query(_search_sql(1))
def batch_search(spark, sf_dir):
    return _searched(spark, sf_dir, 1)


@query(_search_sql(3, "x.label = 3"))
def hybrid_search(spark, sf_dir):
    return _searched(spark, sf_dir, 3, {"label": 3})


def _candidates(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("pair_id", F.col("label"))
    left = v.where("vec_id % 2 = 0").select("pair_id", F.col("chunk_id").alias("left_no"), "embedding")
    right = v.where("vec_id % 2 = 1").select("pair_id", "chunk_id", F.col("chunk_id").alias("article_number"), F.concat(F.lit("t"), "chunk_id").alias("article_title"), "embedding")
    return vectors.article_candidates(left, right, 3)


_CAND = f"cand as (select * from (select q.label as pair_id, q.vec_id as left_id, x.vec_id as right_id, {_DIST} as distance, row_number() over (partition by q.vec_id order by {_DIST}, x.vec_id::varchar)::int as rank from embeddings q join embeddings x on q.label = x.label where q.vec_id % 2 = 0 and x.vec_id % 2 = 1) where rank <= 3)"
_GREEDY = f"""with recursive {_CAND}, ls as (select pair_id, left_id, row_number() over (partition by pair_id order by left_id) as n from (select distinct pair_id, left_id from cand)),
step(pair_id, n, used, left_id, pick) as (select pair_id, 0::bigint, []::bigint[], null::bigint, null::bigint from (select distinct pair_id from cand)
 union all select s.pair_id, l.n, case when p.pick is null then s.used else list_append(s.used, p.pick) end, l.left_id, p.pick
 from step s join ls l on l.pair_id = s.pair_id and l.n = s.n + 1 left join lateral (select arg_min(right_id, rank) as pick from cand c where c.pair_id = l.pair_id and c.left_id = l.left_id and 1 / (1 + c.distance) >= 0.36 and not list_contains(s.used, c.right_id)) p on true),
m as (select s.pair_id, s.left_id, s.pick as right_id, 1 / (1 + c.distance) as sim from step s join cand c on c.pair_id = s.pair_id and c.left_id = s.left_id and c.right_id = s.pick)"""


@query(f"with {_CAND} select pair_id, left_id::varchar as left_no, rank, right_id::varchar as chunk_id, round(1 / (1 + distance), 9) as similarity from cand")
def article_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("pair_id", "left_no", "rank", "chunk_id", F.round("similarity", 9).alias("similarity"))


def _matches(spark, sf_dir):
    return matching.greedy_match(_candidates(spark, sf_dir), 0.36)


@query(_GREEDY + " select pair_id, left_id::varchar as left_no, right_id::varchar as right_no, round(sim, 9) as similarity from m")
def greedy_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("pair_id", "left_no", "right_no", F.round("similarity", 9).alias("similarity"))


def _sides(spark, sf_dir):
    a = _vectors(spark, sf_dir).select(F.col("label").alias("pair_id"), F.col("chunk_id").alias("article_number"), F.concat(F.lit("t"), "chunk_id").alias("article_title"), F.concat(F.lit("text "), "vec_id").alias("full_text"), "vec_id")
    return a.where("vec_id % 2 = 0").drop("vec_id"), a.where("vec_id % 2 = 1").drop("vec_id")


@query(_GREEDY + " select pair_id, left_id::varchar as article_number, 't' || right_id as article_title, right_id::varchar as matched_article_v2, 'text ' || left_id as v1_text, 'text ' || right_id as v2_text from m")
def matched_pairs(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return matching.matched_pairs(_matches(spark, sf_dir), left, right).drop("match_score")


@query(_GREEDY + " select label as pair_id, vec_id::varchar as article_number, 'text ' || vec_id as v1_text, 0.0::double as match_score from embeddings where vec_id % 2 = 0 and vec_id not in (select left_id from m)")
def removed_articles(spark, sf_dir):
    return matching.removed_articles(_sides(spark, sf_dir)[0], _matches(spark, sf_dir)).select("pair_id", "article_number", "v1_text", "match_score")


@query(_GREEDY + " select label as pair_id, vec_id::varchar as article_number, vec_id::varchar as matched_article_v2, 'text ' || vec_id as v2_text, 0.0::double as match_score from embeddings where vec_id % 2 = 1 and vec_id not in (select right_id from m)")
def added_articles(spark, sf_dir):
    return matching.added_articles(_sides(spark, sf_dir)[1], _matches(spark, sf_dir)).select("pair_id", "article_number", "matched_article_v2", "v2_text", "match_score")


@query(with_sql(PAIRS_SQL, "select pair_id, clause_id, case when v1_text is null then 'added' when v2_text is null then 'removed' when n1 = n2 then 'unchanged' else 'modified' end as status, title, v1_text, v2_text from j"))
def compare_by_clause(spark, sf_dir):
    return matching.compare_versions(fixture.chunks(spark, sf_dir))


# The matching of articles by their vectors: the three nearest v2 chunks of each v1 article, then
# each article in order of number takes the nearest that is free and similar enough.
_MATCHED_SQL = CHUNKS_SQL + _VECTORS_SQL + f""",
dense as (select chunk_id, list(coalesce((n / length)::float::double, 0) order by place) as v from (select chunk_id, unnest(range({vectors.DIMENSIONS}))::int as place from chunks) left join unit using (chunk_id, place) group by chunk_id),
a1 as (select c.doc_id as pair_id, article_number as no, article_number::int as k, article_title as title, text, v from chunks c join dense using (chunk_id) where version = 'v1'),
a2 as (select c.doc_id as pair_id, article_number as no, article_number::int as k, article_title as title, text, chunk_id, v from chunks c join dense using (chunk_id) where version = 'v2'),
near as (select a1.pair_id, a1.no as left_no, a1.k, a2.no as right_no, chunk_id, list_sum(list_transform(list_zip(a1.v, a2.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from a1 join a2 using (pair_id)),
ranked as (select *, row_number() over (partition by pair_id, left_no order by d, chunk_id) as rank from near),
fit as (select * from ranked where rank <= 3 and 1 / (1 + d) >= 0.5),
ls as (select pair_id, left_no, row_number() over (partition by pair_id order by k, left_no) as n from (select distinct pair_id, left_no, k from fit)),
step(pair_id, n, used, left_no, pick) as (select pair_id, 0::bigint, []::varchar[], null::varchar, null::varchar from (select distinct pair_id from fit)
 union all select s.pair_id, l.n, case when p.pick is null then s.used else list_append(s.used, p.pick) end, l.left_no, p.pick
 from step s join ls l on l.pair_id = s.pair_id and l.n = s.n + 1 left join lateral (select arg_min(right_no, rank) as pick from fit c where c.pair_id = l.pair_id and c.left_no = l.left_no and not list_contains(s.used, c.right_no)) p on true),
m as (select s.pair_id, s.left_no, s.pick as right_no, round(1 / (1 + f.d), 4) as score from step s join fit f on f.pair_id = s.pair_id and f.left_no = s.left_no and f.right_no = s.pick),
compared as (select a1.pair_id, 0 as part, a1.k, a1.no as article_number, coalesce(a2.title, a1.title) as article_title, m.right_no as matched_article_v2, coalesce(m.score, 0)::double as match_score, a1.text as v1_text, a2.text as v2_text
   from a1 left join m on m.pair_id = a1.pair_id and m.left_no = a1.no left join a2 on a2.pair_id = m.pair_id and a2.no = m.right_no
 union all select a2.pair_id, 1, a2.k, a2.no, a2.title, a2.no, 0::double, null, a2.text from a2 where not exists (select 1 from m where m.pair_id = a2.pair_id and m.right_no = a2.no)),
numbered as (select *, row_number() over (partition by pair_id order by part, k)::int as seq, {_WS.format('v1_text')} as n1, {_WS.format('v2_text')} as n2 from compared)"""


@query("with recursive " + _MATCHED_SQL + " select pair_id, seq, article_number, article_title, matched_article_v2, match_score, v1_text, v2_text from numbered")
def compare_articles(spark, sf_dir):
    return jobs.matched_rows(fixture.text_chunks(spark, sf_dir).withColumn("pair_id", F.col("doc_id")))


# ---------------------------------------------------------------- differences and grounding


def _pairs(spark, sf_dir):
    r = fixture.results(spark, sf_dir)
    return r.select("pair_id", "seq", "article_number", "article_title", "matched_article_v2", "match_score", "v1_text", "v2_text")


# An article of the derived corpus has two lines, of which v2 lengthens the second: what differs
# is one block, and of the characters one insertion at the end.
_SIDES_SQL = """, d as (select *, case status when 'changed' then string_split(v1_text, chr(10))[2] else v1_text end as b, case status when 'changed' then string_split(v2_text, chr(10))[2] else v2_text end as a,
  case status when 'changed' then '2' when 'removed' then '1, 2' else '-' end as v1_lines, case status when 'changed' then '2' when 'added' then '1, 2' else '-' end as v2_lines from results)"""
_BLOCK_WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"


def _short_sql(text: str, most: int) -> str:
    return f"case when length({text}) <= {most} then {text} else rtrim(substring({text}, 1, {most} - 3)) || '...' end"


@query(with_sql(RESULTS_SQL + _SIDES_SQL, f"select pair_id, seq, 'B1' as block_id, status as tag, v1_lines, v2_lines, {_short_sql(_BLOCK_WS.format('b'), 900)} as before, {_short_sql(_BLOCK_WS.format('a'), 900)} as after from d where status <> 'unchanged'"))
def diff_blocks(spark, sf_dir):
    b = diffing.diff_blocks(_pairs(spark, sf_dir))
    return b.select("pair_id", "seq", "block_id", "tag", X.line_refs(F.col("v1_lines")).alias("v1_lines"), X.line_refs(F.col("v2_lines")).alias("v2_lines"), "before", "after")


@query(with_sql(RESULTS_SQL, f"""select pair_id, seq, 0 as item, case status when 'changed' then 'insert' else status end as tag,
  case status when 'changed' then {_short_sql("trim(substring(n1, greatest(0, length(n1) - 120) + 1))", 300)} else {_short_sql("n1", 300)} end as before,
  case status when 'changed' then {_short_sql("trim(substring(n2, greatest(0, length(n1) - 120) + 1))", 300)} else {_short_sql("n2", 300)} end as after from results where status <> 'unchanged'"""))
def extract_evidence(spark, sf_dir):
    return diffing.extract_evidence(_pairs(spark, sf_dir))


@query(with_sql(RESULTS_SQL, """select pair_id, seq, i as row, case status when 'removed' then 'delete' when 'added' then 'insert' when 'changed' then case when i = 0 then 'equal' else 'replace' end else 'equal' end as op,
  case when status = 'unchanged' or status = 'changed' and i = 0 then null else 'B1' end as block_id, case when status <> 'added' then i + 1 end as v1_no, case when status <> 'removed' then i + 1 end as v2_no,
  coalesce(string_split(v1_text, chr(10))[i + 1], '') as v1_text, coalesce(string_split(v2_text, chr(10))[i + 1], '') as v2_text
from results cross join (select unnest([0, 1])::int as i)"""))
def line_diff_rows(spark, sf_dir):
    return diffing.line_diff_rows(_pairs(spark, sf_dir))


@query(with_sql(RESULTS_SQL, "select pair_id, seq, case when status = 'unchanged' then 0 else 1 end::bigint as blocks, sha256(coalesce(v1_text, '')) as v1, sha256(coalesce(v2_text, '')) as v2 from results"))
def rebuilt_texts(spark, sf_dir):
    """Both texts of every pair, put together again from the rows of their difference."""
    r = diffing.rebuilt_texts(diffing.line_diff_rows(_pairs(spark, sf_dir)))
    return r.select("pair_id", "seq", "blocks", F.sha2("v1_text", 256).alias("v1"), F.sha2("v2_text", 256).alias("v2"))


@query(with_sql(RESULTS_SQL, "select pair_id, seq, coalesce(tag, 'changed') as tag, ev_before as before, ev_after as after from results where status <> 'unchanged'"))
def normalize_evidence(spark, sf_dir):
    r = fixture.results(spark, sf_dir)
    more = F.concat(F.array(F.struct(F.lit("x").alias("tag"), F.lit(" ").alias("before"), F.lit("").alias("after"))), F.col("evidence"))
    return r.select("pair_id", "seq", F.inline(grounding.normalize_evidence(more)))


_COLUMNS = ("pair_id", "seq", "article_number", "status", "conclusion", "grounded")


@query(with_sql(RESULTS_SQL, "select pair_id, seq, article_number, status, case status when 'unchanged' then '" + grounding.UNCHANGED + "' when 'added' then '" + grounding.DEFAULTS["added"] + "' when 'removed' then '" + grounding.DEFAULTS["removed"] + "' else '" + grounding.DEFAULTS["changed"] + "' end as conclusion, grounded from results"))
def ground_results(spark, sf_dir):
    r = fixture.results(spark, sf_dir).withColumn("raw_evidence", F.col("evidence")).withColumn("evidence", F.slice("evidence", 1, 0))
    return grounding.ground_results(r.withColumn("status", F.lit("unsure")).withColumn("conclusion", F.lit(" "))).select(*_COLUMNS)


@query(with_sql(RESULTS_SQL, "select pair_id, seq, article_number, status, conclusion, grounded from results"))
def compare_rule_based(spark, sf_dir):
    return grounding.compare_rule_based(_pairs(spark, sf_dir)).select(*_COLUMNS)


_TEXT = grounding.PROMPT.replace("'", "''")


@query(with_sql(RESULTS_SQL + _SIDES_SQL, f"""select pair_id, seq, '{_TEXT}' || chr(10) || 'article_number: ' || article_number || chr(10) || 'article_title: ' || article_title
  || chr(10) || chr(10) || 'Dieu v1:' || chr(10) || coalesce(nullif(n1, ''), '(khong co)') || chr(10) || chr(10) || 'Dieu v2:' || chr(10) || coalesce(nullif(n2, ''), '(khong co)')
  || chr(10) || chr(10) || 'DIFF_BLOCKS:' || chr(10) || '[' || to_json(struct_pack(block_id := 'B1', tag := status, v1_lines := case v1_lines when '2' then [2] when '-' then []::int[] else [1, 2] end,
    v2_lines := case v2_lines when '2' then [2] when '-' then []::int[] else [1, 2] end, before := {_short_sql(_short_sql(_BLOCK_WS.format('b'), 900), 600)}, after := {_short_sql(_short_sql(_BLOCK_WS.format('a'), 900), 600)})) || ']' as prompt
from d where status <> 'unchanged'"""))
def prompt_rows(spark, sf_dir):
    return grounding.prompt_rows(diffing.with_diffs(_pairs(spark, sf_dir)))


def _answered_pairs(spark, sf_dir) -> DataFrame:
    """_pairs() as a table, since a model's answers come from what has been written for it."""
    return files.stored(_pairs(spark, sf_dir), "pairs")


def _responses(rows: DataFrame) -> DataFrame:
    i = F.col("seq") + F.col("pair_id").cast("long")
    note = F.array(F.struct(F.lit("B1").alias("block_id"), F.lit("s").alias("summary"), F.lit("").alias("legal_effect"), F.lit("HIGH").alias("severity")), F.struct(F.lit("B99").alias("block_id"), F.lit("s").alias("summary"), F.lit("").alias("legal_effect"), F.lit("low").alias("severity")))
    good = F.to_json(F.struct(F.lit("changed").alias("status"), F.concat(F.lit("Model "), "article_number").alias("conclusion"), F.array().cast("array<string>").alias("evidence"), note.alias("diff_annotations")))
    raw = F.when(i % 5 == 0, good).when(i % 5 == 1, F.concat(F.lit("Here: "), good, F.lit(" ok"))).when(i % 5 == 2, "{}").when(i % 5 == 3, "no json")
    return rows.where(i % 5 != 4).select("pair_id", "seq", raw.alias("raw_response"))


@query(with_sql(RESULTS_SQL, """select pair_id, seq, article_number, case when u then 'changed' else status end as status, u as llm_used, case when status = 'unchanged' then 'texts_equal' when not u then '""" + grounding.BAD_REASON + """' end as fallback_reason,
 case when u then 'Model ' || article_number when status = 'unchanged' then '""" + grounding.UNCHANGED + """' else '""" + grounding.BAD_RESPONSE + """' end as conclusion, grounded from (select *, status <> 'unchanged' and (seq + pair_id::bigint) % 5 in (0, 1) as u from results)"""))
def apply_responses(spark, sf_dir):
    p = _answered_pairs(spark, sf_dir)
    return grounding.apply_responses(p, _responses(p)).select("pair_id", "seq", "article_number", "status", "llm_used", "fallback_reason", "conclusion", "grounded")


@query(with_sql(RESULTS_SQL + _SIDES_SQL, "select pair_id, seq, 'B1' as block_id, status as tag, v1_lines, v2_lines, 's' as summary, '' as legal_effect, 'high' as severity from d where status <> 'unchanged' and (seq + pair_id::bigint) % 5 in (0, 1)"))
def annotate_blocks(spark, sf_dir):
    p = _answered_pairs(spark, sf_dir)
    r = grounding.apply_responses(p, _responses(p)).select("pair_id", "seq", F.inline("diff_annotations"))
    return r.withColumn("v1_lines", X.line_refs(F.col("v1_lines"))).withColumn("v2_lines", X.line_refs(F.col("v2_lines")))


# ---------------------------------------------------------------- reports


@query(with_sql(RESULTS_SQL, "select pair_id, seq, article_number, status from results where status <> 'unchanged'"))
def change_list(spark, sf_dir):
    return reporting.change_list(fixture.results(spark, sf_dir)).select("pair_id", "seq", "article_number", "status")


@query(with_sql(RESULTS_SQL, "select pair_id, count(*)::bigint as total_articles, 0::bigint as llm_used_count, count(*)::bigint as fallback_count, count(*)::bigint as grounded_count, 0::bigint as ungrounded_count, count(*) filter (status = 'changed') as changed, 'Khong bang chung -> khong ket luan' as principle from results group by pair_id"))
def build_report(spark, sf_dir):
    r = reporting.build_report(fixture.results(spark, sf_dir))
    return r.withColumn("changed", F.coalesce(F.col("status_counts")["changed"], F.lit(0))).drop("status_counts")


@query(with_sql(RESULTS_SQL, "select pair_id, count(*) as total, count(*) filter (status = 'changed') as n_changed, count(*) filter (status = 'added') as n_added, count(*) filter (status = 'removed') as n_removed, count(*) filter (status = 'unchanged') as n_unchanged from results group by pair_id"))
def status_metrics(spark, sf_dir):
    return reporting.status_metrics(fixture.results(spark, sf_dir))


@query(with_sql(RESULTS_SQL, "select pair_id, status, count(*) as n, string_agg(article_number || ': ' || conclusion, '; ' order by seq) as conclusions, (case status when 'changed' then 1 when 'added' then 2 else 3 end)::int as place from results where status <> 'unchanged' group by pair_id, status"))
def key_summary(spark, sf_dir):
    return reporting.key_summary(fixture.results(spark, sf_dir)).withColumn("conclusions", F.array_join("conclusions", "; "))


@query(with_sql(RESULTS_SQL, "select pair_id, seq, article_number as dieu_v1, coalesce(matched_article_v2, '(khong tim thay)') as dieu_v2, match_score, article_title as tieu_de, status, grounded, conclusion as ket_luan from results"))
def summary_table(spark, sf_dir):
    return reporting.summary_table(fixture.results(spark, sf_dir))


@query(with_sql(RESULTS_SQL, "select pair_id, seq, 0 as item, article_number as dieu_v1, coalesce(matched_article_v2, '(khong tim thay)') as dieu_v2, tag as loai, ev_before as v1, ev_after as v2 from results where status <> 'unchanged'"))
def citation_table(spark, sf_dir):
    return reporting.citation_table(fixture.results(spark, sf_dir))


@query(with_sql(RESULTS_SQL, "select pair_id, seq, article_number, case status when 'unchanged' then 'Khong doi' when 'changed' then 'Sua doi' when 'added' then 'Them moi' else 'Xoa bo' end as label, case status when 'unchanged' then '🟢' when 'changed' then '🟡' when 'added' then '🔵' else '🔴' end as icon from results"))
def change_labels(spark, sf_dir):
    return reporting.change_labels(fixture.results(spark, sf_dir))


@query(with_sql(RESULTS_SQL, """select 'hd_' || pair_id || '_v1_vs_hd_' || pair_id || '_v2_report.json' as report_name, pair_id, sum(n)::bigint as total, sum(n)::int as listed, string_agg(status || '=' || n, ',' order by status) as statuses
from (select pair_id, status, count(*) as n from results group by pair_id, status) group by pair_id"""))
def write_reports(spark, sf_dir):
    r = files.stored(reporting.report_documents(fixture.results(spark, sf_dir)), "report-documents")  # frees what made them before they are dealt to folders
    file = lambda v: F.concat(F.lit("/in/hd_"), "pair_id", F.lit(f"_{v}.docx"))
    r = r.withColumn("file_v1", file("v1")).withColumn("file_v2", file("v2"))
    path = files.scratch(spark, "reports")
    reporting.write_reports(r.withColumn("report_name", reporting.report_name("file_v1", "file_v2")), path)
    return reporting.report_counts(reporting.read_reports(spark, path))


@query("with recursive " + _MATCHED_SQL + """ select pair_id, seq, article_number, article_title, matched_article_v2, match_score, v1_text, v2_text, status, grounded, llm_used,
  case when status = 'unchanged' then 'texts_equal' else '""" + grounding.NO_MODEL_REASON + """' end as fallback_reason, status <> 'unchanged' as quoted, status <> 'unchanged' as blocks,
  case when status = 'unchanged' then '""" + grounding.UNCHANGED + """' else '""" + grounding.NO_MODEL + """' end as conclusion
from (select *, true as grounded, false as llm_used, case when n1 = n2 then 'unchanged' when n1 <> '' and n2 <> '' then 'changed' when n1 <> '' then 'removed' else 'added' end as status from numbered)""")
def compare_corpus(spark, sf_dir):
    """Whole results; of the quotations and difference blocks, whether there are any (extract_evidence and diff_blocks show them)."""
    r = jobs.compare_corpus(fixture.text_chunks(spark, sf_dir).withColumn("pair_id", F.col("doc_id")))
    columns = ("pair_id", "seq", "article_number", "article_title", "matched_article_v2", "match_score", "v1_text", "v2_text", "status", "grounded", "llm_used", "fallback_reason", "conclusion")
    return r.select(*columns, (F.size("evidence") > 0).alias("quoted"), (F.size("diff_blocks") > 0).alias("blocks"))
