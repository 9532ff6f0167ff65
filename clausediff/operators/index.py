"""The chunk index: articles, upsert, lookups, statistics and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausediff.schemas import CHUNKS_JSONL, INDEX_METADATA
from clausediff.sources.files import scratch, stored

CHUNK_TYPES = ("article", "definition", "header")
#: Folders and row group bytes of a stored index, and ids that are broadcast at most.
PARTS, GROUP_BYTES, BROADCAST_ROWS = 16, 8 << 20, 1_000_000


def build_articles(chunks: DataFrame, keys=("doc_id", "version")) -> DataFrame:
    """…keys, article_number, article_title, full_text, chunk_id: of a number's chunks the last one."""
    c = chunks.withColumn("article_number", F.trim(F.coalesce("article_number", F.lit("")))).where("article_number <> ''")
    last = c.groupBy(*keys, "article_number").agg(F.max_by(F.struct("article_title", F.col("text").alias("full_text"), "chunk_id"), "chunk_idx").alias("a"))
    return last.select(*keys, "article_number", "a.*")


def with_articles(chunks: DataFrame, keys=("doc_id", "version")) -> DataFrame:
    """chunks with number, their article_number without blanks around it, and is_article: whether a
    chunk is the one that build_articles() takes, the last of its number."""
    c = chunks.withColumn("number", F.trim(F.coalesce("article_number", F.lit(""))))
    last = F.row_number().over(Window.partitionBy(*keys, "number").orderBy(F.desc("chunk_idx"))) == 1
    return c.withColumn("is_article", (F.col("number") != "") & last)


def index_rows(embedded: DataFrame) -> DataFrame:
    return embedded.select("chunk_id", "text", *INDEX_METADATA, "embedding")


def latest(new: DataFrame, order: Column | None = None) -> DataFrame:
    """Of each chunk_id the row that was loaded last: with the largest `order` (a column of new),
    or else the last in the batch."""
    at = F.monotonically_increasing_id() if order is None else order
    return new.withColumn("_at", at).groupBy("chunk_id").agg(F.max_by(F.struct(*new.columns), "_at").alias("r")).select("r.*")


def index_upsert(old: DataFrame, new: DataFrame, replace_docs: bool = False, order: Column | None = None) -> DataFrame:
    """The index after new rows come in: of each chunk_id the new row. With replace_docs the
    old rows of incoming (doc_id, version) go first, so a shortened document leaves none."""
    if replace_docs:
        old = old.join(new.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_anti")
    new = latest(new, order)
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*old.columns).unionByName(new)


def part_of(doc_id: Column, parts: int) -> Column:
    """The part of a stored index that a document's chunks lie in, of both versions."""
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def _laid_out(rows: DataFrame, parts: int) -> DataFrame:
    """rows by ranges of part and article number: a large part is split over tasks, and each file
    has a narrow range of numbers."""
    rows = rows.withColumn("parts", F.lit(parts)).withColumn("part", part_of(F.col("doc_id"), parts))
    order = [c for c in ("part", "article_number", "doc_id", "chunk_id") if c in rows.columns]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _write(rows: DataFrame, path: str, group_bytes: int) -> None:
    out = rows.write.mode("overwrite").partitionBy("parts", "part").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", group_bytes)
    for c in ("doc_id", "chunk_id"):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def save_index(index: DataFrame, path: str, parts: int = PARTS, group_bytes: int = GROUP_BYTES) -> None:
    """Stores an index that lookups prune and merge_index() changes in place.

    A chunk lies in the part of its doc_id's hash, which is a folder. Files are sorted by article
    number, so row groups have narrow ranges of it in their statistics; doc_id and chunk_id have
    bloom filters. parts: about one for each 256 MB that the index is to hold. The rows are read twice,
    once to sample the ranges, so rows that are costly to make should be stored first."""
    _write(_laid_out(index, parts), path, group_bytes)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index, with `parts` and `part` after its own columns."""
    return spark.read.parquet(path)


def merge_index(new: DataFrame, path: str, replace_docs: bool = False, order: Column | None = None, group_bytes: int = GROUP_BYTES) -> int:
    """Puts new rows into a stored index in place of those with their chunk_id; returns how many.

    Only the parts of the batch's documents are read and rewritten (dynamic partition
    overwrite); of the old index only ids are compared, with the batch's ids as a broadcast of
    counted size, so old vectors stay in their tasks. A larger batch is met by a shuffled join. Of
    equal ids in the batch the last wins (see latest()). With replace_docs all old rows of the
    batch's (doc_id, version) go. A chunk_id belongs to one doc_id. Merging a batch again changes
    nothing, so a job that was cut off is simply run again."""
    spark = new.sparkSession
    old = load_index(spark, path)
    parts = old.select("parts").first()
    parts = parts[0] if parts else PARTS
    new = stored(_laid_out(latest(new, order), parts), "batch")
    touched = [r.part for r in new.select("part").distinct().collect()]  # parts at most
    if not touched:
        return 0
    count = new.count()
    ids = new.select(*(["doc_id", "version"] if replace_docs else ["chunk_id"])).distinct()
    stay = old.where(F.col("part").isin(touched)).join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids, ids.columns, "left_anti")
    if replace_docs:
        again = new.select("chunk_id")
        stay = stay.join(F.broadcast(again) if count <= BROADCAST_ROWS else again, "chunk_id", "left_anti")
    _write(stay.select(*old.columns).unionByName(new), path, group_bytes)
    return count


def where_all(where: dict | None) -> Column:
    """{column: value} or {'$and': [{column: value}, …]} as a condition."""
    parts = (where or {}).get("$and", [where] if where else [])
    return reduce(Column.__and__, [F.col(k) == v for part in parts for k, v in part.items()], F.lit(True))


def filter_lookup(index: DataFrame, where: dict | None = None, limit: int = 200) -> DataFrame:
    return index.where(where_all(where)).orderBy("chunk_id").limit(limit)


def in_part(index: DataFrame, doc_id: str) -> Column:
    """Whether a row of a stored index lies in a document's part; Spark prunes the other folders."""
    parts = index.select("parts").first()
    part = index.sparkSession.range(1).select(part_of(F.lit(doc_id), parts[0] if parts else 1)).first()[0]
    return F.col("part") == part


def lookup_article(index: DataFrame, article_number: str, doc_id: str | None = None) -> DataFrame:
    rows = index.where(where_all({"$and": [{"article_number": article_number}, *([{"doc_id": doc_id}] if doc_id else [])]}))
    return rows.where(in_part(index, doc_id)) if doc_id and "part" in index.columns else rows


def lookup_chapter(index: DataFrame, chuong_so: str) -> DataFrame:
    """A chapter's articles with their place in the listing of their document version."""
    place = F.row_number().over(Window.partitionBy("doc_id", "version").orderBy("chunk_id"))
    return index.where(F.col("chuong_so") == chuong_so).withColumn("place", place)


def view_article(index: DataFrame, article_number: str) -> DataFrame:
    """The rows of an article number; text only for the first one."""
    hits = index.where(F.col("article_number") == article_number)
    first = hits.agg(F.min("chunk_id").alias("_first"))
    hits = hits.crossJoin(F.broadcast(first)).withColumn("shown", F.col("chunk_id") == F.col("_first"))  # first is one row
    return hits.select("chunk_id", "doc_id", "version", "article_title", "shown", F.when(F.col("shown"), F.col("text")).alias("text"))


def sample_per_type(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_type").orderBy("chunk_id"))).where("_n = 1").drop("_n")


def index_counts(index: DataFrame) -> DataFrame:
    """scope (all, document, chapter), name and n."""
    chapter = F.coalesce("chuong_so", F.lit("0"))
    sets = index.withColumn("chapter", chapter).groupingSets([[], ["doc_id"], ["chapter"]], "doc_id", "chapter")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "document").otherwise("chapter")
    return out.select(scope.alias("scope"), F.coalesce("doc_id", "chapter").alias("name"), "n")


def chunk_lengths(index: DataFrame) -> DataFrame:
    n = F.length("text")
    return index.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.sum(n) / F.count("*")).alias("average"))


def structure_map(index: DataFrame) -> DataFrame:
    """Articles of each chapter of each document; chuong_so is null in a document's total."""
    c = index.withColumn("chuong_so", F.coalesce("chuong_so", F.lit("0")))
    out = c.rollup("doc_id", "chuong_so").agg(F.count("*").alias("articles"), F.grouping_id().alias("g"))
    return out.where("g < 3").drop("g")


def type_counts(chunks: DataFrame) -> DataFrame:
    count = [F.count_if(F.col("chunk_type") == t).alias(f"{t}_count") for t in CHUNK_TYPES]
    return chunks.groupBy("doc_id", "version").agg(F.count("*").alias("chunk_count"), *count)


def chunk_quality(docs: DataFrame, chunks: DataFrame, short: int = 30) -> DataFrame:
    """check, name and n, a row for each name and how many rows bear it: documents (doc_id)
    without chunk, repeated ids, short texts, wrong types; and the chapters."""
    fault = lambda check, name: F.struct(F.lit(check).alias("check"), F.col(name).alias("name"))
    found = F.array_compact(F.array(
        F.when(F.col("char_len") <= short, fault("short_text", "clause_id")),
        F.when(~F.coalesce(F.col("chunk_type").isin(*CHUNK_TYPES), F.lit(False)), fault("invalid_type", "chunk_id")),
        F.when(F.col("chuong_so").isNotNull(), fault("chapters", "chuong_so")),
    ))
    counted = chunks.select(F.inline(found)).groupBy("check", "name").agg(F.count("*").alias("n"))
    twice = chunks.groupBy(F.lit("duplicate_id").alias("check"), F.col("chunk_id").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    empty = docs.select(F.col("doc_id").cast("string")).join(chunks, "doc_id", "left_anti")
    empty = empty.groupBy(F.lit("no_chunks").alias("check"), F.col("doc_id").alias("name")).agg(F.count("*").alias("n"))
    return counted.unionByName(twice).unionByName(empty)


def quality_counts(found: DataFrame) -> DataFrame:
    """check, names and n: how many names and rows chunk_quality() found."""
    return found.groupBy("check").agg(F.count("*").alias("names"), F.sum("n").alias("n"))


def placed(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order that leaves no ties. Rows are sorted in ranges,
    stored, and numbered inside a range; only one count a range is summed in one task."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges.write.parquet(path)
    part = F.shiftright("_at", 33)
    numbered = spark.read.schema(ranges.schema).parquet(path).withColumn("_range", part)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = numbered.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at") - F.shiftleft("_range", 33) + 1
    return numbered.join(F.broadcast(starts), "_range").select(*rows.columns, place.alias(name))  # starts: one row a range


def missing_metadata(index: DataFrame, required=INDEX_METADATA) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return index.select("chunk_id", missing.alias("missing")).where(F.size("missing") > 0)


def export_metrics(short: int = 30, required=INDEX_METADATA) -> list[Column]:
    """What an export counts while it writes: rows, short texts, wrong types and rows that lack metadata."""
    wrong = ~F.coalesce(F.col("chunk_type").isin(*CHUNK_TYPES), F.lit(False))
    lacks = reduce(Column.__or__, [F.col(c).isNull() for c in required])
    return [F.count(F.lit(1)).alias("written"), F.count_if(F.col("char_len") <= short).alias("short_text"), F.count_if(wrong).alias("invalid_type"), F.count_if(lacks).alias("missing_metadata")]


def export_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Writes chunks as JSON lines without chunk_type and clause_id, reads them back and
    returns written, read and left_out (whether those columns are absent), with short_text,
    invalid_type and missing_metadata. Those counts and `written` are observed in the tasks that
    write, so the chunks are made and read once."""
    seen = Observation("export")
    chunks.observe(seen, *export_metrics()).select(*CHUNKS_JSONL.names).write.mode("overwrite").json(path)
    spark = chunks.sparkSession
    back = spark.read.json(path, schema=T.StructType([*CHUNKS_JSONL.fields, T.StructField("chunk_type", T.StringType()), T.StructField("clause_id", T.StringType())]))
    absent = F.coalesce(F.bool_and(F.col("chunk_type").isNull() & F.col("clause_id").isNull()), F.lit(True))
    counts = [F.lit(n).cast("long").alias(c) for c, n in seen.get.items()]
    return back.agg(F.count("chunk_id").alias("read"), absent.alias("left_out")).select(counts[0], "read", "left_out", *counts[1:])


def load_chunks(spark, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS_JSONL).json(path)
