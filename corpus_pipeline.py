"""From raw documents to packed training sequences, in five stored stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents, in their
order; further columns, whatever their names, are carried along unchanged by all but the last.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that stages work with.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _own_columns_apart(stage):
    """A stage whose docs may have any further columns: while it runs they bear names that it
    doesn't use, so none is taken for one of its own, lost or overwritten."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in DOCUMENT else f"own_column_{i}_of_docs" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


@_own_columns_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score under 0.3 go. Null and empty texts have the
    model's bias for a score; repeated rows share their fate; further columns stay as they are."""
    from clausediff.llm.common import stored
    from clausediff.llm.quality import KEEP_SCORE, scored, trained

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = scored(docs, trained(docs, labels)).where(F.col("score") >= KEEP_SCORE)
    return stored(kept.select(*docs.columns), "kept", texts=True)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of each row's own; stored, so that it stays."""
    from clausediff.llm.common import stored

    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each id that repeats: the longest text. Rows with a null id all stay."""
    from clausediff.llm.common import small_or_not, stored

    twice = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.count():
        return docs
    rows = _numbered(docs)
    same = rows.join(small_or_not(twice), "doc_id", "left_semi").select("doc_id", "_row", (-F.coalesce(F.length("text"), F.lit(-1))).alias("n"), F.xxhash64("text").alias("h"))
    same = stored(same, "same")
    first = same.groupBy("doc_id").agg(F.min(F.struct("n", "h", "_row")).alias("first")).select("first._row")
    others = stored(same.select("_row").join(first, "_row", "left_anti"), "others")
    return rows.join(small_or_not(others), "_row", "left_anti").select(*docs.columns)


@_own_columns_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the document with the smallest id stays.

    Rows of one doc_id are one document, of which the row with the longest text is taken. Rows
    with a null doc_id can't be told apart by it: all of them stay."""
    from clausediff.llm.common import small_or_not, stored
    from clausediff.llm.ngram_join import ngram_jaccard_components

    docs = _one_row_each(docs)
    found = ngram_jaccard_components(docs).where("component_id <> doc_id")
    gone = stored(found.select("doc_id").distinct(), "gone")
    return docs.join(small_or_not(gone), "doc_id", "left_anti").select(*docs.columns)


@_own_columns_apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix dedup: bytes of 100-byte strings that also start earlier are cut out; a
    document of which nothing is left goes. Null and empty texts stay; rows of one doc_id don't
    cut each other, and a row with a null doc_id is left alone."""
    from clausediff.llm.common import stored
    from clausediff.llm.suffix_dedup import without_repeats

    out = without_repeats(docs)
    text = F.col("kept_text")
    out = out.where(F.col("text").isNull() | (F.length("text") == 0) | (F.length(text) > 0))
    out = out.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(text))
    return stored(out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns), "cut", texts=True)


@_own_columns_apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row as often as its source's target asks for, whether its doc_id is null,
    repeated or its own."""
    from clausediff.llm.common import small_or_not, stored
    from clausediff.llm.mixing import mixed

    rows = _numbered(docs)
    counts = mixed(rows.select("doc_id", "text", "source", "_row"), carry=("_row",)).where("copies > 0")
    counts = stored(counts.select("_row", F.col("copies").alias("_copies")), "copies")
    out = rows.join(small_or_not(counts), "_row").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*docs.columns)


@_own_columns_apart
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every token of every document placed in a sequence of 2048. A null or empty text
    is its end token alone, and each of several equal rows is packed."""
    from clausediff.llm.packing import packed

    return packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    from clausediff.llm.common import shared_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can't express the classifier, the packing's tokenizer and the suffix dedup.
ORACLE_SQL = None
