"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.llm import centroids, conversations, line_rules, mixing, ngram_join, suffix_dedup, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.line_rules import line_cleaned

    return line_cleaned(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.url_filter import judged

    return judged(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.quality import KEEP_SCORE, scored, trained

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, _table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.warc import archived

    index = archived(_table(spark, sf_dir, "pages"))
    return index.drop("archive", "record_offset", "range_id", "place")  # where a record lies, which SQL can't know


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.html_main import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.suffix_dedup import without_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(_table(spark, sf_dir, "conversations"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausediff.llm.licenses import license_spans

    return license_spans(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op5_suffix_dedup": op5_suffix_dedup,
    "op10_nearest": op10_nearest,
    "op2_warc": op2_warc,
    "op9_html": op9_html,
    "op4_quality": op4_quality,
    "op6_packing": op6_packing,
    "op1_ngram_join": op1_ngram_join,
    "op3_line_rules": op3_line_rules,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op11_centroids": op11_centroids,
    "op12_conversations": op12_conversations,
    "op13_licenses": op13_licenses,
}

ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op2_warc": warc.ORACLE,
    "op3_line_rules": line_rules.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_conversations": conversations.ORACLE,
}
