"""Whole jobs: documents to chunks, and a corpus of pairs to results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.operators import chunking, grounding, index, matching, numbering, reporting, vectors
from clausediff.sources import files


def corpus_to_chunks(paragraphs: DataFrame, styles: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Chunks of paragraphs; raw DOCX paragraphs come with their styles and numbering levels. What is
    read several times, since documents with and without headings are chunked apart and headings
    make three levels, is numbered and normalised once and stored, apart by headings."""
    if styles is not None and levels is not None:
        paragraphs = numbering.numbered_paragraphs(paragraphs, styles, levels)
    return chunking.chunk_prepared(files.stored(chunking.prepared_paragraphs(paragraphs), "paragraphs", "headings"))


def pair_chunks(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunks with pair_id: of each pair (pair_id, doc_id_v1, doc_id_v2) the v1 chunks of the one and the v2 chunks of the other."""
    ends = pairs.select("pair_id", F.inline(F.array(F.struct(F.lit("v1").alias("version"), F.col("doc_id_v1").alias("doc_id")), F.struct(F.lit("v2").alias("version"), F.col("doc_id_v2").alias("doc_id")))))
    return chunks.join(ends, ["doc_id", "version"])


def matched_rows(chunks: DataFrame, encoder=None, k: int = 3, threshold: float = matching.THRESHOLD) -> DataFrame:
    """compared_articles() of chunks with pair_id; vectors are made once for each
    chunk, by an encoder once for each different text. The chunks are read several times, so they are
    stored as a table, which outlives an executor, and so are the matches: texts are shuffled once
    on their way to the table and once beside the matches, and vectors in between."""
    chunks = chunks.select("pair_id", "version", "chunk_id", "chunk_idx", "article_number", "article_title", "text")
    chunks = files.stored(index.with_articles(chunks.repartition("pair_id"), ("pair_id", "version")), "pair-chunks")
    articles = chunks.where("is_article").select("pair_id", "version", F.col("number").alias("article_number"), "article_title", F.col("text").alias("full_text"))
    left, right = (articles.where(F.col("version") == v).drop("version") for v in ("v1", "v2"))
    v2 = chunks.where("version = 'v2'")
    if encoder is None:  # hashed words cost less than a shuffle of texts
        v1, rows = vectors.embed(left, "full_text"), vectors.embed(v2)
    else:
        known = vectors.embed_once(left.select("pair_id", "article_number", F.col("full_text").alias("text"), F.lit("v1").alias("side")).unionByName(
            v2.select("pair_id", "article_number", "text", F.lit("v2").alias("side"), "chunk_id", "article_title"), allowMissingColumns=True), "text", encoder)
        v1, rows = known.where("side = 'v1'"), known.where("side = 'v2'")
    v1 = v1.select("pair_id", F.col("article_number").alias("left_no"), "embedding")
    rows = rows.select("pair_id", "chunk_id", "article_number", "article_title", "embedding")
    matches = files.stored(matching.greedy_match(vectors.article_candidates(v1, rows, k), threshold), "matches")
    # articles bear trimmed numbers, so only numbers with blanks around them are not among a pair's own
    return matching.compared_articles(left, right, matches, v2.where("article_number <> number").select("pair_id", "chunk_id", "text"))


def compare_corpus(chunks: DataFrame, encoder=None, responses: DataFrame | None = None, k: int = 3, threshold: float = matching.THRESHOLD) -> DataFrame:
    """Results of all pairs (chunks with pair_id): matched, compared and grounded; with a
    model's responses where they are given."""
    rows = matched_rows(chunks, encoder, k, threshold)
    return grounding.compare_rule_based(rows) if responses is None else grounding.apply_responses(rows, responses)


def reports(results: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report heads, summary table, citation table)."""
    return reporting.build_report(results, config), reporting.summary_table(results), reporting.citation_table(results)
