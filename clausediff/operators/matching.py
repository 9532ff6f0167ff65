"""Matching the articles of two versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.text import article_sort_key, same_text

THRESHOLD = 0.50


def compare_by_clause(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """compare_versions() of the chunks of two tables (pair_id, clause_id, chunk_idx, article_title, text)."""
    names = ("pair_id", "clause_id", "chunk_idx", "article_title", "text")
    return compare_versions(v1.select(*names, F.lit("v1").alias("version")).unionByName(v2.select(*names, F.lit("v2").alias("version"))))


def compare_versions(chunks: DataFrame) -> DataFrame:
    """pair_id, clause_id, status, title, v1_text, v2_text over chunks of both versions (pair_id,
    version, clause_id, chunk_idx, article_title, text); of a clause's chunks the last one counts.
    Both versions meet in one grouping, so what makes the chunks runs once."""
    last = lambda v: F.max_by(F.struct("article_title", "text"), F.when(F.col("version") == v, F.col("chunk_idx")))
    alone = F.when(F.col("pair_id").isNull() | F.col("clause_id").isNull(), F.col("version"))  # nulls equal nothing
    both = chunks.where("version in ('v1', 'v2')").groupBy("pair_id", "clause_id", alone.alias("_alone")).agg(last("v1").alias("a"), last("v2").alias("b"))
    same = same_text(F.col("a.text"), F.col("b.text"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select(
        "pair_id", "clause_id", status.alias("status"),
        F.coalesce("b.article_title", "a.article_title").alias("title"), F.col("a.text").alias("v1_text"), F.col("b.text").alias("v2_text"),
    )


def greedy_match(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pair_id, left_no, right_no, chunk_id, title, similarity: each left article, in the
    order of article numbers, takes its nearest candidate that is still free and similar
    enough. A pair's candidates stream through one task in that order; what is held of a pair
    is the numbers taken. candidates: pair_id, left_no, rank, article_number, chunk_id,
    article_title, similarity; rows without a number take no part."""
    fit = candidates.where((F.col("article_number") != "") & (F.col("similarity") >= threshold))
    names = ("left_no", "article_number", "chunk_id", "article_title", "similarity")
    rows = fit.repartition("pair_id").sortWithinPartitions("pair_id", article_sort_key(F.col("left_no")), "left_no", "rank", "article_number")
    rows = rows.select("pair_id", *names)

    def free(batches):
        pair = left = start = object()
        used = set()
        for batch in batches:
            kept = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for i, (p, l, no) in enumerate(zip(*columns, strict=True)):
                if p != pair:
                    pair, left, used = p, start, set()
                if l != left and no not in used:
                    left = l
                    used.add(no)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    taken = rows.mapInArrow(free, rows.schema)
    return taken.select("pair_id", "left_no", F.col("article_number").alias("right_no"), "chunk_id", F.col("article_title").alias("title"), "similarity")


def matched_pairs(matches: DataFrame, left: DataFrame, right: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Matches with both texts. left, right: pair_id, article_number, article_title,
    full_text; chunks (chunk_id, text): the candidates' own texts, for numbers that the pair
    doesn't have."""
    l = left.select("pair_id", F.col("article_number").alias("left_no"), F.col("article_title").alias("l_title"), F.col("full_text").alias("v1_text"))
    r = right.select("pair_id", F.col("article_number").alias("right_no"), F.col("article_title").alias("r_title"), F.col("full_text").alias("r_text"))
    m = matches.join(l, ["pair_id", "left_no"]).join(r, ["pair_id", "right_no"], "left")
    m = m.join(chunks.select("chunk_id", F.col("text").alias("c_text")), "chunk_id", "left") if chunks is not None else m.withColumn("c_text", F.lit(None).cast("string"))
    title = F.coalesce("r_title", F.nullif("title", F.lit("")), "l_title")
    return m.select("pair_id", F.col("left_no").alias("article_number"), title.alias("article_title"), F.col("right_no").alias("matched_article_v2"), F.col("similarity").alias("match_score"), "v1_text", F.coalesce("r_text", "c_text").alias("v2_text"))


def _none(name: str):
    return F.lit(None).cast("string").alias(name)


def removed_articles(left: DataFrame, matches: DataFrame) -> DataFrame:
    gone = left.join(matches.select("pair_id", F.col("left_no").alias("article_number")), ["pair_id", "article_number"], "left_anti")
    return gone.select("pair_id", "article_number", "article_title", _none("matched_article_v2"), F.lit(0.0).alias("match_score"), F.col("full_text").alias("v1_text"), _none("v2_text"))


def added_articles(right: DataFrame, matches: DataFrame) -> DataFrame:
    new = right.join(matches.select("pair_id", F.col("right_no").alias("article_number")), ["pair_id", "article_number"], "left_anti")
    return new.select("pair_id", "article_number", "article_title", F.col("article_number").alias("matched_article_v2"), F.lit(0.0).alias("match_score"), _none("v1_text"), F.col("full_text").alias("v2_text"))


def compared_articles(left: DataFrame, right: DataFrame, matches: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """All articles of all pairs in order (pair_id, seq): the v1 articles, matched or removed, then the
    added ones; the rows of matched_pairs(), removed_articles() and added_articles(). left, right: one
    article of a number; matches take a number once; chunks: pair_id, chunk_id, text.

    Texts and matches are dealt by pair together, so one shuffle carries the texts. There each text meets
    its match by its own number (or chunk_id), and then the other side's text by the v1 number."""
    kind = "struct<no:string,right_no:string,title:string,similarity:double>"
    text = lambda df, side, key, title, body: df.select("pair_id", F.lit(side).alias("side"), F.col(key).alias("key"), F.struct(title.alias("title"), F.col(body).alias("text")).alias("own"), F.lit(None).cast(kind).alias("m"))
    match = F.struct(F.col("left_no").alias("no"), "right_no", "title", "similarity").cast(kind)
    own = f"struct<title:{left.schema['article_title'].dataType.simpleString()},text:string>"
    told = lambda side, key: matches.where("pair_id is not null").select("pair_id", F.lit(side).alias("side"), F.col(key).alias("key"), F.lit(None).cast(own).alias("own"), match.alias("m"))
    rows = text(left, "l", "article_number", F.col("article_title"), "full_text").unionByName(text(right, "r", "article_number", F.col("article_title"), "full_text"))
    rows = rows.unionByName(told("l", "left_no")).unionByName(told("r", "right_no"))
    if chunks is not None:
        rows = rows.unionByName(text(chunks, "c", "chunk_id", F.lit(None).cast("string"), "text")).unionByName(told("c", "chunk_id"))
    some = lambda c: F.first(c, ignorenulls=True)
    met = rows.repartition("pair_id").groupBy("pair_id", "side", "key").agg(some("own").alias("own"), some("m").alias("m"))
    met = met.where("own is not null and (side <> 'c' or m is not null)")
    part = F.when((F.col("side") == "r") & F.col("m").isNull(), 1).otherwise(0)
    met = met.withColumn("_part", part).withColumn("article_number", F.when((F.col("side") == "l") | F.col("m").isNull(), F.col("key")).otherwise(F.col("m.no")))
    side = lambda s: some(F.when(F.col("side") == s, F.col("own"))).alias(s)
    both = met.groupBy("pair_id", "_part", "article_number").agg(side("l"), side("r"), side("c"), some("m").alias("m")).where("_part = 1 or l is not null")
    seq = F.row_number().over(Window.partitionBy("pair_id").orderBy("_part", article_sort_key(F.col("article_number"))))
    title = F.when(F.col("m").isNull(), F.coalesce("l.title", "r.title")).otherwise(F.coalesce("r.title", F.nullif("m.title", F.lit("")), "l.title"))
    return both.select(
        "pair_id", "article_number", title.alias("article_title"), F.when(F.col("_part") == 1, F.col("article_number")).otherwise(F.col("m.right_no")).alias("matched_article_v2"),
        F.round(F.coalesce("m.similarity", F.lit(0.0)), 4).alias("match_score"), F.col("l.text").alias("v1_text"), F.coalesce("r.text", "c.text").alias("v2_text"), seq.alias("seq"),
    )
