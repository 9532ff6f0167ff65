"""Reports over comparison results (pair_id, seq, article_number, status, …)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.functions.text import STATUS_ICONS, STATUS_LABELS, from_map, shorten
from clausediff.sources.files import freed_shuffles

NOT_FOUND = "(khong tim thay)"
PRINCIPLE = "Khong bang chung -> khong ket luan"
SHOWN = ("changed", "added", "removed")


def change_list(results: DataFrame) -> DataFrame:
    return results.where("status <> 'unchanged'")


def build_report(results: DataFrame, config: dict | None = None) -> DataFrame:
    """A row for each pair: the run's config, counts and status_counts."""
    by_status = results.groupBy("pair_id", "status").agg(F.count("*").alias("n"), F.count_if("grounded").alias("g"), F.count_if("llm_used").alias("m"))
    r = by_status.groupBy("pair_id").agg(
        F.sum("n").alias("total_articles"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"),
        F.sum("m").alias("llm_used_count"), (F.sum("n") - F.sum("m")).alias("fallback_count"),
        F.sum("g").alias("grounded_count"), (F.sum("n") - F.sum("g")).alias("ungrounded_count"),
    )
    return r.withColumns(_settings(config))


def _settings(config: dict | None) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in (config or {}).items()} | {"principle": F.lit(PRINCIPLE)}


def status_metrics(results: DataFrame) -> DataFrame:
    names = ("changed", "added", "removed", "unchanged")
    return results.groupBy("pair_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names])


def key_summary(results: DataFrame) -> DataFrame:
    """Changes by status in display order, with their conclusions in result order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "article_number", "conclusion"))), lambda x: F.concat_ws(": ", x["article_number"], x["conclusion"]))
    place = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("status"))
    out = results.where(F.col("status").isin(*SHOWN)).groupBy("pair_id", "status").agg(F.count("*").alias("n"), lines.alias("conclusions"))
    return out.withColumn("place", place.cast("int"))


def summary_table(results: DataFrame) -> DataFrame:
    found = F.coalesce(F.nullif("matched_article_v2", F.lit("")), F.lit(NOT_FOUND))
    return results.select(
        "pair_id", "seq", F.col("article_number").alias("dieu_v1"), found.alias("dieu_v2"), F.coalesce("match_score", F.lit(0.0)).alias("match_score"),
        F.coalesce("article_title", F.lit("")).alias("tieu_de"), "status", F.coalesce("grounded", F.lit(False)).alias("grounded"), shorten(F.col("conclusion"), 120).alias("ket_luan"),
    )


def citation_table(results: DataFrame) -> DataFrame:
    found = F.coalesce(F.nullif("matched_article_v2", F.lit("")), F.lit(NOT_FOUND))
    rows = change_list(results).select("pair_id", "seq", F.col("article_number").alias("dieu_v1"), found.alias("dieu_v2"), F.posexplode_outer("evidence").alias("item", "e"))
    return rows.select("pair_id", "seq", F.coalesce("item", F.lit(0)).alias("item"), "dieu_v1", "dieu_v2",
        F.when(F.col("e").isNull(), "No evidence").otherwise(F.coalesce("e.tag", F.lit("changed"))).alias("loai"),
        F.coalesce("e.before", F.lit("")).alias("v1"), F.coalesce("e.after", F.lit("")).alias("v2"))


def change_labels(results: DataFrame) -> DataFrame:
    return results.select("pair_id", "seq", "article_number", from_map(F.col("status"), STATUS_LABELS).alias("label"), from_map(F.col("status"), STATUS_ICONS).alias("icon"))


def report_name(v1: str, v2: str):
    stem = lambda c: F.regexp_replace(F.regexp_extract(F.col(c), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    return F.concat(stem(v1), F.lit("_vs_"), stem(v2), F.lit("_report.json"))


def report_documents(results: DataFrame, config: dict | None = None) -> DataFrame:
    """pair_id and report: the whole report of a pair as JSON text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("seq"), F.struct(*[c for c in results.columns if c != "pair_id"]).alias("r"))))
    body = results.groupBy("pair_id").agg(F.transform(rows, lambda x: x["r"]).alias("article_level_results"))
    # the head is counted from the same rows, so results are made and grouped once
    head = body.withColumns(_counts(F.col("article_level_results")) | _settings(config))
    names = [c for c in head.columns if c not in body.columns]
    return head.select("pair_id", F.to_json(F.struct(F.struct(*names).alias("config"), "article_level_results"), {"ignoreNullFields": "false"}).alias("report"))


def _counts(rows: Column) -> dict[str, Column]:
    """The counts of build_report() of an array of results."""
    status = F.transform(rows, lambda x: x["status"])
    of = lambda rows, is_: F.size(F.filter(rows, is_)).cast("long")
    total, model, grounded = F.size(rows).cast("long"), of(rows, lambda x: x["llm_used"]), of(rows, lambda x: x["grounded"])
    by_status = F.transform(F.array_sort(F.array_distinct(status)), lambda s: F.struct(s, of(status, lambda x: x.eqNullSafe(s))))
    return {
        "total_articles": total, "status_counts": F.map_from_entries(by_status), "llm_used_count": model, "fallback_count": total - model,
        "grounded_count": grounded, "ungrounded_count": total - grounded,
    }


def _prefix(name: str):
    return F.substring(F.md5(name), 1, 2)


def write_reports(reports: DataFrame, path: str) -> None:
    """Writes reports (pair_id, report_name, report) as JSON lines in gzip, a line for each report, in
    at most 256 folders by the hash of report_name. Spark's committer puts files in place once their
    task has succeeded, so a repeated task leaves nothing behind. Of a pair_id that repeats all
    reports are kept."""
    rows = reports.select("report_name", F.col("pair_id").cast("string"), "report").withColumn("prefix", _prefix("report_name"))
    rows = rows.repartition("prefix", F.pmod(F.xxhash64("report_name"), F.lit(8))).sortWithinPartitions("prefix", "report_name")
    with freed_shuffles(reports.sparkSession):
        rows.write.mode("overwrite").option("compression", "gzip").partitionBy("prefix").json(path)


def read_reports(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """report_name, pair_id, report of written reports; of the named ones only their folders are read."""
    rows = spark.read.schema("report_name string, pair_id string, report string, prefix string").json(path)
    if names:
        rows = rows.where(F.col("prefix").isin(*{hashlib.md5(n.encode()).hexdigest()[:2] for n in names}) & F.col("report_name").isin(*names))
    return rows.drop("prefix")


def report_counts(reports: DataFrame) -> DataFrame:
    """report_name, pair_id, total (as the report's head says), listed (articles in the report) and
    statuses (of those, by status), parsed from reports (report_name, pair_id, report)."""
    kind = "config struct<total_articles:long>, article_level_results array<struct<status:string>>"
    r = reports.withColumn("r", F.from_json("report", kind))
    status = F.transform("r.article_level_results", lambda x: x["status"])
    counted = F.array_sort(F.transform(F.array_distinct(status), lambda s: F.concat_ws("=", s, F.size(F.filter(status, lambda x: x == s)).cast("string"))))
    return r.select("report_name", "pair_id", F.col("r.config.total_articles").alias("total"), F.size(status).alias("listed"), F.array_join(counted, ",").alias("statuses"))
