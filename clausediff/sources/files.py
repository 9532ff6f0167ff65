"""Input files: discovery, acceptance and identity."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
#: Splits that a task reads: a split holds few small files, as Spark counts 4 MB for opening each.
TASK_SPLITS = 16

_own_dirs: dict[str, str] = {}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def discover_files(spark: SparkSession, *folders: str) -> DataFrame:
    """path, modificationTime, length, content of the DOCX and PDF files in the folders, without change notes and lock files."""
    files = wanted(spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,pdf}").load(list(folders)))
    return files.coalesce(max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // TASK_SPLITS))


def wanted(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    return files.where(name.rlike(r"(?i)\.(docx|pdf)\z") & ~F.lower(name).contains("changes") & ~name.startswith("~$"))


def validate_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (path, length) with valid and reason ('extension', 'size' or null)."""
    reason = F.when(~F.lower("path").rlike(r"\.(docx|pdf)\z"), "extension").when(F.col("length") > max_bytes, "size")
    return files.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def file_identity(files: DataFrame) -> DataFrame:
    """files (path) with doc_id (the stem) and version; v1 is looked for first and is the default."""
    name = file_name(F.col("path"))
    low = F.lower(name)
    version = F.when(low.contains("v1"), "v1").when(low.contains("v2"), "v2").otherwise("v1")
    return files.withColumn("doc_id", F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")).withColumn("version", version)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share. Only in local
    mode, and where the setting is missing, a temporary folder stands in for it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if (app := spark.sparkContext.applicationId) not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="clausediff-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Of jobs that run inside, shuffle files go as soon as the job ends. Else they stay until the driver
    happens to collect its garbage, and those of all steps of a query lie on the disk together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df as a table in a new scratch folder, in folders by the columns `parts`, read again: cuts
    the lineage and outlives an executor. What was shuffled to make it is freed."""
    path = scratch(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
