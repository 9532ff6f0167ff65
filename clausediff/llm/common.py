"""Helpers that the training-data operators share: stored intermediate tables, joins
against id lists of checked size, word hashing over Arrow buffers, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An id list of at most this many rows (about 16 MB) may be broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows with texts that a Python worker takes at a time.
TEXT_ROWS = 500

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Only in local mode, and only where
    the setting is missing (as in tests), a temporary folder stands in for it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="clausediff-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage, and
    survives the loss of an executor. texts: Python workers of this job get whole texts, so
    they get fewer rows at a time."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with text_batches(spark) if texts else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def text_batches(spark: SparkSession):
    """Jobs that start inside send at most TEXT_ROWS rows at a time to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it is known to have at most `limit` narrow rows; df must be
    cheap to count (a stored table). Else Spark's shuffled joins are left to do the work."""
    return F.broadcast(df) if df.count() <= limit else df


def most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """The rows of counted (a stored table with a count n) with the largest n, `most` at most:
    whole classes of about equal n, as many as fit. Each task sends a count for each class, of
    which there are a few hundred, and then the chosen rows; nothing is sorted in one task."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counted.groupBy(level.alias("level")).agg(F.count("*")).collect(), reverse=True)
    cut, total = 1 << 30, 0
    for at, size in sizes:
        if (total := total + size) > most:
            break
        cut = at
    return counted.where(level >= cut).toArrow()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: columns a, b of one orderable type (rows with nulls are dropped). Returns node,
    component (the smallest node reachable) for every node that isn't its own component.
    Each step is a join on the node, which Spark may split for a hot node, and a minimum
    that is combined before the shuffle; the rounds grow with the logarithm of a path.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before, old = None, []
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        discard(*old)  # what the tables of this round were made from
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = [e, large]
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)


# ---------------------------------------------------------------- words as hashes

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes that part words: U+0009 to U+000D and the space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def text_pieces(column: pa.Array, most: int = 1 << 18):
    """Yields (first row, bytes, offsets) for runs of rows of about `most` bytes at most; a
    longer text comes alone. Nulls count as empty. No text is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased on request."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * _powers(_BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_INV, len(data))[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbours in h (across rows too: callers drop those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each row the sorted distinct hashes of its k-word shingles; of a shorter text the
    whole sequence is one shingle; a row without words has none."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, True)
    grams = ngram_hashes(h, k)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield ngram_hashes(h[a:b], int(b - a)) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
