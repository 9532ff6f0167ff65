"""Centroid clustering over a VA-file: exact rounds of k-means on integer vectors, in which
most distances are never computed.

Each vector is compressed once to a few bits per dimension: the cell of its component between
quantiles that are taken over all vectors. Beside its cells lies its squared length around the
middle of the data. For given centroids, lookup tables (dimension, cell) -> least and largest
product give an interval of every vector's distance to every centroid, from the cells alone.
A centroid whose interval starts beyond the end of another's can't be the nearest. Only where
intervals overlap, or where the nearest centroid is another than in the round before, is the
whole vector fetched: by a join on row numbers with a table bucketed by them, which shuffles what
is left of the cells (a row number and a bit for each centroid), never the vectors. What it then adds to or takes from the centroids' exact sums leaves each task as one
row a centroid, so the driver holds k centroids and nothing that grows with the data.

Edges: vectors that are null, of another length, or hold null or non-finite components take no
part. A null vec_id is kept, and comes last as a first centroid; equal ids are apart vectors,
and where the ids of first centroids tie, the smaller vector comes first. Fewer vectors than k
make fewer centroids, none an empty result. Integers beyond +-2^26 (components beyond +-262144)
count as that bound, so that a distance fits a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.llm.common import shared_dir, stored

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Bits of a cell.
BITS = 6
#: Integers are held within this.
BOUND = 1 << 26
#: Vectors of one bucket.
BUCKET_ROWS = 200_000
#: Vectors that a lookup takes at a time.
BLOCK = 4096

RESULT = "vec_id long, cluster int, distance long"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the usable vectors as integers floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(
        "embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    )
    return vectors.where((F.size("embedding") == dims) & fine).select("vec_id", v.alias("v"))


def quantiles(kept: DataFrame, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The middle of each dimension, and the first and last integers of each of its cells."""
    cells = 1 << bits
    at = [i / cells for i in range(1, cells)]
    rows = (
        kept.select(F.posexplode("v").alias("dim", "x")).groupBy("dim")
        .agg(F.percentile_approx("x", at, 2000).alias("q"), F.min("x").alias("least"), F.max("x").alias("most")).orderBy("dim").collect()
    )
    ranges = []
    for r in rows:
        starts = np.unique(np.array([r.least, *(q for q in r.q if q > r.least)], np.int64))
        ranges.append(np.stack([starts, np.append(starts[1:] - 1, r.most)]))
    return np.array([int(r.q[cells // 2 - 1]) for r in rows], np.int64), ranges


def packed_cells(x: np.ndarray, ranges: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bytes for each vector: its cells, `bits` bits each."""
    cells = np.stack([np.searchsorted(r[0], x[:, d], "right") - 1 for d, r in enumerate(ranges)], 1)
    return np.packbits(((cells[:, :, None] >> np.arange(bits)) & 1).astype(bool).reshape(len(x), len(ranges) * bits), axis=1)


def unpacked_cells(packed: np.ndarray, dims: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(packed, axis=1)[:, : dims * bits].reshape(len(packed), dims, bits)
    return flat @ (1 << np.arange(bits))


class Lookup:
    """For given centroids: intervals of squared distances from cells, and which centroids are left."""

    def __init__(self, centroids: np.ndarray, middle: np.ndarray, ranges: list[np.ndarray], bits: int):
        y = centroids - middle
        self.bits, self.squares = bits, (y * y).sum(1)
        self.low, self.high = [], []
        for d, (first, last) in enumerate(ranges):
            a, b = -2 * first[:, None] * y[:, d] + 2 * middle[d] * y[:, d], -2 * last[:, None] * y[:, d] + 2 * middle[d] * y[:, d]
            self.low.append(np.minimum(a, b))
            self.high.append(np.maximum(a, b))

    def intervals(self, cells: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of each row to each centroid."""
        low = np.broadcast_to(self.squares, (len(cells), len(self.squares))) + length[:, None]
        high = low.copy()
        for d in range(cells.shape[1]):
            low += self.low[d][cells[:, d]]
            high += self.high[d][cells[:, d]]
        return low, high

    def left(self, cells: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each row, which centroids may be the nearest."""
        low, high = self.intervals(cells, length)
        return low <= high.min(1, keepdims=True)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """The rows of a binary or list column, all of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _settler(before: Lookup | None, now: Lookup, dims: int, bits: int, every: bool):
    """A column function (cells, length) -> the bits of the centroids left before and now; null
    where both rounds leave one and the same centroid, unless every row is asked for."""

    @F.arrow_udf("binary")
    def settle(cells: pa.Array, length: pa.Array) -> pa.Array:
        length, out = length.to_numpy(zero_copy_only=False), []
        packed = _matrix(cells, (dims * bits + 7) // 8, np.uint8)
        for at in range(0, len(packed), BLOCK):
            c, n = unpacked_cells(packed[at : at + BLOCK], dims, bits), length[at : at + BLOCK]
            new = now.left(c, n)
            old = before.left(c, n) if before else new
            same = (new.sum(1) == 1) & (new == old).all(1) & (not every)
            masks = np.packbits(np.concatenate([old, new], 1), axis=1)
            out += [None if s else m.tobytes() for s, m in zip(same, masks)]
        return pa.array(out, pa.binary())

    return settle.asNondeterministic()  # or a filter on its result would make Spark work it out twice


def nearest_of(v: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid and its squared distance, in whole numbers, among those left."""
    rows, which = np.nonzero(left)
    d = v[rows] - centroids[which]
    found = np.full(left.shape, np.iinfo(np.int64).max)
    found[rows, which] = (d * d).sum(1)
    best = found.argmin(1)
    return best, found[np.arange(len(v)), best]


def _masks(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unpackbits(_matrix(column, (2 * k + 7) // 8, np.uint8), axis=1)[:, : 2 * k] == 1
    return both[:, :k], both[:, k:]


def _changes(before: np.ndarray | None, now: np.ndarray):
    """What each centroid's sum and count gain and lose between two rounds; one row a centroid and task."""

    def changed(batches):
        k, dims = now.shape
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            masks, vectors = batch.column("left"), batch.column("v")
            for at in range(0, len(batch), BLOCK):
                v = _matrix(vectors.slice(at, BLOCK), dims, np.int64)
                old, new = _masks(masks.slice(at, BLOCK), k)
                to = nearest_of(v, now, new)[0]
                np.add.at(sums, to, v)
                np.add.at(counts, to, 1)
                if before is not None:
                    of = nearest_of(v, before, old)[0]
                    np.subtract.at(sums, of, v)
                    np.subtract.at(counts, of, 1)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "n": counts, "s": pa.array(list(sums), pa.list_(pa.int64()))})

    return changed


def _ends(now: np.ndarray):
    def ended(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                best, distance = nearest_of(_matrix(part.column("v"), now.shape[1], np.int64), now, _masks(part.column("left"), len(now))[1])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return ended


@contextmanager
def bucketed_scans(spark: SparkSession):
    """Jobs that start inside read bucketed tables by their buckets, also where Spark's own rule
    doesn't see the use of it, because Python stands between a scan and its join."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(df: DataFrame, n: int, name: str) -> tuple[str, DataFrame]:
    """df as a table bucketed by row, with one file a bucket."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(n, "row").write.bucketBy(n, "row").format("parquet").option("compression", "zstd")
    out.option("path", shared_dir(spark, name)).saveAsTable(table)
    return table, spark.table(table)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector."""
    spark = vectors.sparkSession
    numbered = stored(integers(vectors, dims, scale).withColumn("row", F.monotonically_increasing_id()), "integers")
    total = numbered.count()
    schema = f"{RESULT}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not total:
        return spark.createDataFrame([], schema)
    order = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r.v for r in numbered.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)
    middle, ranges = quantiles(numbered, bits)

    @F.arrow_udf("binary")
    def cells(v: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in packed_cells(_matrix(v, dims, np.int64), ranges, bits)], pa.binary())

    around = F.array(*[F.lit(int(m)) for m in middle])
    length = F.aggregate(F.zip_with("v", around, lambda x, m: (x - m).cast("long") * (x - m)), F.lit(0).cast("long"), lambda a, x: a + x)
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_ROWS))
    compressed = stored(numbered.select("row", cells("v").alias("cells"), length.alias("length")), "cells")
    table, whole = _bucketed(numbered, buckets, "vectors")

    def fetched(before: np.ndarray | None, now: np.ndarray, every: bool = False) -> DataFrame:
        """The whole vectors of the rows that the cells leave open, with the centroids left."""
        settle = _settler(None if before is None else Lookup(before, middle, ranges, bits), Lookup(now, middle, ranges, bits), dims, bits, every)
        open_rows = compressed.select("row", settle("cells", "length").alias("left")).where("left is not null")
        return open_rows.join(whole, "row")

    k, before = len(centroids), None
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    for _ in range(rounds):
        changes = fetched(before, centroids, before is None).select("v", "left").mapInArrow(_changes(before, centroids), "cluster int, n long, s array<long>")
        each = [F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)]
        with bucketed_scans(spark):
            changed = changes.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*each).alias("s")).collect()
        for r in changed:
            sums[r.cluster] = [a + b for a, b in zip(sums[r.cluster], r.s)]
            counts[r.cluster] += r.n
        before, centroids = centroids, np.array([[x // n for x in s] if n else c.tolist() for s, n, c in zip(sums, counts, centroids)], np.int64)
    with bucketed_scans(spark):
        out = stored(fetched(None, centroids, True).select("vec_id", "v", "left").mapInArrow(_ends(centroids), RESULT), "clustered")
    spark.sql(f"drop table {table}")
    capped = F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    found = out.groupBy("cluster").agg(capped.alias("inertia")).collect()
    whole_sum = min(sum(r.inertia for r in found), (1 << 63) - 1)
    names_of = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(r.cluster, r.inertia, whole_sum, names_of[r.cluster]) for r in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int, k: int) -> str:
    """SQL of one round: nearest centroids of c{i}, then c{i + 1}."""
    return f"""
    a{i} as (select vec_id, v, arg_min(cluster, struct_pack(d, cluster)) as cluster, min(d) as d from (
        select x.vec_id, x.n, x.v, c.cluster, list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::bigint as d
        from kept x, c{i} c) group by n, vec_id, v),
    s{i} as (select cluster, dim, sum(x)::hugeint as s, count(*) as n from (
        select cluster, unnest(v) as x, unnest(range({DIMS})) as dim from a{i}) group by cluster, dim),
    m{i} as (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by dim) as v from s{i} group by cluster),
    c{i + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{i} c left join m{i} m using (cluster)),"""


ORACLE = f"""
with kept as materialized (
    select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('{SEED}' || vec_id)) - 1 as cluster, v from kept order by cluster limit {CENTROIDS}),
{"".join(_round(i, CENTROIDS) for i in range(ROUNDS + 1)).rstrip(",")}
select vec_id, cluster::int as cluster, d as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia,
    (sum(d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} c using (cluster)
"""
