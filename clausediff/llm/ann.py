"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed into one bucket of each table: the cells of random Gaussian
projections. A query visits its own bucket and perturbed ones in the order of their
estimated success, the summed squared distances to the cell walls that a perturbation
crosses. Inside a bucket queries meet members as blocks of a matrix product, and only a
query's nearest of each task go on; their scores are exact, in double precision, on the
original vectors. Buckets of many members or queries are split into blocks of bounded size,
none is cut.

Largest inner products are nearest neighbours once each vector gets one more component that
brings all to the same length; queries get a zero there. Members do so in ranges of their
norm, each scaled by its own longest, or a single long vector would leave all others with
little but that component. Queries hash alike for all ranges, so the ranges share buckets.

A query that has found fewer rows than it asks for and there are is searched exactly: it
meets all members, again in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausediff.llm.common import mix, small_or_not, stored

TABLES, HASHES, WIDTH, PROBES, SEED = 5, 6, 2.0, 64, 11
#: Most members, and queries, of one block.
BLOCK = 20_000
#: Vectors of queries are broadcast up to so many bytes; beyond, they are joined to the probes.
ASKED_BYTES = 64 << 20
#: Norm ranges in each doubling of the norm.
RANGES = 4


def usable(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows with an id and a vector of length n (else the most common), of finite numbers, not all zero."""
    d = df.where("vec_id is not null").select("vec_id", "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(fine & F.exists("embedding", lambda x: x != 0))
    n = d.agg(F.mode(F.size("embedding"))).first()[0] if n is None else n
    return d.where(F.size("embedding") == F.lit(n))


def _planes(dims: int):
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(TABLES, dims + 1, HASHES)), rng.uniform(0, WIDTH, (TABLES, HASHES))


def _names(cells: np.ndarray, table: int) -> np.ndarray:
    out = np.full(len(cells), table + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[1]):
            out = mix(out * np.uint64(31) + cells[:, j].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def probe_cells(place: np.ndarray, probes: int) -> list[np.ndarray]:
    """A query's cell and the perturbed ones, the likelier first. place: its projections in cell widths."""
    cell = np.floor(place).astype(np.int64)
    part = place - cell
    m = len(cell)
    cost = np.concatenate([part**2, (1 - part) ** 2])
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    out, heap = [cell], [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))
        dims = [order[i] % m for i in chosen]
        if len(set(dims)) == len(dims):
            p = cell.copy()
            for i in chosen:
                p[order[i] % m] += -1 if order[i] < m else 1
            out.append(p)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def longest_norms(df: DataFrame) -> np.ndarray:
    """The longest norm of each norm range that has rows, in order; a double's exponent bounds their number."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double") * e))
    ranges = df.select(norm.alias("norm")).groupBy(F.ceil(F.log2("norm") * RANGES).alias("range"))
    return np.sort(np.array([r[0] for r in ranges.agg(F.max("norm")).select("max(norm)").collect()], np.float64))


def _hashed(df: DataFrame, lengths: np.ndarray, queries: bool) -> DataFrame:
    """bucket, vec_id, vec for each table, or bucket, vec_id for each table and probe of queries."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = _matrix(part.column(1))
                ids = part.column(0).to_numpy()
                planes, shifts = _planes(x.shape[1])
                norm = np.sqrt((x * x).sum(1))
                if queries:
                    y = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
                else:
                    length = lengths[np.minimum(np.searchsorted(lengths, norm * (1 - 1e-9)), len(lengths) - 1)]
                    y = np.hstack([x / length[:, None], np.sqrt(np.maximum(0, 1 - (norm / length) ** 2))[:, None]])
                rows, names = [], []
                for t in range(TABLES):
                    place = (y @ planes[t] + shifts[t]) / WIDTH
                    if queries:
                        for i, p in enumerate(place):
                            cells = probe_cells(p, PROBES)
                            rows.append(np.full(len(cells), i))
                            names.append(_names(np.array(cells), t))
                    else:
                        rows.append(np.arange(len(x)))
                        names.append(_names(np.floor(place), t))
                rows, names = np.concatenate(rows), np.concatenate(names)
                named = [pa.array(names), pa.array(ids[rows])]
                yield pa.RecordBatch.from_arrays(named, ["bucket", "vec_id"]) if queries else pa.RecordBatch.from_arrays([*named, _packed(x).take(pa.array(rows))], ["bucket", "vec_id", "vec"])

    return df.select("vec_id", "embedding").mapInArrow(run, "bucket long, vec_id long" + ("" if queries else ", vec binary"))


def _asked(q: DataFrame):
    """The queries' ids, sorted, and vectors, to be found by id where probes meet members: a
    broadcast of checked size; None beyond that."""
    n, dims = q.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n * (dims or 0) * 8 > ASKED_BYTES:
        return None
    rows = q.select("vec_id", "embedding").toArrow()
    ids = rows["vec_id"].to_numpy().astype(np.int64)
    order = np.argsort(ids)
    return q.sparkSession.sparkContext.broadcast((ids[order], _matrix(rows["embedding"].combine_chunks())[order] if n else np.zeros((0, 1))))


def _best(q, v, s, k):
    """Of parallel arrays the k best rows of each query, one for a pair."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[new], v[new], s[new]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k rows of vectors with the
    largest inner product that the probes find, its own id left out, ties to the smaller id.
    Where they find fewer than k, the query is searched exactly, so only a table that has
    fewer rows gives fewer.

    Both have vec_id and embedding. Vectors that are null, zero, of another length than most
    of vectors or hold null or non-finite components take no part. Of equal vectors only the k + 1 smallest ids
    can be among the k nearest of any query, so more aren't indexed. Repeated rows count once."""
    x = stored(usable(vectors), "vectors")
    first = x.select(F.size("embedding")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = stored(usable(queries, first[0] if first else 0).dropDuplicates(["vec_id"]).repartition(tasks, "vec_id"), "queries")  # a query has many probes
    asked = _asked(q)
    lengths = longest_norms(x)
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    x = x.dropDuplicates(["vec_id"]).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n")
    members = stored(_hashed(x, lengths, False), "members")
    probes = stored(_hashed(q, lengths, True), "probes")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m")).join(probes.groupBy("bucket").agg(F.count("*").alias("p")), "bucket")
    sizes = stored(sizes.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("ms"), F.ceil(F.col("p") / BLOCK).cast("int").alias("ps")).where("ms > 1 or ps > 1"), "sizes")
    one = lambda c: F.coalesce(c, F.lit(1))
    part = lambda c: F.pmod(F.xxhash64("vec_id"), one(F.col(c))).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), one(F.col(c)) - 1))

    def run(batches):
        now, qs, xs, found, held = None, [], [], [], 0

        def scores():
            ids, vecs = (np.concatenate([p[i] for p in qs]) for i in (0, 1))
            mi, mv = (np.concatenate([p[i] for p in xs]) for i in (0, 1))
            for a in range(0, len(ids), 512):
                for b in range(0, len(mi), 8192):
                    s = vecs[a : a + 512] @ mv[b : b + 8192].T
                    s[ids[a : a + 512, None] == mi[None, b : b + 8192]] = -np.inf
                    slack = 1e-9 * np.sqrt((vecs[a : a + 512] ** 2).sum(axis=1) * (mv[b : b + 8192] ** 2).sum(axis=1).max())
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack if s.shape[1] > k else np.full(len(s), -np.finfo(float).max)
                    i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    yield ids[a + i], mi[b + j], (vecs[a + i] * mv[b + j]).sum(axis=1)

        def batch_of(parts):
            return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["query_id", "vec_id", "score"])

        def close():
            nonlocal found, held
            if qs and xs:
                for part in scores():
                    found.append(part)
                    held += len(part[0])
            if held > 400_000:
                found = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
                held = len(found[0][0])
                if held > 200_000:
                    out, found, held = found[0], [], 0
                    return batch_of(out)
            return None

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ids = batch.column(4).to_numpy()
            vecs = batch.column(5)
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                group = tuple(keys[a, :3])
                if group != now:
                    if (out := close()) is not None:
                        yield out
                    now, qs, xs = group, [], []
                if keys[a, 3] or asked is None:
                    v = np.frombuffer(b"".join(vecs.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                else:
                    v = asked.value[1][np.searchsorted(asked.value[0], ids[a:b])]
                (xs if keys[a, 3] else qs).append((ids[a:b], v))
        if (out := close()) is not None:
            yield out
        if found:
            yield batch_of(_best(*(np.concatenate(c) for c in zip(*found, strict=True)), k))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(_matrix(batch.column(1)))], ["vec_id", "vec"])

    def met(probes, members, sizes):
        """query_id, vec_id, score of the queries and members that share a bucket: each task's k nearest of a query."""
        if asked is None:
            probes = probes.join(q.select("vec_id", "embedding").mapInArrow(packed, "vec_id long, vec binary"), "vec_id")
        else:
            probes = probes.withColumn("vec", F.lit(None).cast("binary"))
        left = probes.join(sizes, "bucket", "left").select("bucket", part("ps").alias("pb"), all_of("ms").alias("mb"), F.lit(0).alias("kind"), "vec_id", "vec")
        right = members.join(sizes, "bucket", "left").select("bucket", all_of("ps").alias("pb"), part("ms").alias("mb"), F.lit(1).alias("kind"), "vec_id", "vec")
        key = ["bucket", "pb", "mb"]
        both = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind")
        return both.mapInArrow(run, "query_id long, vec_id long, score double").distinct()

    scored = stored(met(probes, members, small_or_not(sizes)), "scored")
    found = scored.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"))
    few = stored(probes.select("vec_id").distinct().join(found, "vec_id", "left").where(F.coalesce("found", F.lit(0)) < k), "few")
    if few.count():
        n = members.count() // TABLES
        own = members.select("vec_id", F.lit(1).alias("own")).join(small_or_not(few.select("vec_id")), "vec_id", "left_semi").distinct()
        there = F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0)))
        few = stored(few.join(own, "vec_id", "left").where(F.coalesce("found", F.lit(0)) < there).select("vec_id"), "few")
    if m := few.count():
        one_each = lambda df: df.dropDuplicates(["vec_id"]).withColumn("bucket", F.lit(0).cast("long"))
        sizes = vectors.sparkSession.range(1).select(F.col("id").alias("bucket"), F.lit(-(-n // BLOCK)).alias("ms"), F.lit(-(-m // BLOCK)).alias("ps"))
        exact = met(one_each(probes.join(small_or_not(few), "vec_id", "left_semi")), one_each(members), F.broadcast(sizes))  # sizes is one row
        scored = stored(scored.unionByName(exact).distinct(), "scored")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
