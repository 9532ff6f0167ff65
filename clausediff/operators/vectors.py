"""Vectors of chunks and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.functions.text import distance_similarity, search_score
from clausediff.operators.index import where_all
from clausediff.sources.files import stored

DIMENSIONS = 256
#: Queries and index rows of one block.
QUERY_BLOCK, INDEX_BLOCK = 1024, 4096
#: Queries are broadcast up to so many bytes of vectors.
QUERY_BYTES = 64 << 20
#: Queries of which one task keeps its nearest rows at a time.
HELD = 100_000
#: Most rows of one side of a pair that meet at once.
PAIR_BLOCK = 4096


def embed(rows: DataFrame, column: str = "text", encoder: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows with embedding: by the caller's encoder in batches, or else hashed words, normalised."""
    if encoder is not None:

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(np.asarray(encoder(texts.fillna("").tolist()), np.float32)))

        return rows.withColumn("embedding", encode(F.col(column)))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)[^\p{L}\p{N}]+")
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions)
    unit = Normalizer(inputCol="_tf", outputCol="_unit")
    out = rows.withColumn("_text", F.coalesce(F.col(column), F.lit("")))
    for step in (words, hashed, unit):
        out = step.transform(out)
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_text", "_words", "_tf", "_unit")


def embed_once(rows: DataFrame, column: str = "text", encoder: Callable[[list[str]], np.ndarray] | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """embed(), with each different text encoded once: texts meet by their SHA-256, one of each is
    encoded into a stored table, and the vectors are joined back. An article that stands the same in
    both versions, or in many documents, costs one call. Nulls count as empty texts."""
    content = F.sha2(F.coalesce(column, F.lit("")), 256)
    named = rows.withColumn("_content", content)
    texts = named.groupBy("_content").agg(F.any_value(F.coalesce(column, F.lit(""))).alias("_once"))
    known = stored(embed(texts, "_once", encoder, dimensions).select("_content", "embedding"), "vectors")
    return named.join(known, "_content").select(*rows.columns, "embedding")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, by: list[str], k: int, tie: str = "chunk_id") -> DataFrame:
    """The k rows of smallest distance of each group, ranked. Spark cuts each partition's rows to k first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("distance", tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _packed(df: DataFrame, number: str, vector: str, block: int) -> DataFrame:
    """Runs of rows of a task as blocks: dims, n rows, their `number` and their vectors (doubles,
    packed), and all other columns as lists. Vectors of another length start another block;
    rows without a vector are left out. A column named qb parts blocks too."""
    rows = df.where(F.col(vector).isNotNull()).withColumn("dims", F.size(vector)).withColumnRenamed(vector, "_vector")
    keys = ["dims", *(c for c in ("qb",) if c in df.columns)]
    rows = rows.select(*keys, "_vector", F.col(number).alias("_name"))
    schema = ", ".join(f"{c} int" for c in keys) + f", names array<{rows.schema['_name'].dataType.simpleString()}>, vectors binary"

    def pack(batches):
        for batch in batches:
            at, n = 0, batch.num_rows
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            ends = [*(np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1), n] if n else []
            for end in ends:
                while at < end:
                    part = batch.slice(at, min(block, end - at))
                    flat = part.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    names = part.column("_name")
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([int(v[at])], pa.int32()) for v in values), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), names), pa.array([flat.tobytes()], pa.binary())],
                        [*keys, "names", "vectors"],
                    )
                    at += part.num_rows

    return rows.mapInArrow(pack, schema)


class _Nearest:
    """The k nearest index rows so far of each query of one block, kept as arrays."""

    def __init__(self, queries: pa.Array, vectors: np.ndarray, k: int):
        self.queries, self.vectors, self.k = queries, vectors, k
        self.squares = (vectors * vectors).sum(axis=1)
        self.far = np.full(len(queries), np.inf)  # of the k-th nearest so far
        self.rows: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []  # query, name, distance
        self.size = 0

    def meet(self, names: pa.Array, x: np.ndarray) -> None:
        """Takes in a block of index rows: a matrix product rules most of them out, the distances
        of the others are summed exactly, in the order of components."""
        squares = (x * x).sum(axis=1)
        near = self.squares[:, None] + squares[None] - 2 * self.vectors @ x.T
        slack = 1e-9 * (self.squares[:, None] + squares.max())
        bound = self.far[:, None]
        if len(x) > self.k:
            bound = np.minimum(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1, None])
        i, j = np.nonzero(near <= bound + slack)
        for at in range(0, len(i), 65536):
            q, r = i[at : at + 65536], j[at : at + 65536]
            distance = np.zeros(len(q))
            for c in range(x.shape[1]):
                distance += (self.vectors[q, c] - x[r, c]) ** 2
            self.rows.append((q, names.take(pa.array(r)), distance))
            self.size += len(q)
            if self.size > 4 * self.k * len(self.queries) + 65536:
                self.cut()

    def cut(self) -> None:
        """Keeps of each query the k nearest, ties by name."""
        if not self.rows:
            return
        q, distance = np.concatenate([r[0] for r in self.rows]), np.concatenate([r[2] for r in self.rows])
        names = pa.concat_arrays([r[1] for r in self.rows])
        order = pa.compute.sort_indices(pa.table({"q": q, "d": distance, "n": names}), [("q", "ascending"), ("d", "ascending"), ("n", "ascending")])
        order = order.to_numpy()
        q = q[order]
        first = np.searchsorted(q, q)
        keep = np.flatnonzero(np.arange(len(q)) - first < self.k)
        last = keep[np.arange(len(q))[keep] - first[keep] == self.k - 1]
        distance = distance[order]
        self.far[q[last]] = distance[last]
        self.rows = [(q[keep], names.take(pa.array(order[keep])), distance[keep])]
        self.size = len(keep)

    def result(self) -> pa.RecordBatch:
        self.cut()
        q, names, distance = self.rows[0]
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(q)), names, pa.array(distance)], ["query_id", "chunk_id", "distance"])


def semantic_search(index: DataFrame, queries: DataFrame, k: int = 10, where: dict | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, chunk_id, distance, score: the k nearest index rows of each query
    (query_id, embedding), ties by chunk_id. Rows without a vector, or with one of another
    length than a query's, aren't near it.

    Both sides are packed into blocks of rows, and an index block meets a query block as one
    matrix product. The index is scanned once whatever the number of queries: query blocks are
    broadcast up to QUERY_BYTES in all, and beyond that index blocks go to them by a shuffle. Each task
    keeps k rows a query of the query blocks it is at, HELD at most, before anything is merged."""
    count, dims = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-count // block))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"))
    q = _packed(q.repartition("qb").sortWithinPartitions("qb") if blocks > 1 else q, "query_id", "embedding", block)
    q = q.select("dims", "qb", F.col("names").alias("queries"), F.col("vectors").alias("asked"))
    q = F.broadcast(q) if count * (dims or 0) * 8 <= QUERY_BYTES else q
    rows = _packed(index.where(where_all(where)), "chunk_id", "embedding", INDEX_BLOCK)
    met = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, ["dims", "qb"])
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {index.schema['chunk_id'].dataType.simpleString()}, distance double"

    def nearest(batches):
        held: dict[tuple, _Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims, asked = batch.column("dims")[row].as_py(), batch.column("asked")[row].as_buffer()
                names = batch.column("queries").slice(row, 1).flatten()
                key = (batch.column("qb")[row].as_py(), dims, len(names), hash(asked.to_pybytes()))
                if key not in held:
                    if sum(len(h.queries) for h in held.values()) >= HELD:
                        yield from (h.result() for h in held.values())
                        held.clear()
                    held[key] = _Nearest(names, np.frombuffer(asked, np.float64).reshape(-1, dims), k)
                x = np.frombuffer(batch.column("vectors")[row].as_buffer(), np.float64).reshape(-1, dims)
                held[key].meet(batch.column("names").slice(row, 1).flatten(), x)
        yield from (h.result() for h in held.values())

    found = met.select("dims", "qb", "queries", "asked", "names", "vectors").mapInArrow(nearest, kinds)
    return top_k(found, ["query_id"], k).withColumn("score", search_score(F.col("distance")))


def article_candidates(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """pair_id, left_no, rank, chunk_id, article_number, article_title, distance, similarity:
    for each v1 article (pair_id, left_no, embedding) the k nearest v2 rows of its pair
    (pair_id, chunk_id, article_number, article_title, embedding). No texts are moved.

    Both sides of a pair meet in one task as blocks of at most PAIR_BLOCK rows; a matrix product
    leaves the rows that may be among the k nearest, and their distances are then summed exactly."""
    names = ("pair_id", "left_no", "chunk_id", "article_number", "article_title")
    kind = {f.name: f.dataType.simpleString() for f in (*left.schema.fields, *right.schema.fields)}
    blocks = lambda df, name: df.groupBy("pair_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias(name))
    # at most one large pair for each PAIR_BLOCK rows, so vectors need no shuffle to meet them
    large = F.broadcast(blocks(left, "lefts").join(blocks(right, "rights"), "pair_id").where("lefts > 1 or rights > 1"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda c, of: F.pmod(F.xxhash64(of), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    null = lambda c: F.lit(None).cast(kind[c]).alias(c)
    lefts = left.where("embedding is not null").join(large, "pair_id", "left").select(
        "pair_id", part("lefts", "left_no").alias("lb"), every("rights").alias("rb"), F.lit(0).alias("side"), "left_no", *map(null, names[2:]), "embedding"
    )
    rights = right.where("embedding is not null").join(large, "pair_id", "left").select(
        "pair_id", every("lefts").alias("lb"), part("rights", "chunk_id").alias("rb"), F.lit(1).alias("side"), null("left_no"), *names[2:], "embedding"
    )
    key = ["pair_id", "lb", "rb"]
    met = lefts.unionByName(rights).repartition(*key).sortWithinPartitions(*key, "side")

    def nearest(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PAIR_BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                cuts = _group_starts(table)
                yield from _near_rows(table.slice(0, cuts[-1]), cuts[:-1], k, names)
                held = table.slice(cuts[-1]).to_batches()
                size = table.num_rows - cuts[-1]
        if size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _near_rows(table, _group_starts(table), k, names)

    scored = met.mapInArrow(nearest, ", ".join(f"{c} {kind[c]}" for c in names) + ", distance double")
    best = top_k(scored, ["pair_id", "left_no"], k)
    return best.withColumn("similarity", distance_similarity(F.col("distance")))


def _group_starts(table: pa.Table) -> np.ndarray:
    """First rows of runs of equal pair and blocks."""
    keys = [table.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return np.flatnonzero(new)


def _near_rows(table: pa.Table, starts: np.ndarray, k: int, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if not len(starts):
        return
    side = table.column(3).to_numpy()
    vectors = table.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    squares = (flat * flat).sum(axis=1)
    lefts, rights, distances = [], [], []
    for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
        mid = a + int(np.searchsorted(side[a:b], 1))
        if mid in (a, b):
            continue
        for at in range(a, mid, 256):
            to = min(mid, at + 256)
            near = squares[at:to, None] + squares[None, mid:b] - 2 * flat[at:to] @ flat[mid:b].T
            if b - mid > k:
                slack = 1e-9 * (squares[at:to, None] + squares[mid:b].max())
                near = near <= np.partition(near, k - 1, axis=1)[:, k - 1, None] + slack
            else:
                near = np.ones(near.shape, bool)
            i, j = np.nonzero(near)
            i, j = i + at, j + mid
            lefts.append(i)
            rights.append(j)
            for x in range(0, len(i), 8192):  # summed in the order of components
                distances.append(np.add.accumulate((flat[i[x : x + 8192]] - flat[j[x : x + 8192]]) ** 2, axis=1)[:, -1])
    if lefts:
        i, j = (pa.array(np.concatenate(x)) for x in (lefts, rights))
        columns = [table.column(c).take(i if c in ("pair_id", "left_no") else j).combine_chunks() for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(distances))], [*names, "distance"])
