"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct k-word shingles; two link when their Jaccard similarity
reaches a threshold. The join is exact for the sets of 64-bit shingle hashes:

* Documents with the same set fall into one class first; only its smallest id goes on.
* All shingles have one global order, frequent ones last.
  A set's prefix for `l` matches is its first `n - ceil(t n) + l` shingles: two sets that
  link share at least `l` of their prefixes for `l`, and at least min(l, m) when the one
  has the prefix for l and the other that for m.
* The number of shared prefix tokens also bounds the overlap; pairs that it rules out are
  not compared.
* Each document takes the `l` of least estimated cost: the postings that its prefix meets,
  plus the candidates that are left when `l` of them must agree.
* Prefix tokens of many documents tell little apart: near copies of one text share nearly all
  of them, also where no two of the copies link. Documents that meet on such hot tokens gather
  around centers, and inside a center's cell sets are replaced by their differences from the
  center, in which all that the copies have in common cancels out. With `D` the size of a
  difference, two sets link if and only if `D_a + D_b - 2 c <= (1 - t) / (1 + t) (n_a + n_b)`,
  c being the shared tokens of their differences. So documents that are near the center link
  with it at once, and any pair with one that isn't must share c >= 1 tokens: prefixes of the
  differences, rarest tokens of the cell first, find it.
* Pairs of different cells, or of none, are found by the prefixes of their sets, if they lie in
  different components by then.

What comes out are components, each document with its own, not the links: pairs inside one
component are mostly never compared, so neither the links nor their number are known.

The global order is counted over all documents: every shingle of every set adds one to a counter
of its hash, of which there are 2 ** COUNTER_BITS whatever the input, and a shingle's place is
its counter's logarithm in 256 levels, then its hash. Any such order is exact; what counters that
are shared by rare shingles cost is time. Where prefixes are still hot, though their documents
aren't copies (they share passages and more of their own), the documents that have such tokens are
counted once more, whole and apart from all others, in counters of another hash: their level comes
first in the order then, and all prefixes are made again.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausediff.llm.common import components, discard, shingle_sets, small_or_not, stored, text_pieces

#: Counters of shingles for the global order, a byte each when broadcast; and how they travel.
COUNTER_BITS, COUNTER_BLOCKS = 22, 64
#: The other hash of counters.
SALT = 0x9E3779B97F4A7C15
#: Shingles that a task gathers before it counts them.
COUNTED = 1 << 20
#: The order is counted anew where hot tokens of documents that are no copies would join more rows a document.
JOINED = 8
#: A document whose prefix is hot beyond this share is taken for a copy.
COPY_SHARE = 0.8
#: Prefix tokens of so many documents are hot: their documents are compared by cells.
HOT = 8
#: Sets of centers are broadcast up to so many bytes, and joined by a shuffle beyond.
CENTER_BYTES = 16 << 20
#: Longest prefix extension (and number of matches asked for).
MATCHES = 4


def shingle_rows(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, shingles (the set as sorted 64-bit hashes, packed)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, data, offs in text_pieces(batch.column(1)):
                sets = list(shingle_sets(data, offs, k))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, shingles binary")


def _place(tokens: np.ndarray, salt: int = 1) -> np.ndarray:
    """The counters of shingles; an odd salt gives another hash."""
    with np.errstate(over="ignore"):
        return (tokens * np.uint64(salt) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def order_levels(docs: DataFrame, k: int = 5, salt: int = 1) -> np.ndarray:
    """A level (0 to 255) for each counter: the logarithm of how many shingles of all sets fell on it.

    A task counts what it reads in one array and gives it out in blocks, packed; each block is
    summed in one task. The driver gets a byte for each counter."""
    size = (1 << COUNTER_BITS) // COUNTER_BLOCKS

    def count(batches):
        counts, held, n = np.zeros(1 << COUNTER_BITS, np.uint32), [], 0
        for batch in batches:
            for _, data, offs in text_pieces(batch.column(0)):
                held += shingle_sets(data, offs, k)
                n += sum(map(len, held[-(len(offs) - 1) :]))
                if n >= COUNTED:
                    counts += np.bincount(_place(np.concatenate(held), salt), minlength=len(counts)).astype(np.uint32)
                    held, n = [], 0
        if n:
            np.add.at(counts, _place(np.concatenate(held), salt), 1)
        for block in range(COUNTER_BLOCKS):
            if (part := counts[block * size : (block + 1) * size]).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
                sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
        for block, n in sums.items():
            levels = np.minimum(255, np.rint(8 * np.log2(n + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())], ["block", "levels"])

    counted = stored(docs.select("text").mapInArrow(count, "block int, counts binary"), "counters", texts=True)
    summed = counted.repartition(COUNTER_BLOCKS, "block").mapInArrow(add, "block int, levels binary").toArrow()
    discard(counted)
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for block, levels in zip(summed["block"].to_pylist(), summed["levels"].to_pylist(), strict=True):
        out[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(levels), np.uint8)
    return out


def hot_levels(docs: DataFrame, shared: DataFrame, num: int, den: int, k: int) -> np.ndarray | None:
    """Levels by the documents alone that have hot prefix tokens and are no copies; None where
    those tokens would join few rows. shared: token, doc_id, n, df, pos of all prefixes."""
    hot = shared.where(F.col("df") >= HOT)
    length = F.least(F.col("n"), F.col("n") - _needed(F.col("n"), num, den) + MATCHES)
    share = hot.groupBy("doc_id").agg((F.count("*") / F.first(length)).alias("share")).where(F.col("share") <= COPY_SHARE)
    share = stored(share.select("doc_id"), "no_copies")
    n = share.count()
    met = hot.join(small_or_not(share), "doc_id", "left_semi").groupBy("token").agg(F.count("*").alias("c"))
    rows = (met.agg(F.sum(F.col("c") * (F.col("c") - 1.0) / 2)).first()[0] or 0) if n else 0
    levels = order_levels(docs.join(small_or_not(share), "doc_id", "left_semi"), k, SALT) if rows > JOINED * n else None
    discard(share)
    return levels


def _needed(n: Column, num: int, den: int) -> Column:
    return F.floor((n * num + (den - 1)) / den).cast("long")


def prefix_rows(docs: DataFrame, num: int, den: int, k: int, levels: np.ndarray, first: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set, and its longest prefix in the global
    order: by the levels in `first` (counters of SALT), if given, then by levels, then by hash."""
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast((levels, first))

    def run(batches):
        levels, first = order.value
        for batch in batches:
            ids = batch.column(0)
            for at, data, offs in text_pieces(batch.column(1)):
                ns, f1, f2, prefixes = [], [], [], []
                for s in shingle_sets(data, offs, k):
                    n = len(s)
                    with np.errstate(over="ignore"):
                        f1.append(int((s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                        f2.append(int(np.bitwise_xor.reduce(s * s | np.uint64(1)).view(np.int64)) if n else 0)
                    p = min(n, n - (n * num + den - 1) // den + MATCHES)
                    ns.append(n)
                    level = levels[_place(s)]
                    if first is not None:
                        level = first[_place(s, SALT)].astype(np.uint16) * np.uint16(256) + level
                    prefixes.append(s[np.argsort(level, kind="stable")[:p]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(ns)), pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64())
                        ),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, prefix array<long>")


def verified(docs: DataFrame, pairs: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Those of pairs (a, b; distinct, stored) whose whole shingle sets link; stored."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    wanted = docs.select("doc_id", "text").join(small_or_not(ids), "doc_id", "left_semi")
    sets = stored(shingle_rows(wanted, k).select("doc_id", "shingles"), "sets", texts=True)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(ids, sets)
    return links


def centers(used: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, z: the center for each document with hot tokens. used: token, doc_id, n, df, pos, l.

    A token's most central document leads it, which is the one with the largest share of hot
    tokens in its prefix (each edit of a copy takes some away); ones of other sizes have other
    leaders, in ranges that overlap. A document takes the leader of most of its tokens, or that
    leader's own. Any choice gives the same links; a good one saves work."""
    hot = used.where(F.col("df") >= HOT).select("token", "doc_id", "n", F.col("n") - _needed(F.col("n"), num, den) + F.col("l"))
    hot = hot.toDF("token", "doc_id", "n", "length")
    share = hot.groupBy("doc_id", "length").agg(F.count("*").alias("hots")).select("doc_id", F.floor(F.col("hots") * 1024 / F.col("length")).alias("share"))
    size = F.log("n") / (2 * math.log(den / num))
    hot = hot.join(share, "doc_id").withColumn("size", F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)))
    lead = hot.groupBy("token", "size").agg(F.max(F.struct("share", F.xxhash64("doc_id").alias("h"), "doc_id")).alias("lead"))
    met = hot.join(lead, ["token", "size"]).groupBy("doc_id", "lead").agg(F.count("*").alias("c"))
    mine = stored(met.groupBy("doc_id").agg(F.max(F.struct("c", "lead")).alias("m")).select("doc_id", F.col("m.lead.doc_id").alias("z")), "leaders")
    theirs = mine.select(F.col("doc_id").alias("z"), F.col("z").alias("y"))
    mine = mine.join(theirs, "z", "left").select("doc_id", F.coalesce("y", "z").alias("z"))
    return stored(mine.where("doc_id <> z"), "assigned")


def differences(docs: DataFrame, assigned: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """doc_id, z, n, d (size of the difference from z's set), delta (its tokens), w and linked
    (whether the two link): two documents of one z link if and only if w_a + w_b <= 2 (num +
    den) c, c being the number of tokens that their deltas share. Documents with less in common
    with z than of their own are left out."""
    zs = docs.join(small_or_not(stored(assigned.select(F.col("z").alias("doc_id")).distinct(), "zs")), "doc_id", "left_semi")
    centers_sets = sets = stored(shingle_rows(zs, k).select(F.col("doc_id").alias("z"), F.col("shingles").alias("center")), "centers", texts=True)
    size = sets.agg(F.sum(F.octet_length("center"))).first()[0] or 0
    sets = F.broadcast(sets) if size <= CENTER_BYTES else sets
    rows = docs.join(small_or_not(assigned), "doc_id").join(sets, "z").select("doc_id", "text", "z", "center")

    def run(batches):
        for batch in batches:
            for at, data, offs in text_pieces(batch.column(1)):
                part = batch.slice(at, len(offs) - 1)
                n, n_z, deltas = [], [], []
                for s, c in zip(shingle_sets(data, offs, k), part.column(3), strict=True):
                    c = np.frombuffer(c.as_buffer(), np.uint64)
                    n.append(len(s))
                    n_z.append(len(c))
                    deltas.append(np.setxor1d(s, c, assume_unique=True).view(np.int64))
                n, n_z, d = np.array(n, np.int64), np.array(n_z, np.int64), np.array([*map(len, deltas)], np.int64)
                w = (den + num) * d - (den - num) * n
                keep = np.flatnonzero(d <= n)
                tokens = np.concatenate([np.zeros(0, np.int64), *(deltas[i] for i in keep)])
                ends = np.concatenate([[0], np.cumsum(d[keep])]).astype(np.int32)
                part = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n[keep]), pa.array(d[keep]), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens)),
                     pa.array(w[keep]), pa.array((w <= (den - num) * n_z)[keep])],
                    ["doc_id", "z", "n", "d", "delta", "w", "linked"],
                )

    found = stored(rows.mapInArrow(run, "doc_id long, z long, n long, d long, delta array<long>, w long, linked boolean"), "deltas", texts=True)
    discard(centers_sets)
    return found


def cell_links(deltas: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links inside cells, all but those between two documents that link with the center; stored."""
    unit = 2 * (den + num)
    least = deltas.groupBy("z").agg(F.min("w").alias("lo"), F.min(F.when(~F.col("linked"), F.col("w"))).alias("lo_out")).where("lo_out is not null")
    need = F.ceil((F.col("w") + F.when(F.col("linked"), F.col("lo_out")).otherwise(F.col("lo"))) / unit)
    d = deltas.join(least, "z").withColumn("p", F.col("d") - need + 1).where("p > 0")
    tokens = stored(d.select("z", "doc_id", "d", "w", "linked", "p", F.explode("delta").alias("token")), "cell_tokens")
    several = tokens.groupBy("z", "token").agg(F.count("*").alias("df"), F.min("linked").alias("all_linked")).where("df > 1")
    shared = tokens.join(several, ["z", "token"])
    own = F.col("d") - F.count("*").over(Window.partitionBy("doc_id"))  # tokens that no other has come first
    pos = own + F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token")) - 1
    shared = stored(shared.withColumn("pos", pos).where("pos < p and not all_linked").select("z", "token", "doc_id", "linked", "w", (F.col("d") - F.col("pos")).alias("rest")), "cell_prefixes")
    side = lambda df, x: df.select("z", "token", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "linked", "w", "rest")])
    met = side(shared.where("not linked"), "a").join(side(shared, "b"), ["z", "token"])
    met = met.where((F.col("linked_b") | (F.col("doc_id_a") < F.col("doc_id_b"))) & (F.least("rest_a", "rest_b") * unit >= F.col("w_a") + F.col("w_b")))
    pairs = met.groupBy("doc_id_a", "doc_id_b").agg(F.first("w_a").alias("w_a"), F.first("w_b").alias("w_b"))
    sets = lambda x: deltas.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("delta").alias(f"delta_{x}"))
    pairs = stored(pairs, "cell_pairs")
    both = pairs.join(sets("a"), "doc_id_a").join(sets("b"), "doc_id_b")
    both = both.where(F.size(F.array_intersect("delta_a", "delta_b")) * unit >= F.col("w_a") + F.col("w_b"))
    links = stored(both.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")), "cell_found")
    discard(tokens, shared, pairs)
    return links


def _classes_and_postings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, rep for each document with shingles, rep being the smallest id with the same set; and
    token, doc_id, n, pos, df for the prefix tokens that several reps have. Both stored."""
    some = rows.where("n_shingles > 0 and doc_id is not null")
    key = ["f1", "f2", "n_shingles"]
    classes = stored(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    member = stored(some.select("doc_id", *key).join(classes, key).select("doc_id", "rep"), "members")
    discard(classes)
    lone = small_or_not(member.where("doc_id <> rep").select("doc_id"))
    reps = some.join(lone, "doc_id", "left_anti")
    postings = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    postings = postings.select("token", "doc_id", (F.col("n") * (1 << 31) + F.col("pos")).alias("at"))
    shared = postings.join(shared, "token").withColumn("n", F.shiftright("at", 31)).withColumn("pos", F.col("at").bitwiseAND((1 << 31) - 1))
    return member, stored(shared.drop("at"), "shared")


def _one_each(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """docs with one row for each doc_id: the longest text, of those the one with the smallest
    hash. None if no doc_id repeats; rows: a stored table with docs' ids."""
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    twice = stored(twice.select("doc_id"), "twice")
    if not twice.count():
        return None
    twice = small_or_not(twice)
    first = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct(-F.length(F.coalesce("text", F.lit(""))), F.xxhash64("text"))).alias("text"))
    return stored(docs.join(twice, "doc_id", "left_anti").unionByName(first), "one_each")


def ngram_jaccard_components(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; more columns are ignored).

    Two documents link when their sets' similarity is num/den or more; component_id is the
    smallest doc_id reachable by links, its own included. Texts that are null, empty or
    without words have an empty set and link with nothing. Repeated rows (same doc_id) give
    repeated results; where their texts differ, n_shingles is each row's own and the longest
    text is the one that links. A null doc_id is returned with a null component_id.
    """
    docs = docs.select("doc_id", "text")
    levels = order_levels(docs, k)
    rows = counted = stored(prefix_rows(docs, num, den, k, levels), "prefixes", texts=True)
    if (one := _one_each(docs, rows)) is not None:
        docs, rows = one, stored(prefix_rows(one, num, den, k, levels), "prefixes", texts=True)
    member, shared = _classes_and_postings(rows)
    if (first := hot_levels(docs, shared, num, den, k)) is not None:
        discard(shared, member)
        member, shared = _classes_and_postings(stored(prefix_rows(docs, num, den, k, levels, first), "prefixes", texts=True))

    # the prefix of least estimated cost: postings met, and candidates left, each of which costs the set's length
    base = F.col("n") - _needed(F.col("n"), num, den)
    met = [F.sum(F.when(F.col("pos") < base + l, F.col("df") - 1).otherwise(0)) for l in range(1, MATCHES + 1)]
    cost = [(m * (1 + F.col("n") / (8.0 * l * l))) for l, m in ((l, F.col(f"m{l}")) for l in range(1, MATCHES + 1))]
    best = F.array_min(F.array(*[F.struct(c.alias("c"), F.lit(l).alias("l")) for l, c in enumerate(cost, 1)])).getField("l")
    chosen = shared.groupBy("doc_id", "n").agg(*[m.alias(f"m{l}") for l, m in enumerate(met, 1)])
    chosen = chosen.select("doc_id", F.least(best, F.greatest(_needed(F.col("n"), num, den), F.lit(1))).alias("l"))
    used = stored(shared.join(chosen, "doc_id").where(F.col("pos") < base + F.col("l")), "used")
    discard(shared)

    deltas = differences(docs, centers(used, num, den), num, den, k)
    edges = deltas.where("linked").select(F.col("doc_id").alias("a"), F.col("z").alias("b"))
    edges = stored(edges.unionByName(cell_links(deltas, num, den)), "cell_links")
    comp = components(edges)
    cells = deltas.select("doc_id", "z").unionByName(deltas.select(F.col("z").alias("doc_id"), "z"))
    cells = cells.groupBy("doc_id").agg(F.max_by("z", F.col("doc_id") != F.col("z")).alias("z"))

    token = used.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(cells, "doc_id", "left")
    token = token.select("token", "doc_id", "n", "l", F.coalesce("component", "doc_id").alias("comp"), F.coalesce("z", "doc_id").alias("cell"))
    size = token.groupBy("token", "cell").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    most = size.groupBy("token").agg(F.max(F.struct("c", "cell")).alias("most"), F.count("*").alias("cells"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    most = most.where("cells > 1 and lo <> hi").select("token", F.col("most.cell").alias("major"))
    token = stored(token.join(most, "token").withColumn("major", F.col("cell") == F.col("major")), "open")
    names = ("doc_id", "n", "l", "comp", "cell")
    a = token.where("not major").select("token", *[F.col(c).alias(c + "_a") for c in names])
    b = token.select("token", "major", *[F.col(c).alias(c + "_b") for c in names])
    apart = (F.col("comp_a") != F.col("comp_b")) & (F.col("cell_a") != F.col("cell_b"))
    met = a.join(b, "token").where(apart & (F.col("major") | (F.col("doc_id_a") < F.col("doc_id_b"))) & _close("n_a", "n_b", num, den))
    pairs = met.groupBy(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).agg(
        F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n_a", "l_a", "n_b", "l_b")]
    )
    pairs = pairs.where((F.col("c") >= F.least("l_a", "l_b")) & _may_link("n_a", "l_a", "n_b", "l_b", num, den))
    pairs = stored(pairs.select("a", "b"), "candidates")
    more = verified(docs, pairs, num, den, k)
    comp = components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    discard(used, deltas, edges, token, pairs, more)
    named = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return counted.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _may_link(n_a: str, l_a: str, n_b: str, l_b: str, num: int, den: int) -> Column:
    """Whether two sets of which c prefix tokens agree can still link: of the one whose prefix
    ends first, no token before that end can agree with a token behind the other's prefix, so
    the overlap is at most c and what lies behind that prefix."""
    rest = F.greatest(*[_needed(F.col(n), num, den) - F.col(l) for n, l in ((n_a, l_a), (n_b, l_b))])
    return _close(n_a, n_b, num, den) & ((F.col("c") + rest) * (num + den) >= (F.col(n_a) + F.col(n_b)) * num)


def _close(n_a: str, n_b: str, num: int, den: int) -> Column:
    return (F.col(n_a) * den >= F.col(n_b) * num) & (F.col(n_b) * den >= F.col(n_a) * num)


#: The same in SQL, by all pairs that share a shingle: for small tables with one row an id.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
token as (select doc_id, unnest(words) as x, generate_subscripts(words, 1) as i from w where len(words) >= 5),
windows as (select doc_id, x, lead(x, 1) over o as x1, lead(x, 2) over o as x2, lead(x, 3) over o as x3, lead(x, 4) over o as x4 from token window o as (partition by doc_id order by i)),
shingles as (select distinct doc_id, concat_ws(' ', x, x1, x2, x3, x4) as s from windows where x4 is not null
    union all select doc_id, array_to_string(words, ' ') from w where len(words) between 1 and 4),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select distinct a, a from both_ways union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, w.doc_id) as component_id
from w left join sizes on sizes.doc_id = w.doc_id left join (select a, min(b) as least from reach group by a) c on c.a = w.doc_id
"""
