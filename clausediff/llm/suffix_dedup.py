"""Exact removal of repeated byte strings, by sorting sampled suffixes.

Two suffixes are compared to a depth of `LENGTH` bytes. As in a difference cover, only a
sample of positions is sorted by name, such that two equal suffixes always meet a sampled
position at the same distance, and the suffixes between follow from the sampled one behind
them. The sample is chosen by content, not by residue: in each LENGTH-byte string it is the
position whose K-byte gram has the smallest hash.

1. Each sampled position gets a triple: its gram, the block of text that all suffixes lying
   in front of it reach, and its place in that block. Triples are sorted by gram and named.
2. Positions of one name have equal suffixes all along: all but the first are repeats.
3. One position of each name goes on where a gram has several names. The remaining suffixes,
   every byte of those blocks, are merged: sorted by the name of their LENGTH bytes, and
   neighbours with equal prefixes are repeats, but for the first.

Work in step 3 is limited to the ends of repeated passages, since inner blocks have one name.
Grams with many names are dealt out by their suffixes' names, so no gram gathers in one task: those
that stretches of text tell beforehand, and of the others all that have more than KEY_BLOCKS
blocks left when they are counted.
Names are 64-bit hashes; two must agree (gram and block) for a false match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm import common
from clausediff.llm.common import discard, mix, most_frequent, small_or_not, stored, text_pieces

LENGTH, GRAM = 100, 32
#: Grams with so many names in one stretch of text, or so many added up over all stretches (of those
#: with four or more), are dealt out by their suffixes; at most HOT_MOST are listed (0.5 MB).
HOT_NAMES, HOT_TOTAL, HOT_MOST = 24, 20_000, 1 << 16
#: Blocks of one gram that may meet in one task; those of a gram with more are dealt out by their suffixes.
KEY_BLOCKS = 20_000
#: Positions that a worker groups at a time, and rows that it takes from a sorted stream.
STRETCH, ROWS = 500_000, 100_000
#: Bits of the filter that tells which names may be needed again (8 MB); what passes is joined exactly.
FILTER_BITS = 26
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(common._VALUE[data] * common._powers(common._BASE, len(data)), out=out[1:])
    return out


def _spans(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the strings [a, b), wherever they stand."""
    with np.errstate(over="ignore"):
        return (sums[b] - sums[a]) * common._powers(common._INV, len(sums))[a]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def sampled(data: np.ndarray, offsets: np.ndarray):
    """The sampled positions of some texts: row, gram, block name, first and last suffix start
    in front of it (from the row's start), and that first start in data."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z, z
    sums = _sums(data)
    at = np.arange(n - GRAM + 1)
    gram = mix(_spans(sums, at, at + GRAM))
    least = _least((gram & _HIGH) | at.astype(np.uint64), LENGTH - GRAM + 1)
    place = (least & ~_HIGH).astype(np.int64)
    valid = np.zeros(len(place) + 2, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            valid[a + 1 : b - LENGTH + 2] = True
    same = np.zeros(len(place) + 1, bool)
    same[1:-1] = place[1:] == place[:-1]
    lo = np.flatnonzero(valid[1:-1] & ~(same[:-1] & valid[:-2]))
    hi = np.flatnonzero(valid[1:-1] & ~(same[1:] & valid[2:]))
    p = place[lo]
    with np.errstate(over="ignore"):
        block = mix(_spans(sums, lo, hi + LENGTH) + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (p - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    row = np.searchsorted(offsets, lo, "right") - 1
    return row, gram[p], block, lo - offsets[row], hi - offsets[row], lo


def _firsts(*columns: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorting of parallel arrays (the first one leads), and which rows are the first of
    those that agree in the first `of` arrays."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns[:of]])
    return order, new


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _positions(batch: pa.RecordBatch):
    """sampled() of a batch (doc_id, text) with doc ids for rows, piece by piece."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, data, offs in text_pieces(batch.column(1)):
        row, gram, block, lo, hi, here = sampled(data, offs)
        yield ids[at + row], gram, block, lo, hi, data, here


def _joined(parts):
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _stretches(batches, of: int):
    """The first `of` arrays of _positions over a stretch of batches at a time."""
    held, size = [], 0
    for batch in batches:
        for p in _positions(batch):
            held.append(p[:of])
            size += len(p[0])
            if size >= STRETCH:
                yield _joined(held)
                held, size = [], 0
    if size:
        yield _joined(held)


def _hot_grams(docs: DataFrame, names: int) -> np.ndarray:
    def run(batches):
        for _, gram, block in _stretches(batches, 3):
            order, new = _firsts(gram, block, of=2)
            g, n = np.unique(gram[order][new], return_counts=True)
            keep = n >= min(4, names)
            yield _batch(["g", "n"], g[keep], n[keep].astype(np.int64))

    counted = docs.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    hot = most_frequent(stored(counted.where((F.col("most") >= names) | (F.col("n") >= HOT_TOTAL)), "hot", texts=True), HOT_MOST)
    return np.sort(hot["g"].to_numpy().astype(np.int64).view(np.uint64))


def _keys(gram: np.ndarray, block: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What positions are dealt out by: the gram, or gram and block where the gram is hot."""
    if not len(hot):
        return gram, np.zeros(len(gram), bool)
    is_hot = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
    return np.where(is_hot, mix(gram ^ block), gram), is_hot


def _filter(names: DataFrame) -> np.ndarray:
    """A bit for each name (hashes in column block), set in parallel; of fixed size."""
    bit = F.shiftrightunsigned("block", 64 - FILTER_BITS)
    words = names.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(block, {64 - FILTER_BITS}) & 63 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _passes(table: np.ndarray, block: np.ndarray) -> np.ndarray:
    bit = block >> np.uint64(64 - FILTER_BITS)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


_RUN = "doc_id long, x long"  # x: first suffix start * 256 + number of further ones


def repeat_runs(docs: DataFrame, hot_names: int = HOT_NAMES) -> DataFrame:
    """doc_id and runs (packed pairs of first and last start) of all suffixes whose LENGTH-byte
    prefix also starts earlier. docs: doc_id, text; rows with a null doc_id take no part."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    hot = sc.broadcast(_hot_grams(docs, hot_names))

    def name(batches):
        for doc, gram, block, lo, hi in _stretches(batches, 5):
            key, is_hot = _keys(gram, block, hot.value)
            x = lo * 256 + (hi - lo)
            order, new = _firsts(key, block, doc, x, of=2)
            first = order[new]
            count = np.diff(np.append(np.flatnonzero(new), len(order)))
            code = np.minimum(count, 2) * 2 + is_hot[first]
            yield _batch(["key", "block", "doc_id", "x", "code"], key[first], block[first], doc[first], x[first], code.astype(np.int8))

    def sort(batches):
        """Rows in the order of key and block: the names that matter, with their first position.
        What is held between batches is one name, the last one."""
        held, before = [], None  # before: the last key of which a name was passed on

        def close(rows, last):
            nonlocal before
            key, block, doc, x, code = rows
            order, new = _firsts(key, block, doc, x, of=2)
            at = np.flatnonzero(new)
            first = order[at]
            count = np.add.reduceat((code // 2)[order].astype(np.int64), at)
            k = key[first]
            lead = np.ones(len(k), bool)
            lead[1:] = k[1:] != k[:-1]
            names = np.diff(np.append(np.flatnonzero(lead), len(k)))
            several = np.repeat(names > 1, names) | (code[first] % 2 > 0) | (k == before if before is not None else False)
            if not last:  # the last name may go on: it waits as one row
                wait = first[-1:]
                rest = [c[wait] for c in rows[:4]] + [(np.minimum(count[-1:], 2) * 2 + code[wait] % 2).astype(np.int8)]
                before = k[-2] if len(k) > 1 else before
                first, count, several = first[:-1], count[:-1], several[:-1]
            else:
                rest = None
            keep = (count > 1) | several
            f = first[keep]
            return _batch(["key", "block", "first_doc", "first_x", "twice", "several"], key[f], block[f], doc[f], x[f], count[keep] > 1, several[keep]), rest

        size = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= ROWS:
                out, rest = close(_joined(held), False)
                held, size = [rest], 1
                yield out
        if size:
            yield close(_joined(held), True)[0]

    named = docs.mapInArrow(name, "key long, block long, doc_id long, x long, code byte")
    named = named.repartition("key").sortWithinPartitions("key", "block")
    named = stored(named.mapInArrow(sort, "key long, block long, first_doc long, first_x long, twice boolean, several boolean"), "names", texts=True)
    twice = named.where("twice").select("key", "block", "first_doc", "first_x")
    maybe = sc.broadcast(_filter(twice.select("block")))
    open_ = sc.broadcast(_filter(named.where("several").select("block")))

    def members(batches):
        for doc, gram, block, lo, hi in _stretches(batches, 5):
            keep = _passes(maybe.value, block)
            doc, gram, block, x = doc[keep], gram[keep], block[keep], (lo * 256 + (hi - lo))[keep]
            key, _ = _keys(gram, block, hot.value)
            order, new = _firsts(key, block, doc, x, of=2)  # an earlier one in the stretch settles it
            settled = ~new
            if len(order):
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                settled &= (doc[order] != doc[head]) | (x[order] >> 8 != x[head] >> 8)
            yield _batch(["key", "block", "doc_id", "x", "settled"], key[order], block[order], doc[order], x[order], settled)

    seen = stored(docs.mapInArrow(members, "key long, block long, doc_id long, x long, settled boolean"), "members", texts=True)
    later = F.struct("doc_id", F.shiftright("x", 8)) > F.struct("first_doc", F.shiftright("first_x", 8))
    whole = seen.where("settled").select("doc_id", "x").unionByName(
        seen.where("not settled").join(twice, ["key", "block"]).where(later).select("doc_id", "x")
    )

    def suffixes(h, d, s):
        """Suffixes by their names; of those with one name all but the first are settled here."""
        o, first = _firsts(h, d, s, of=1)
        return _batch(["key", "doc_id", "x", "bytes", "done"], h[o].view(np.int64), d[o], s[o] * 256, pa.nulls(len(o), pa.binary()), ~first)

    def ends_of(parts):
        doc, gram, block, lo, hi, text, own = _joined(parts)
        order, new = _firsts(gram, block, doc, lo, of=2)
        f = order[new]
        cold = np.array([own[i] is None for i in f], bool)
        c, w = f[cold], f[~cold]
        yield _batch(["key", "doc_id", "x", "bytes", "done"], gram[c], doc[c], lo[c] * 256 + (hi - lo)[c], pa.array(text[c], pa.binary()), np.zeros(len(c), bool))
        if len(w):
            n = (hi - lo)[w] + 1
            h = mix(np.concatenate(list(own[w])))
            yield suffixes(h, np.repeat(doc[w], n), np.concatenate([np.arange(a, a + m) for a, m in zip(lo[w], n, strict=True)]))

    def remaining(batches):
        """Blocks of grams with several names, one of a name; of hot grams their suffixes, one of a name."""
        parts, size = [], 0
        for batch in batches:
            for doc, gram, block, lo, hi, data, here in _positions(batch):
                keep = np.flatnonzero(_passes(open_.value, block))
                if len(keep):
                    sums = _sums(data)
                    text = np.array([data[a : a + b].tobytes() for a, b in zip(here[keep], (hi - lo)[keep] + LENGTH, strict=True)], object)
                    is_hot = _keys(gram[keep], block[keep], hot.value)[1]
                    s = [(_spans(sums, np.arange(a, a + n + 1), np.arange(a, a + n + 1) + LENGTH) if h else None) for a, n, h in zip(here[keep], (hi - lo)[keep], is_hot, strict=True)]
                    own = np.empty(len(keep), object)
                    own[:] = s
                    parts.append((doc[keep], gram[keep], block[keep], lo[keep], hi[keep], text, own))
                    size += len(keep)
            if size >= STRETCH // 4:
                yield from ends_of(parts)
                parts, size = [], 0
        if parts:
            yield from ends_of(parts)

    left = docs.mapInArrow(remaining, "key long, doc_id long, x long, bytes binary, done boolean")
    left = stored(left, "remaining", texts=True)
    blocks = left.where("bytes is not null").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_BLOCKS)
    heavy = stored(blocks.select("key"), "heavy")

    def split(batches):
        """Blocks as their suffixes."""
        for batch in batches:
            for at in range(0, len(batch), 5000):
                doc, x = (batch.column(c).slice(at, 5000).to_numpy() for c in (0, 1))
                data = np.frombuffer(b"".join(batch.column(2).slice(at, 5000).to_pylist()), np.uint8)
                n = (x & 255) + 1
                start = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
                step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                a = np.repeat(start, n) + step
                yield suffixes(mix(_spans(_sums(data), a, a + LENGTH)), np.repeat(doc, n), np.repeat(x >> 8, n) + step)

    if heavy.count():
        whole_blocks = left.where("bytes is not null")
        dealt = whole_blocks.join(small_or_not(heavy), "key", "left_semi").select("doc_id", "x", "bytes").mapInArrow(split, left.schema)
        others = whole_blocks.join(small_or_not(heavy), "key", "left_anti").select(*left.columns)
        before, left = left, stored(left.where("bytes is null").unionByName(others).unionByName(dealt), "remaining", texts=True)
        discard(before)

    def merge(batches):
        """Rows in the order of their key: neighbours with equal prefixes."""

        def close(key, doc, x, text):
            own = np.array([t is None for t in text], bool)
            ks, hs, ds, ss = [key[own]], [key[own].view(np.uint64)], [doc[own]], [x[own] >> 8]
            given = np.flatnonzero(~own)
            for at in range(0, len(given), 20_000):
                i = given[at : at + 20_000]
                data = np.frombuffer(b"".join(text[i]), np.uint8)
                sums = _sums(data)
                n = (x[i] & 255) + 1
                start = np.concatenate([[0], np.cumsum(n + LENGTH - 1)[:-1]])
                step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                a = np.repeat(start, n) + step
                ks.append(np.repeat(key[i], n))
                hs.append(mix(_spans(sums, a, a + LENGTH)))
                ds.append(np.repeat(doc[i], n))
                ss.append(np.repeat(x[i] >> 8, n) + step)
            k, h, d, s = map(np.concatenate, (ks, hs, ds, ss))
            order, new = _firsts(k, h, d, s, of=2)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
            gone = order[(d[order] != d[head]) | (s[order] != s[head])]
            d, s = d[gone], s[gone]
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            fresh = np.ones(len(d), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
            run = np.cumsum(fresh) - 1
            at = np.flatnonzero(fresh)
            fresh |= (s - s[at[run]]) % 200 == 0 if len(d) else fresh
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(d)) - 1
            return _batch(["doc_id", "x"], d[at], s[at] * 256 + (s[last] - s[at] if len(d) else s[at]))

        held, size, wanted = [], 0, ROWS // 10
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)] + [np.array(batch.column(3).to_pylist(), object)])
            size += batch.num_rows
            if size >= wanted:
                rows = _joined(held)
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield close(*(c[:cut] for c in rows))
                held, size = [[c[cut:] for c in rows]], size - cut
                wanted = max(ROWS // 10, 2 * size)
        if size:
            yield close(*_joined(held))

    met = left.where("not done").select("key", "doc_id", "x", "bytes").repartition("key").sortWithinPartitions("key")
    ends = met.mapInArrow(merge, _RUN).unionByName(left.where("done").select("doc_id", "x"))

    def pack(batches):
        for batch in batches:
            out = []
            for xs in batch.column(1):
                x = np.sort(xs.values.to_numpy())
                a, b = x >> 8, (x >> 8) + (x & 255)
                b = np.maximum.accumulate(b)
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1] + 1
                at = np.flatnonzero(new)
                out.append(np.stack([a[at], b[np.append(at[1:], len(a)) - 1]], axis=1).astype(np.int64).tobytes())
            yield _batch(["doc_id", "runs"], batch.column(0), pa.array(out, pa.binary()))

    runs = whole.unionByName(ends).groupBy("doc_id").agg(F.collect_list("x").alias("xs"))
    runs = stored(runs.mapInArrow(pack, "doc_id long, runs binary"), "runs")
    discard(named, seen, left)
    return runs


def without_repeats(docs: DataFrame, hot_names: int = HOT_NAMES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    Each text is UTF-8 bytes (null: empty). Removed is each byte of a LENGTH-byte string that
    also starts earlier, in a document with a smaller doc_id or before in the same one; strings
    are judged on the input. Rows of one doc_id are taken for the same document and don't
    repeat each other; a null doc_id neither gives nor loses anything. kept_text leaves out
    parts of characters that a cut left behind; the digest is that of all remaining bytes."""
    runs = repeat_runs(docs, hot_names)
    size = runs.agg(F.sum(F.octet_length("runs"))).first()[0] or 0
    if size <= 64 << 20:
        runs = small_or_not(runs)
    own = "runs"
    while own.lower() in (c.lower() for c in docs.columns):
        own += "_"
    runs = runs.withColumnRenamed("runs", own)
    kept = [f for f in docs.schema.fields if f.name not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")]
    names = [f.name for f in kept]
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, runs in zip(batch.column(at), batch.column(len(names)), strict=True):
                data = (text.as_py() or "").encode()
                removed = spans = 0
                if runs.is_valid:
                    pairs = np.frombuffer(runs.as_buffer(), np.int64).reshape(-1, 2)
                    a, b = pairs[:, 0], pairs[:, 1] + LENGTH
                    new = np.ones(len(a), bool)
                    new[1:] = a[1:] > b[:-1]
                    first = np.flatnonzero(new)
                    a, b = a[first], b[np.append(first[1:], len(a)) - 1]
                    removed, spans = int((b - a).sum()), len(a)
                    edge = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(data)]
                    size = len(data)
                    data = b"".join(data[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2))
                else:
                    size = len(data)
                for column, x in zip(out, (size, removed, spans, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "ignore")), strict=True):
                    column.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names).join(runs, "doc_id", "left").select(*names, own).mapInArrow(
        run, columns + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


#: The same in SQL, by a row for each string of LENGTH bytes: for small tables with one row an id.
ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, piece, substring(h, 512 * piece + 1, 512 + 2 * {LENGTH}) as p from (select doc_id, h, unnest(range(length(h) // 512 + 1)) as piece from d)),
starts as (select doc_id, piece, p, unnest(range(least(256, length(p) // 2 - {LENGTH} + 1))) as pos from pieces where length(p) >= 2 * {LENGTH}),
strings as (select doc_id, 256 * piece + pos as pos, substring(p, 2 * pos + 1, 2 * {LENGTH}) as s from starts),
again as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by s order by doc_id, pos) as n from strings) where n > 1),
marked as (select doc_id, pos, coalesce(lag(pos) over o, -{LENGTH} - 1) as before from again window o as (partition by doc_id order by pos)),
spans as (select doc_id, min(pos) as a, max(pos) + {LENGTH} as b from (select *, sum((pos > before + {LENGTH})::int) over (partition by doc_id order by pos) as span from marked) group by doc_id, span),
cuts as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, list(a order by a) as a_s, list(b order by a) as b_s from spans group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(case when a_s is null then h else array_to_string(list_transform(range(len(a_s) + 1),
        lambda i: substring(h, 2 * (case when i = 0 then 0 else b_s[i] end) + 1, 2 * ((case when i = len(a_s) then length(h) // 2 else a_s[i + 1] end) - (case when i = 0 then 0 else b_s[i] end)))), '') end)) as kept_sha256
from d left join cuts using (doc_id)
"""
