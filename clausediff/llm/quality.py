"""Quality classifier: hashed word n-grams, logistic regression trained by
follow-the-regularised-leader updates, scored as sparse dot products.

Features are words, word pairs and triples of word shapes (capitals, symbols, digits, end
mark, length, whether the word repeats one of the two before it), hashed into `2 ** bits`
places; a document's value for a place is its share of the document's n-grams. The model is
fitted on a bounded sample of labelled rows, in shards whose weights are averaged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.common import mix, ngram_hashes, small_or_not, stored, text_pieces, word_hashes, word_spans

BITS = 18
KEEP_SCORE = 0.3
#: At most so many labelled rows are used for training, those with the smallest hashes of their ids.
TRAIN_ROWS = 8000
SHARDS, EPOCHS = 4, 4
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.002, 0.05, 12.0

_CLASS = np.zeros((4, 256), np.int32)
_CLASS[0, 65:91] = 1  # capitals
_CLASS[1, list(b"#*$%&|<>!")] = 1  # symbols
_CLASS[2, 48:58] = 1  # digits
_CLASS[3, list(b".!?;:")] = 1  # end marks


def _shapes(data, starts, ends, h, first) -> np.ndarray:
    """A small number for each word: what kind of word it is."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for i in range(3):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASS[i][data], out=sums[1:])
        n = sums[ends] - sums[starts]
        out |= (np.minimum(2, n).astype(np.uint64) + (2 * n > size)) << np.uint64(2 * i)
    out |= _CLASS[3][data[ends - 1]].astype(np.uint64) << np.uint64(6)
    row = np.searchsorted(first, np.arange(len(starts)), "right")
    for back in (1, 2):
        same = np.zeros(len(starts), bool)
        same[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
        out |= same.astype(np.uint64) << np.uint64(6 + back)
    return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of all rows, row after row, and where each row's begin."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, True)
    shape = _shapes(data, starts, ends, h, first[1:]) if len(starts) else h
    row = np.searchsorted(first[1:], np.arange(len(h)), "right")
    parts = [(row, mix(h ^ np.uint64(1)))]
    for grams, k, salt in ((ngram_hashes(h, 2), 2, 2), (ngram_hashes(mix(shape), 3), 3, 3)):
        inside = row[: len(grams)] == row[k - 1 : k - 1 + len(grams)]
        parts.append((row[: len(grams)][inside], mix(grams[inside] ^ np.uint64(salt))))
    rows = np.concatenate([r for r, _ in parts])
    order = np.argsort(rows, kind="stable")
    place = (np.concatenate([p for _, p in parts]) >> np.uint64(64 - bits)).astype(np.int64)[order]
    return place, np.searchsorted(rows[order], np.arange(len(offsets)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates over (places, values, label) rows."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for i, x, y in rows:
            w = weight(i)
            g = (_sigmoid(w @ x) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def trained(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from labelled rows (doc_id, quality) whose crc32(doc_id) mod 5 isn't 0,
    `most` at the most. Nulls are left out; without labels all weights are 0 (score 0.5)."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = stored(chosen.where(fold != 0), "labels")
    if (n := chosen.count()) > most:  # first by hash, so that little more than `most` rows are sorted
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < math.ceil((most / n * 1.1 + 100 / n) * (1 << 30))
        chosen = stored(chosen.where(share).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most), "labelled")
    sample = docs.select("doc_id", "text").join(small_or_not(chosen), "doc_id")

    def grouped(batches):
        for batch in batches:
            out = [[], [], []]
            for at, data, offs in text_pieces(batch.column(1)):
                place, first = features(data, offs, bits)
                for r in range(len(offs) - 1):
                    i, c = np.unique(place[first[r] : first[r + 1]], return_counts=True)
                    out[0].append(i)
                    out[1].append(c * (SCALE / max(1, c.sum())))
                    out[2].append(at + r)
            take = pa.array(out[2], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float64()))],
                ["doc_id", "quality", "i", "x"],
            )

    rows = sample.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(grouped, "doc_id long, quality int, i array<long>, x array<double>")
    rows = rows.withColumn("turn", F.xxhash64(F.lit(7), "doc_id")).withColumn("shard", F.pmod("turn", F.lit(SHARDS)))

    def train(pdf):
        pdf = pdf.sort_values(["turn", "doc_id"])
        bias = 1 << bits
        given = [(np.append(i, bias), np.append(x, 1.0), y) for i, x, y in zip(pdf.i, pdf.x, pdf.quality, strict=True)]
        w = ftrl(given, bits)
        import pandas as pd

        used = np.flatnonzero(w)
        return pd.DataFrame({"place": np.append(used, -1), "w": np.append(w[used], 1.0)})  # place -1 counts the shards with rows

    mean = rows.groupBy("shard").applyInPandas(train, "place long, w double")
    pairs = mean.groupBy("place").agg(F.sum("w").alias("w")).toArrow()  # at most 2 ** bits + 1 rows
    place, w = pairs["place"].to_numpy().astype(np.int64), pairs["w"].to_numpy().astype(float)
    out = np.zeros((1 << bits) + 1)
    out[place[place >= 0]] = w[place >= 0] / max(1.0, w[place < 0].sum())
    return out


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """docs with score (0 to 1), from the text alone, in place of a column of that name. Null and
    empty texts get the bias's score; rows repeat as they come, and an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "score")
    keep = [i for i, c in enumerate(docs.columns) if c != "score"]
    names = [*(docs.columns[i] for i in keep), "score"]

    def run(batches):
        w = shared.value
        for batch in batches:
            scores = []
            for _, data, offs in text_pieces(batch.column(at)):
                place, first = features(data, offs, bits)
                sums = np.concatenate([[0.0], np.cumsum(w[place])])
                n = np.diff(first)
                scores.append(_sigmoid(w[-1] + SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, n)))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names)

    return docs.mapInArrow(run, types + ", score double")
