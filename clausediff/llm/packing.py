"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are tokenized and cut at whole sequences. The pieces' lengths form a histogram of
at most `size` bins; the lengths are placed longest first, each piece into the open pack with
the most room, or into a new one where that room is too small; equal packs are counted
together, so a whole count of them takes its pieces at a time. The result is a list of
packing patterns with counts, whose size depends on `size` alone, not on the corpus. Pieces
then find their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.common import stored, text_pieces, word_hashes, word_spans
from clausediff.llm.mixing import with_running

END_ID = 1
#: Parts of words whose ids a Python worker remembers (about 32 bytes each), and words that are tokenized whole.
REMEMBER, REMEMBER_WHOLE = 400_000, 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Kinds of bytes: white space, letters, digits, other ASCII, and what the quick way leaves to the whole tokenizer.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ODD  # apostrophe: "'s" and the like have rules of their own
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text in lower case, starts and ends of its parts, and which parts are words for the whole tokenizer.

    The tokenizer never joins text across ASCII white space. Words of ASCII letters, Latin-1
    letters (two bytes, the first of them C3), digits and ASCII signs fall into runs of
    letters, single digits and runs of signs; any other word stays whole, in its own case."""
    kind = _KIND[data]
    low = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        good = (second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)
        lead = lead[good]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] += (data[lead + 1] < 0x9F).astype(np.uint8) * 32
    kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = _ODD  # <| may begin a special token
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[offsets[:-1][offsets[:-1] < len(kind)]] = True
    inside = kind != _SPACE
    starts = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new)[1:], len(kind))[np.searchsorted(np.flatnonzero(new), starts)]
    whole = np.zeros(len(starts), bool)
    if (kind == _ODD).any():
        word_starts, word_ends, _ = word_spans(data, offsets)
        odd = np.add.reduceat((kind == _ODD).astype(np.int64), word_starts) > 0
        of = np.searchsorted(word_starts, starts, "right") - 1
        keep = ~odd[of]
        order = np.argsort(np.concatenate([starts[keep], word_starts[odd]]), kind="stable")
        starts, ends = (np.concatenate([x[keep], y[odd]])[order] for x, y in ((starts, word_starts), (ends, word_ends)))
        whole = (order >= keep.sum())
    return low, starts, ends, whole


class Known:
    """Sorted 64-bit keys with the ids that they stand for; forgets those used longest ago."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.key, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown."""
        self.now += 1
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at[self.key[at] != key] = -1
        self.used[at[at >= 0]] = self.now
        return at

    def add(self, key: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Takes in keys that are all new: n ids each, in a row in ids."""
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        n, ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
        used = np.concatenate([self.used, np.full(len(key), self.now, np.int32)])
        key = np.concatenate([self.key, key])
        order = np.argsort(key)
        if len(key) > self.most:
            old = np.partition(used, len(key) - self.most // 2)[len(key) - self.most // 2]
            order = order[(used[order] >= old) | (used[order] == self.now)]
        self.key, self.used, start, self.n = key[order], used[order], start[order], n[order]
        if len(order) < len(key):
            ids = gathered(ids, start, self.n)
            start = np.cumsum(self.n) - self.n
        self.start, self.ids = start, ids


def gathered(x: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """x[start : start + n] of each row, one after the other."""
    ends = np.cumsum(n)
    return x[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)]


class WordIds:
    """Ids of texts. Parts of words that the worker has met are remembered by a 64-bit hash;
    new ones go to the tokenizer's model many at a time, where a part's last id is one with the
    mark of a word's end. Words that don't fall into plain parts go through the whole tokenizer."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known = Known(remember)
        self.words: dict[bytes, bytes] = {}
        self.letters = dict(enumerate(_byte_letters()))
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # only the vocabulary that these rules belong to takes the quick way
        self.quick = bool(suffix) and all(self.of(w.encode()).tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("Thé x9!?", "ÀB12,", "a-b_c éàßÿ"))

    def _whole(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBER_WHOLE:
                self.words.clear()
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            found = self.words[word] = np.array(ids, "<u4").tobytes()
        return found

    def _model(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and all ids."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        text = b" ".join(words).decode("latin-1").translate(self.letters | {32: " "})
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the model's ids don't fall into the words that were given")
        return np.diff(ends, prepend=0), ids

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return self.piece(data, np.array([0, len(data)]))[0]

    def piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after the other, and where each text's ids begin and end."""
        if getattr(self, "quick", True):
            low, starts, ends, whole = parts(data, offsets)
        else:
            low, (starts, ends, _) = data, word_spans(data, offsets)
            whole = np.ones(len(starts), bool)
        plain = np.flatnonzero(~whole)
        key = word_hashes(low, starts[plain], ends[plain], False)
        one, first, which = np.unique(key, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.known.find(one) < 0)
        raw = low.tobytes()
        at = plain[first[new]]
        self.known.add(one[new], *self._model([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        place = np.searchsorted(self.known.key, one)[which]
        start, n, ids = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.known.ids
        start[plain], n[plain] = self.known.start[place], self.known.n[place]
        if whole.any():
            raw = data.tobytes()
            odd = [self._whole(raw[starts[i] : ends[i]]) for i in np.flatnonzero(whole)]
            n[whole] = [len(x) // 4 for x in odd]
            start[whole] = len(ids) + np.cumsum(n[whole]) - n[whole]
            ids = np.concatenate([ids, np.frombuffer(b"".join(odd), "<u4")])
        ends = np.concatenate([[0], np.cumsum(n)])
        return gathered(ids, start, n), ends[np.searchsorted(starts, offsets)]


_word_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids, with END_ID at the
    end, cut at multiples of size. A null or empty text has END_ID alone."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        ids = _word_ids.get(path)
        if ids is None:  # a Python worker serves many tasks
            ids = _word_ids[path] = WordIds(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = [[], [], [], [], []]
            for at, data, offs in text_pieces(batch.column(1), 1 << 19):
                all_ids, edges = ids.piece(data, offs)
                raw, edges = all_ids.tobytes(), (edges * 4).tolist()
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), at):
                    packed = raw[a:b] + end
                    n = len(packed) // 4
                    for start in range(0, n, size):
                        part = packed[start * 4 : (start + size) * 4]
                        for column, x in zip(out, (i, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(x)
            rest = [pa.array(c, pa.int64()) for c in out[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that use up the histogram, sums at most size each."""
    open_packs: dict[int, list] = defaultdict(list)  # room -> [count, lengths]
    rooms: list[int] = []
    done = []

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if not count:
            return
        if room == 0:
            done.append((count, lengths))
            return
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = size // length
                put(left // each, (length,) * each, size - each * length)
                put(min(1, left % each), (length,) * (left % each), size - (left % each) * length)
                break
            room = rooms[-1]
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                rooms.pop()
            # as many pieces in turn as these packs take while they have the most room
            rival = rooms[-1] if rooms else 0
            turns = min((room - rival) // length + 1, room // length)
            if count * turns <= left:
                put(count, lengths + (length,) * turns, room - turns * length)
                left -= count * turns
            else:
                whole, part = divmod(left, count)
                put(part, lengths + (length,) * (whole + 1), room - (whole + 1) * length)
                put(count - part, lengths + (length,) * whole, room - whole * length)
                left = 0
    return done + [pack for packs in open_packs.values() for pack in packs]


def places(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """For runs of equal length and consecutive rank: length, first rank, first sequence, offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, lengths in plan:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += count
            offset += n
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of
    each row of docs (doc_id, text). Repeated rows are packed as often as they come; an
    empty table gives no rows. Sequences hold their pieces without gaps from offset 0."""
    cut = stored(pieces(docs, tokenizer, size), "pieces", texts=True)
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    table = places(patterns(counts, size))
    before, total = {}, 0
    for n in sorted(counts):
        before[n] = total
        total += counts[n]
    first = np.zeros(size + 1, np.int64)
    for n, b in before.items():
        first[n] = b
    ranked = with_running(cut, [F.col("length"), F.col("doc_id"), F.col("start")], {"row": F.lit(1)}, "ranked")
    shared = docs.sparkSession.sparkContext.broadcast((table, first))

    def run(batches):
        (length, rank, sequence, offset), first = shared.value
        key = length * (1 << 44) + rank
        for batch in batches:
            n = batch.column(2).to_numpy()
            r = batch.column(5).to_numpy() - first[n]
            i = np.searchsorted(key, n * (1 << 44) + r, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[i] + r - rank[i]), pa.array(offset[i])], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row").mapInArrow(run, columns)
