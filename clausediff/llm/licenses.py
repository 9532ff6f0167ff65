"""License scan by a generalised suffix automaton.

One automaton holds every factor of all templates, as sequences of words. A document's words
stream through it once, and the state after each word gives, for every template, the longest
run of words ending there that the template contains (its matching statistic): the state's own
templates by the length matched so far, the others by the first suffix link that has them. A
run that can't be made longer and has enough words is a match; matches of one template that
follow each other in both texts with small gaps are chained, and a chain that covers enough of
its template is a span. The automaton is built in each Python worker from the templates, a
parameter of fixed size; texts are read in pieces, so a long one needs no more memory than its
bytes and its spans.

Words of no template lead back to the root, so only runs of template words are walked.

Edges: null and empty texts have no words, no labels and score 0. Equal rows give equal results,
a null doc_id stays, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases of the base rule, and notices as the licenses' own texts and their
# stewards' instructions have them, with the label of each.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "released under the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

#: Words that a match has at least (all of a shorter template), words between two matches of a
#: chain at most, in either text, and the share of a template that a span covers at least.
LONG, GAP, COVERED = 5, 8, 0.8
#: Bytes of a text that are read at a time, about.
PIECE = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8: A-Z lower-cased, of digits, a to z and all beyond ASCII."""
    return _WORD.findall(text.encode().lower())


def pieces(data: bytes, most: int = PIECE):
    """data in pieces that cut no word."""
    at = 0
    while at < len(data):
        end = len(data)
        if at + most < end and (m := _OTHER.search(data, at + most)):
            end = m.end()
        yield data[at:end]
        at = end


class Automaton:
    """A generalised suffix automaton of word sequences.

    follow, link, length: as usual, state 0 being the root. matches[state]: for each template
    of the state or its links (template, longest length or 0 where the state's own match
    counts, ends of the run in the template), those long enough to matter."""

    def __init__(self, templates: list[list[int]], least: list[int]):
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in templates:
            last = 0
            for w in words:
                last = self._extended(last, w)
        ends: list[dict[int, list[int]]] = [{} for _ in self.follow]
        for t, words in enumerate(templates):
            state = 0
            for at, w in enumerate(words):
                state = self.follow[state][w]
                s = state
                while s > 0:
                    ends[s].setdefault(t, []).append(at)
                    s = self.link[s]
        self.matches: list[list[tuple[int, int, list[int]]]] = []
        for s in range(len(ends)):
            own, up = [(t, 0, e) for t, e in ends[s].items() if self.length[s] >= least[t]], self.link[s]
            have = set(ends[s])
            while up > 0:
                own += [(t, self.length[up], e) for t, e in ends[up].items() if t not in have and self.length[up] >= least[t]]
                have.update(ends[up])
                up = self.link[up]
            self.matches.append(own)

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest run and w, cut off from a state of longer runs where need be."""
        q = self.follow[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.follow[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, w: int) -> int:
        if w in self.follow[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.follow[p]:
            self.follow[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new


@dataclass
class Found:
    """What one text has: words so far, places of the base phrases, and spans."""

    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    score: float = 0.0


class Scanner:
    """Templates as an automaton, and the texts that stream through it."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, long: int = LONG, gap: int = GAP, covered: float = COVERED):
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.n_phrases, self.gap, self.covered = len(phrases), gap, covered
        split = [words_of(text) for _, text in [*phrases, *templates]]
        self.sizes = [len(w) for w in split]
        self.least = [n if t < self.n_phrases else min(long, n) for t, n in enumerate(self.sizes)]
        self.shortest = min(self.least)
        self.ids = {w: i for i, w in enumerate(sorted({w for words in split for w in words}), 1)}
        self.automaton = Automaton([[self.ids[w] for w in words] for words in split], self.least)

    def scan(self, text: str | None) -> Found:
        out = Found()
        self._state, self._matched, self._open, self._chains, self._spans = 0, 0, {}, {}, {}
        for piece in pieces((text or "").encode().lower()):
            words = _WORD.findall(piece)
            ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
            edges = np.flatnonzero(np.diff(ids > 0, prepend=False, append=False))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if a > 0:
                    self._broken(out)
                if b - a >= self.shortest or a == 0 or b == len(ids):
                    self._walk(ids[a:b].tolist(), out.n_words + a, out)
            if len(ids) and not ids[-1]:
                self._broken(out)
            out.n_words += len(words)
        self._broken(out)
        out.spans = sorted((a, b, t, c) for t, spans in self._spans.items() for a, b, c in spans)
        return out

    def _broken(self, out: Found) -> None:
        """A word of no template: all matches end before it."""
        if self._open:
            for t in list(self._open):
                self._ended(t, out)
        self._state = self._matched = 0

    def _walk(self, ids: list[int], at: int, out: Found) -> None:
        follow, link, length, matches = self.automaton.follow, self.automaton.link, self.automaton.length, self.automaton.matches
        state, matched = self._state, self._matched
        for w in ids:
            while state > 0 and w not in follow[state]:
                state = link[state]
                matched = length[state]
            if w in follow[state]:
                state, matched = follow[state][w], matched + 1
            here = matches[state]
            if here or self._open:
                self._update(here, matched, at, out)
            at += 1
        self._state, self._matched = state, matched

    def _update(self, here, matched: int, at: int, out: Found) -> None:
        now = {t: (n or matched, at, ends) for t, n, ends in here if (n or matched) >= self.least[t]}
        for t in list(self._open):
            if t not in now or now[t][0] != self._open[t][0] + 1:
                self._ended(t, out)
        for t, (n, end, ends) in now.items():
            if t < self.n_phrases:
                start = end - n + 1
                out.n_base += 1
                out.first, out.last = start if out.first is None else out.first if out.first < start else start, start if out.last is None else max(out.last, start)
                out.base.add(self.labels[t])
                out.score = 1.0
            else:
                self._open[t] = (n, end, ends)

    def _ended(self, t: int, out: Found) -> None:
        """Chains the match of t that just ended with those before it, at each of its places in t."""
        n, end, ends = self._open.pop(t)
        start = end - n + 1
        before = [c for c in self._chains.get(t, ()) if c[0] >= start - 1 - self.gap]
        new = []
        for e in ends:
            had, first = 0, start
            for doc_end, t_end, have, began in before:
                if t_end < e and doc_end < end and e - n - t_end <= self.gap:
                    gain = have - max(0, n - min(n, e - t_end, end - doc_end))
                    if gain > had or gain == had and gain > 0 and began > first:
                        had, first = gain, began
            new.append((end, e, had + n, first))
        self._chains[t] = before + new
        for _, _, have, first in new:
            share = have / self.sizes[t]
            out.score = max(out.score, share)
            if share >= self.covered:
                spans = self._spans.setdefault(t, [])
                if spans and first <= spans[-1][1]:
                    if have >= spans[-1][2]:
                        spans[-1] = (first, end, have)
                else:
                    spans.append((first, end, have))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,covered:double>>"
)


def license_spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, long: int = LONG, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """Per row of docs: doc_id, n_words, the base phrases' places (n_base, first_word, last_word,
    base_labels), labels of phrases and spans, score (the largest share of a template that a chain
    covers; 1 for a base phrase), and the spans, by their place."""

    def scanned(batches):
        scanner = Scanner(phrases, templates, long, gap, covered)
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column("text")]
            named = [[(scanner.labels[t], a, b, c / scanner.sizes[t]) for a, b, t, c in f.spans] for f in found]
            spans = [[dict(zip(("label", "first_word", "last_word", "covered"), s)) for s in row] for row in named]
            labels = [",".join(sorted(f.base | {s[0] for s in row})) for f, row in zip(found, named)]
            columns = [
                batch.column("doc_id"), pa.array([f.n_words for f in found], pa.int64()), pa.array([f.n_base for f in found], pa.int64()),
                pa.array([f.first for f in found], pa.int64()), pa.array([f.last for f in found], pa.int64()), pa.array([",".join(sorted(f.base)) for f in found], pa.string()),
                pa.array(labels, pa.string()), pa.array([min(f.score, 1.0) for f in found], pa.float64()), pa.array(spans, _SPANS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
