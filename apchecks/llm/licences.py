"""Licence scans by a generalised suffix automaton of licence templates.

The automaton is built once over the token sequences of all templates; each of its states knows in
which template and where its factors end first. A file is streamed through it: at each word it keeps the
longest suffix that is a factor of some template (the matching statistics). Right-maximal matches of
``min_match`` words or more become anchors (file place, template place, length); anchors of one template
are chained in increasing order in both, with bounded gaps, and a chain that covers enough of a template
is a labelled span. Short names of licences ("base" phrases) are templates as well and are always found
whole, wherever they stand.

Only words that some template knows can be matched. They are found for whole Arrow batches at once by
hash, and only runs of at least ``min_run`` such words are streamed; the words themselves are compared
there, so a hash never decides. The anchors of all runs of a document are chained together, at their
places in the document, so that a gap counts unknown words like any others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NOT_ALNUM, slices, word_hashes, words

#: Base phrases and their labels; fixed values of the query.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Well-known passages of public licences; a parameter of the scan.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "released under the MIT license",
        "licensed under the MIT license",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "under the terms of the GNU General Public License",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under CC BY-SA 4.0"],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "licensed under CC BY-NC 4.0",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "all-rights-reserved": ["all rights reserved"],
}

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def template_words(text: str) -> list[bytes]:
    data = text.translate(_ASCII_LOWER).encode()
    return bytes(b if not NOT_ALNUM[b] else 32 for b in data).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over integer tokens."""

    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    where: list[tuple[int, int]]  # a template and the place in it where the state's factors end

    @classmethod
    def build(cls, sequences: list[list[int]]) -> "Automaton":
        a = cls([{}], [-1], [0], [(-1, -1)])
        for t, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = a._extend(last, c, (t, i))
        return a

    def _new(self, length: int, where: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.where.append(where)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of ``q`` that is entered from ``p`` and its suffixes."""
        copy = self._new(self.length[p] + 1, self.where[q])
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int, where: tuple[int, int]) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._new(self.length[last] + 1, where)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For each token the state and length of the longest suffix that is a factor."""
        state = length = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield state, length


class Scanner:
    """Template vocabulary, automaton and chaining; built on the driver and sent to the tasks."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE_PHRASES,
                 min_match: int = 3, max_gap: int = 3, min_cover: float = 0.6):
        self.base = [(tuple(template_words(p)), label) for p, label in base.items()]
        texts = [(label, t) for label, ts in templates.items() for t in ts]
        sequences = [template_words(t) for _, t in texts]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(s) for s in sequences]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in [*sequences, *(p for p, _ in self.base)] for w in s}))}
        self.automaton = Automaton.build([[self.vocabulary[w] for w in s] for s in sequences])
        self.sequences = [[self.vocabulary[w] for w in s] for s in sequences]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.min_run = min([min_match, *(len(p) for p, _ in self.base)])
        self.base_ids = [(tuple(self.vocabulary[w] for w in p), label) for p, label in self.base]

    def base_places(self, tokens: list[int]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.base_ids:
            n = len(phrase)
            for i in range(len(tokens) - n + 1):
                if tokens[i] == phrase[0] and tuple(tokens[i : i + n]) == phrase:
                    found.append((i, label))
        return found

    def anchors(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """Matches that can't grow to the right: template, place there, place in the file, length."""
        out = []
        stats = [*self.automaton.statistics(tokens), (0, 0)]
        for i in range(len(tokens)):
            state, length = stats[i]
            if length >= self.min_match and stats[i + 1][1] <= length:
                piece = tokens[i - length + 1 : i + 1]
                # Every template that holds the factor gets the anchor, at each of its places there.
                for t, s in enumerate(self.sequences):
                    out += [(t, j, i - length + 1, length) for j in range(len(s) - length + 1) if s[j : j + length] == piece]
        return out

    def spans(self, anchors: Iterable[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Covered template spans of a file's anchors: label, first and last place in the file, share covered."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, at, place, length in anchors:
            by_template.setdefault(t, []).append((place, at, length))
        found = []
        for t, marks in by_template.items():
            marks.sort()
            chains: list[list[int]] = []  # first, last, template end, covered
            near: list[list[int]] = []  # those that a later anchor can still reach
            for place, at, length in marks:
                best = None
                near = [chain for chain in near if place - chain[1] - 1 <= self.max_gap]
                for chain in near:
                    gap_file, gap_template = place - chain[1] - 1, at - chain[2] - 1
                    if 0 <= gap_file <= self.max_gap and 0 <= gap_template <= self.max_gap and (best is None or chain[3] > best[3]):
                        best = chain
                if best is not None:
                    best[1], best[2], best[3] = place + length - 1, at + length - 1, best[3] + length
                else:
                    chains.append([place, place + length - 1, at + length - 1, length])
                    near.append(chains[-1])
            for first, last, _, covered in chains:
                if covered >= self.min_cover * self.sizes[t]:
                    found.append((self.labels[t], first, last, covered / self.sizes[t]))
        return found


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,last:long,covered:double>>"
)


def scan(documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Licences in whole texts of ``documents`` (doc_id, text).

    Words are maximal runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. Returns per row
    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (those and the spans' labels; distinct, sorted,
    comma-joined), score (largest share of a template that is covered, 1 with a base phrase) and the
    spans. A null text is an empty one: no words, no labels, score 0. Null ids and repeated rows are
    kept; an empty table gives no rows; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = sent.value
        terms = sorted(sc.vocabulary)
        joined = pa.array([b" ".join(terms).decode()])
        (one,) = slices(joined, limit=1 << 30)
        known = np.sort(word_hashes(one, words(one, NOT_ALNUM)))
        for batch in batches:
            for s in slices(batch.column("text")):
                w = words(s, NOT_ALNUM)
                h = word_hashes(s, w)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                row_of = np.repeat(np.arange(s.rows), w.counts())
                index = np.flatnonzero(hit)
                results: dict[int, tuple[list, list]] = {}
                if len(index):
                    new = np.ones(len(index), dtype=bool)
                    new[1:] = (np.diff(index) != 1) | (np.diff(row_of[index]) != 0)
                    begin = np.flatnonzero(new)
                    size = np.diff(np.append(begin, len(index)))
                    for b, n in zip(begin[size >= sc.min_run], size[size >= sc.min_run]):
                        first = int(index[b])
                        row = int(row_of[first])
                        tokens = [
                            sc.vocabulary.get(s.data[w.starts[k] : w.ends[k]].tobytes(), -1) for k in range(first, first + int(n))
                        ]
                        shift = first - int(w.first[row])
                        base, anchors = results.setdefault(row, ([], []))
                        base += [(i + shift, label) for i, label in sc.base_places(tokens)]
                        anchors += [(t, at, place + shift, length) for t, at, place, length in sc.anchors(tokens)]
                rows = s.rows
                columns: list[list] = [[] for _ in range(7)]
                for r in range(rows):
                    base, anchors = results.get(r, ((), ()))
                    spans = sc.spans(anchors)
                    base_labels = sorted({label for _, label in base})
                    labels = sorted({*base_labels, *(x[0] for x in spans)})
                    score = 1.0 if base else min(1.0, max((x[3] for x in spans), default=0.0))
                    for column, value in zip(
                        columns,
                        (
                            len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
                            ",".join(base_labels), ",".join(labels), score,
                            [{"label": a, "first": b, "last": c, "covered": d} for a, b, c, d in spans],
                        ),
                    ):
                        column.append(value)
                spans_type = pa.list_(
                    pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])
                )
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans_type]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(s.first, rows),
                        pa.array(w.counts().astype(np.int64)),
                        *(pa.array(c, t) for c, t in zip(columns, types)),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.mapInArrow(run, _SCHEMA)
