"""Licence scan by a generalised suffix automaton of licence tokens.

The automaton holds every word sequence of the templates.  A text's words
stream through it, which gives at each word the length of the longest template
sequence that ends there (matching statistics).  The state and its suffix links
name every place of the templates that the text's last words stand at, and how
many of them.  Sequences of at least ``MATCH`` words that cannot be extended at
their place are kept, in every template that holds them; those in the same
order in text and template, with small gaps, are chained.
The share of the template that a chain covers is its score; a template's label
is given where half of it is covered.

Base labels come from fixed phrases, as consecutive words; they always stay.

Defined results: null and empty texts have no words, no places and score 0;
first_word and last_word are null without a base phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import textkit as T

#: words of a match that counts, and of a gap within a chain
MATCH, GAP = 4, 12
#: covered share of a template that gives its label
COVERED = 0.5

# fixed values: phrases and labels of the base rule
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# fixed values: public notices by label, as their licences give them
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
            "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
            "License for more details."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
               "implied. See the License for the specific language governing permissions and limitations under the "
               "License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text: str) -> list[bytes]:
    c = next(T.chunks(pa.array([text], pa.string())))
    buf = T.lower(c.buf)
    w = T.words(c, buf, T.ALNUM)
    return [buf[a:b].tobytes() for a, b in zip(w.start, w.end)]


class SuffixAutomaton:
    """All sub-sequences of several token sequences, each state with the places
    (sequence, index of the last token) where its sub-sequences end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        for tokens in sequences:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        self.places: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for n, tokens in enumerate(sequences):
            state = 0
            for i, t in enumerate(tokens):
                state = self.next[state][t]
                above = state
                while above > 0:
                    self.places[above].add((n, i))
                    above = self.link[above]

    def _state(self, length, link=-1, moves=None) -> int:
        self.next.append(dict(moves or {}))
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(t) == q:
            self.next[p][t] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:  # the sequence is known from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p != -1 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def statistics(self, tokens: list[int]):
        """(state, length) of the longest known sequence that ends at each token."""
        state, size = 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if t in self.next[state]:
                state, size = self.next[state][t], size + 1
            yield state, size

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(text start, sequence, its start, length) of every match, at every
        place of every sequence, that no token before or after extends."""
        out = []
        for i, (state, size) in enumerate(self.statistics(tokens)):
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            deeper: set[tuple[int, int]] = set()
            while size >= least:
                # what the deeper state does not hold shares no more than these words
                for n, end in self.places[state] - deeper:
                    own = self.sequences[n]
                    if end + 1 == len(own) or own[end + 1] != after:
                        out.append((i - size + 1, n, end - size + 1, size))
                deeper = self.places[state]
                state = self.link[state]
                size = self.length[state]
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        texts = [_words(t) for _, t in templates]
        phrase_words = [_words(p) for p in phrases]
        names = sorted({w for t in texts + phrase_words for w in t})
        self.token = {w: i for i, w in enumerate(names)}
        flat = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(x) for x in names])
        hashes = T.span_hashes(flat, np.concatenate([[0], ends[:-1]]), ends)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[self.token[w] for w in t] for t in texts])
        self.phrases = [([self.token[w] for w in p], label) for p, label in zip(phrase_words, phrases.values())]

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Template word of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], -1)

    def chains(self, tok: list[int]) -> dict[int, float]:
        """Covered share of each template, by its best chain."""
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for start, template, at, n in self.automaton.matches(tok, MATCH):
            spans.setdefault(template, []).append((start, at, n))
        out = {}
        for template, found in spans.items():
            best: list[tuple[int, int, int]] = []  # of the open chains: text end, template end, covered
            top = 0
            for start, at, n in sorted(found):
                gain = n
                for end, done, covered in best:
                    if end <= start <= end + GAP and done <= at <= done + GAP:
                        gain = max(gain, covered + n)
                best = [b for b in best if b[0] + GAP >= start]
                best.append((start + n, at + n, gain))
                top = max(top, gain)
            out[template] = top / self.sizes[template]
        return out

    def chunk(self, c: T.Chunk):
        """Rows of n_words, n_base, first_word, last_word, base_labels, labels, score."""
        buf = T.lower(c.buf)
        w = T.words(c, buf, T.ALNUM)
        tok = self.tokens(T.span_hashes(buf, w.start, w.end))
        doc = w.doc
        base = []
        for ids, label in self.phrases:
            m = len(tok) - len(ids) + 1
            if m <= 0:
                continue
            hit = np.ones(m, bool)
            for j, t in enumerate(ids):
                hit &= tok[j:m + j] == t
            hit &= doc[:m] == doc[len(ids) - 1:]
            base.extend((int(doc[p]), int(p), label) for p in np.flatnonzero(hit))
        places: dict[int, list] = {}
        for d, p, label in base:
            places.setdefault(d, []).append((p - int(w.first[d]), label))
        # runs of template words that are long enough to match
        known = np.concatenate([[False], tok >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        long = {}
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= MATCH:
                for d in range(int(doc[a]), int(doc[b - 1]) + 1):
                    long[d] = True
        for i in range(len(c)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            found = sorted(places.get(i, ()))
            labels = {x for _, x in found}
            score = 0.0
            method = set()
            if i in long:
                for template, share in self.chains(tok[a:b].tolist()).items():
                    score = max(score, share)
                    if share >= COVERED:
                        method.add(self.labels[template])
            if found:
                score = max(score, COVERED)
            yield (b - a, len(found), found[0][0] if found else None, found[-1][0] if found else None,
                   ",".join(sorted(labels)), ",".join(sorted(labels | method)), min(score, 1.0))


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id and FIELDS."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id").schema
    for f in FIELDS.split(", "):
        schema = schema.add(*f.split())
    names = schema.names
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        scanner = Scanner()
        for b in batches:
            for c in T.chunks(b.column(1)):
                cols = list(zip(*scanner.chunk(c)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c))] + [pa.array(list(v), k) for v, k in zip(cols, kinds)], names)

    return src.mapInArrow(run, schema)
