"""Licence scans: matching statistics of texts against a suffix automaton of licence templates, chained into spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a match that can be part of a chain.
MIN_MATCH = 4
#: Words that a chain may skip at a time, in the text or in the template.
MAX_GAP = 12
#: Share of a template's words from which a chain counts as the template.
MIN_COVERAGE = 0.75
_PIECE = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Phrases that count wherever they stand, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Public licence lines and notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text (runs of digits, ASCII letters and other than ASCII characters; A-Z lower-cased), piece by piece."""
    text = text.lower()  # of bytes: ASCII letters only
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and (tail := _WORD.match(text, end)):
            end = tail.end()
        yield _WORD.findall(text, at, end)
        at = end


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences: a state for each class of runs that end at the same places."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: (template, last word) of the runs of a state, for states with runs of MIN_MATCH words or more.
    ends: list[list[tuple[int, int]]] = field(default_factory=list)
    #: (phrase, words) of the phrases that end where a state's runs end.
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    @classmethod
    def over(cls, templates: Iterable[str], phrases: Iterable[str]) -> Automaton:
        """Of all templates and phrases; only templates have places that chains use."""
        auto = cls()
        split = lambda t: [w for part in words_of(t.encode()) for w in part]
        own = [split(t) for t in templates]
        marks = [split(p) for p in phrases]
        ends: list[tuple[int, int, int]] = []
        for k, words in enumerate([*own, *marks]):
            last = 0
            for i, w in enumerate(words):
                last = auto._extend(last, auto.vocabulary.setdefault(w, len(auto.vocabulary)))
                if k < len(own):
                    ends.append((last, k, i))
        auto.sizes = [len(w) for w in own]
        auto.ends = [[] for _ in auto.step]
        # A place of a run is one of all its suffixes.
        for state, k, i in ends:
            while state > 0 and auto.longest[state] >= MIN_MATCH:
                auto.ends[state].append((k, i))
                state = auto.link[state]
        auto._mark(marks)
        return auto

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, w, q)
        new = self._state(self.longest[last] + 1, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.step[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, longest: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.longest.append(longest)
        return len(self.step) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        """A state of q's shorter runs, those that also end elsewhere."""
        new = self._state(self.longest[p] + 1, dict(self.step[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _mark(self, marks: list[list[bytes]]) -> None:
        """A phrase ends wherever a run of its state or of a state below ends, if the run is as long as the phrase."""
        own: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for k, words in enumerate(marks):
            state = 0
            for w in words:
                state = self.step[state][self.vocabulary[w]]
            own[state].append((k, len(words)))
        self.phrases = [[] for _ in self.step]
        for state in sorted(range(1, len(self.step)), key=self.longest.__getitem__):  # links lead to shorter runs
            self.phrases[state] = own[state] + self.phrases[self.link[state]]


@dataclass
class Chain:
    """Matches of one template, in order in it and in the text."""

    first: int
    last: int
    t_last: int
    covered: int


@dataclass
class Found:
    """What a text holds: its words, how often each phrase stands and where first and last, spans (template, first, last
    word, covered)."""

    n_words: int = 0
    places: Counter = field(default_factory=Counter)
    first_place: int | None = None
    last_place: int | None = None
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)


class Chains:
    """Chains that are still open, by template; ``done`` takes a template's closed ones, of overlapping ones the fullest."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.open: dict[int, list[Chain]] = {}
        self.done: dict[int, list[Chain]] = {}

    def add(self, template: int, at: int, t_at: int, n: int) -> None:
        """A match of ``n`` words that ends at word ``at`` of the text and ``t_at`` of the template: it goes on the chain
        that then covers most, or begins one."""
        live = []
        best, gain = None, 0
        for c in self.open.get(template, ()):
            if at - n - c.last > MAX_GAP:
                self._close(template, c)
                continue
            live.append(c)
            # Words that the chain has already, in the text or in the template, don't count again.
            new = min(n, at - c.last, t_at - c.t_last)
            skipped = max(at - new - c.last, t_at - new - c.t_last)
            if new > 0 and skipped <= MAX_GAP and c.covered + new > (best.covered + gain if best else 0):
                best, gain = c, new
        if best:
            best.last, best.t_last, best.covered = at, t_at, best.covered + gain
        else:
            live.append(Chain(at - n + 1, at, t_at, n))
        self.open[template] = live

    def _close(self, template: int, c: Chain) -> None:
        done = self.done.setdefault(template, [])
        while done and done[-1].last >= c.first and done[-1].first <= c.last:
            if done[-1].covered >= c.covered:
                return
            done.pop()
        done.append(c)

    def close(self) -> list[tuple[int, int, int, int]]:
        for template, live in self.open.items():
            for c in sorted(live, key=lambda c: (c.first, c.last)):
                self._close(template, c)
        return sorted((k, c.first, c.last, c.covered) for k, done in self.done.items() for c in done)


def scan(text: bytes, auto: Automaton) -> Found:
    """Reads a text word by word, holding the longest run of words up to here that some template or phrase has.

    Where a run can't be extended it is a match, at all its places in templates.
    """
    found, chains = Found(), Chains(auto.sizes)
    step, link, longest, ends, phrases, number = auto.step, auto.link, auto.longest, auto.ends, auto.phrases, auto.vocabulary.get
    state = n = at = 0

    def match(upto: int) -> None:
        if n >= MIN_MATCH:
            for template, t_at in ends[state]:
                chains.add(template, upto, t_at, n)

    for piece in words_of(text):
        for w in map(number, piece):
            if w is None:
                if state:
                    match(at - 1)
                    state = n = 0
            else:
                if w not in step[state]:
                    match(at - 1)
                    while state and w not in step[state]:
                        state = link[state]
                        n = longest[state]
                if w in step[state]:
                    state, n = step[state][w], n + 1
                    for k, size in phrases[state]:
                        if n >= size:
                            found.places[k] += 1
                            start = at - size + 1
                            found.first_place = start if found.first_place is None else min(found.first_place, start)
                            found.last_place = start if found.last_place is None else max(found.last_place, start)
            at += 1
    match(at - 1)
    found.n_words, found.spans = at, chains.close()
    return found


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of ``docs``.

    Base places are those of ``phrases``: their number, the smallest and largest word they start at (words from 0), and
    their labels.  Matches of ``MIN_MATCH`` words or more that follow each other in the text as in a template form a
    chain; ``spans`` lists those that cover ``min_coverage`` of their template or more, with label, first and last word
    and coverage, and ``labels`` their labels with the base ones.  ``score`` is the highest coverage of any chain, 1
    where a phrase stands.  A null or wordless text has none of it: 0 words, null places, empty labels, score 0.  Rows
    repeat as in ``docs``; only doc_id and text are read.  Each task holds the automaton of the templates and one text.
    """
    auto = docs.sparkSession.sparkContext.broadcast(Automaton.over([t for _, t in templates], [p for p, _ in phrases]))
    names, base = [n for n, _ in templates], [n for _, n in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.binary()):
                f = scan(text.as_py() or b"", auto.value)
                full = [(names[k], a, b, c / auto.value.sizes[k]) for k, a, b, c in f.spans]
                spans = sorted({s for s in full if s[3] >= min_coverage}, key=lambda s: (s[1], s[2], s[0]))
                own = {base[k] for k in f.places}
                score = 1.0 if own else max((s[3] for s in full), default=0.0)
                rows.append((f.n_words, f.places.total(), f.first_place, f.last_place, ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score,
                             [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), shape)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
    )
