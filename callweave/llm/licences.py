"""Licence scan by a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template and phrase. A text's words stream through it once and
give matching statistics: for each word the length of the longest run that ends there and occurs in a template.
A phrase stands where its own state lies on the suffix path of the current one. Runs of ``LEAST_RUN`` words or more
that can't be prolonged are anchors between text and template; anchors of one template no further than
``WIDEST_GAP`` words apart in the text are chained in the order of both, so that inserted or changed words only
interrupt a chain. A chain that covers enough of its template is a span of that licence.
"""

from __future__ import annotations

import functools
import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import free_name, frugal, table
from callweave.llm.terms import terms

LEAST_RUN, WIDEST_GAP = 4, 40
#: Share of a template's words that a chain must cover.
LEAST_COVER = 0.5

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of common licences and notices, by label.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
]


class SuffixAutomaton:
    """All runs of words of several sequences of small whole numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.follow: list[dict[int, int]] = [{}]
        self.shorter, self.length = [-1], [0]
        own_ends: list[list[tuple[int, int]]] = [[]]

        def state(length: int, follow: dict[int, int]) -> int:
            self.follow.append(follow)
            self.length.append(length)
            self.shorter.append(-1)
            own_ends.append([])
            return len(self.length) - 1

        def part(source: int, word: int, target: int) -> int:
            """A state for the runs of ``target`` no longer than one word after ``source``, taken out of it."""
            if self.length[target] == self.length[source] + 1:
                return target
            fresh = state(self.length[source] + 1, dict(self.follow[target]))
            self.shorter[fresh], self.shorter[target] = self.shorter[target], fresh
            while source >= 0 and self.follow[source].get(word) == target:
                self.follow[source][word] = fresh
                source = self.shorter[source]
            return fresh

        for which, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                known = self.follow[last].get(word)
                if known is not None:
                    last = part(last, word, known)
                else:
                    new, p = state(self.length[last] + 1, {}), last
                    while p >= 0 and word not in self.follow[p]:
                        self.follow[p][word] = new
                        p = self.shorter[p]
                    self.shorter[new] = part(p, word, self.follow[p][word]) if p >= 0 else 0
                    last = new
                own_ends[last].append((which, at + 1))
        self.ends = own_ends
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.shorter[s]].extend(self.ends[s])

    def state_of(self, words: list[int]) -> int:
        s = 0
        for w in words:
            s = self.follow[s][w]
        return s


class Scanner:
    """Phrases and templates as one automaton."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least_cover: float = LEAST_COVER):
        split = [(label, terms(text)) for label, text in templates]
        self.templates = [(label, len(words)) for label, words in split]
        self.least_cover = least_cover
        said = [(terms(p), label) for p, label in phrases.items()]
        self.known = {w: i for i, w in enumerate(sorted({w for words in [*[x[1] for x in split], *[x[0] for x in said]] for w in words}))}
        coded = [[self.known[w] for w in words] for words in [*[x[1] for x in split], *[x[0] for x in said]]]
        self.automaton = SuffixAutomaton(coded)
        self.marks: list[list[tuple[int, str]]] = [[] for _ in self.automaton.length]
        for (words, label), code in zip(said, coded[len(split) :], strict=True):
            self.marks[self.automaton.state_of(code)].append((len(words), label))
        for s in sorted(range(1, len(self.marks)), key=self.automaton.length.__getitem__):
            self.marks[s] = self.marks[s] + self.marks[self.automaton.shorter[s]]
        self.shortest = min((len(words) for words, _ in said), default=LEAST_RUN)

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(words before the end, length, state) of the longest known run that ends at each word, 0 left out."""
        follow, shorter, length = self.automaton.follow, self.automaton.shorter, self.automaton.length
        known = np.fromiter(map(functools.partial(_code, self.known), words), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        state = size = 0
        before = -1
        for i, word in zip(at.tolist(), known[at].tolist(), strict=True):
            if i != before + 1:
                state = size = 0
            before = i
            while state and word not in follow[state]:
                state = shorter[state]
                size = length[state]
            if word in follow[state]:
                state, size = follow[state][word], size + 1
                yield i + 1, size, state

    def scan(self, text: str | None) -> dict:
        """Words, places of phrases as (start, label), and covered spans as (label, start, end, share), ends exclusive."""
        words = terms(text)
        places: list[tuple[int, str]] = []
        anchors: list[list[tuple[int, int, int]]] = [[] for _ in self.templates]
        pending = None

        def settle() -> None:
            if pending and pending[1] >= LEAST_RUN:
                end, size, state = pending
                for which, stop in self.automaton.ends[state]:
                    if which < len(self.templates):
                        anchors[which].append((end - size, stop - size, size))

        for end, size, state in self.statistics(words):
            if size >= self.shortest:
                places += [(end - n, label) for n, label in self.marks[state] if n <= size]
            if pending and not (end == pending[0] + 1 and size == pending[1] + 1):
                settle()  # the run before couldn't be prolonged
            pending = (end, size, state)
        settle()
        spans = []
        for (label, size), own in zip(self.templates, anchors, strict=True):
            spans += [(label, a, b, covered / size) for a, b, covered in chains(own) if covered >= self.least_cover * size]
        return {"n_words": len(words), "places": sorted(places), "spans": sorted(spans, key=lambda s: (s[1], s[2], s[0]))}


def _code(known: dict[bytes, int], word: bytes) -> int:
    return known.get(word, -1)


def chains(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, covered words): the best chain of each group of (text start, template start, length).

    Groups are as far as anchors lie within ``WIDEST_GAP`` words of the text's words before them. A chain follows
    text and template forwards without overlap and covers as many words as it can; the first such wins.
    """
    out, group, reach = [], [], 0
    for a in sorted(anchors):
        if group and a[0] > reach + WIDEST_GAP:
            out.append(_chain(group))
            group, reach = [], 0
        group.append(a)
        reach = max(reach, a[0] + a[2])
    return [*out, _chain(group)] if group else out


def _chain(group: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The best chain of anchors in text order, by a staircase of template ends with the most words covered up to them."""
    waiting: list[tuple[int, int, int, int]] = []  # chains by their end in the text
    ends, covers, starts = [0], [0], [-1]
    best = (0, 0, 0)
    for text, template, size in group:
        while waiting and waiting[0][0] <= text:
            _, stop, cover, start = heapq.heappop(waiting)
            k = bisect_right(ends, stop)
            if covers[k - 1] >= cover:
                continue
            k -= ends[k - 1] == stop
            n = k
            while n < len(ends) and covers[n] <= cover:
                n += 1
            ends[k:n], covers[k:n], starts[k:n] = [stop], [cover], [start]
        k = bisect_right(ends, template) - 1
        cover, start = covers[k] + size, starts[k] if starts[k] >= 0 else text
        heapq.heappush(waiting, (text + size, template + size, cover, start))
        if cover > best[2]:
            best = (start, text + size, cover)
    return best


_RESULT = "n_words long, places array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,end:long,share:double>>"


def find_licences(docs: DataFrame, scanner: Scanner | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``licences``: n_words, places of phrases and covered template spans, in words from 0.

    Texts are read whole. Null and empty texts have no words and no finds. Of places with one start the label's order
    decides. All columns pass through; one that is named ``licences`` already makes the new one ``licences_``.
    """
    scanner = scanner or Scanner()

    @F.pandas_udf(_RESULT)
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [scanner.scan(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [f["n_words"] for f in found],
                    "places": [[{"start": s, "label": x} for s, x in f["places"]] for f in found],
                    "spans": [[{"label": x, "start": a, "end": b, "share": c} for x, a, b, c in f["spans"]] for f in found],
                }
            )

    return docs.withColumn(free_name(docs, "licences"), run(F.col(text)))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licences of every document; the score is the largest covered share, 1 where a whole phrase stands."""
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licences.*")
    base = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(share, F.lit(1.0))).alias("score"),
        "spans",
    )
