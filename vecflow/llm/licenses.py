"""Licence scans: matching statistics of a generalised suffix automaton, chained into covered template spans."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vecflow.llm.common import map_batches, texts

# fixed values: phrases that name a licence
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: the published notices
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy
of this license, visit http://creativecommons.org/licenses/by/4.0/""",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
FOUND = (
    "n_words long, places array<struct<label:string,start:long,words:long>>,"
    " spans array<struct<label:string,start:long,end:long,covered:long,share:double>>"
)


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """A suffix automaton of several token sequences; each state knows where its words end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> first position after the state's words
        for number, sequence in enumerate(sequences):
            last, path = 0, []
            for token in sequence:
                last = self._append(last, token)
                path.append(last)
            for end, state in enumerate(path, 1):
                while state > 0 and number not in self.ends[state]:
                    self.ends[state][number] = end
                    state = self.link[state]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The successor of a state that holds no longer words than the state's own, one token on."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.ends[twin] = dict(self.ends[target])
        self.link[target] = twin
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _append(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for token in sequence:
            state = self.next[state][token]
        return state


class Scanner:
    """Streams the words of a text through the automaton of all templates and phrases."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, max_gap: int, min_share: float):
        self.min_match, self.max_gap, self.min_share = min_match, max_gap, min_share
        self.labels = list(templates)
        sequences = [words(x) for x in templates.values()] + [words(x) for x in phrases]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in sequences]
        self.sizes = [len(x) for x in coded[: len(templates)]]
        self.automaton = a = Automaton(coded)
        own: dict[int, list[tuple[str, int]]] = {}
        for label, sequence in zip(phrases.values(), coded[len(templates):]):
            own.setdefault(a.state_of(sequence), []).append((label, len(sequence)))
        # phrases that end wherever a state's words end: the state's own and those of its suffix links
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.phrases[state] = own.get(state, []) + self.phrases[a.link[state]]

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, phrase places (label, start, words), template spans (label, start, end, covered, share)."""
        found = words(text)
        get, a = self.vocabulary.get, self.automaton
        following, link, length, marks = a.next, a.link, a.length, self.phrases
        state = matched = 0
        before, places, matches = -2, [], []
        for i, token in [(i, t) for i, t in enumerate(map(get, found)) if t is not None]:
            reached, reach = state, matched
            if i != before + 1:
                state = matched = 0
            while state and token not in following[state]:
                state = link[state]
                matched = length[state]
            if token in following[state]:
                state = following[state][token]
                matched += 1
            if reach >= self.min_match and (i != before + 1 or matched != reach + 1):
                matches.append((before + 1, reach, reached))
            for label, size in marks[state]:
                if size <= matched:
                    places.append((label, i + 1 - size, size))
            before = i
        if matched >= self.min_match:
            matches.append((before + 1, matched, state))
        return len(found), places, self._chain(matches) if matches else []

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple]:
        """Colinear matches of one template, at most ``max_gap`` words apart, are one span."""
        spans = []
        for number, label in enumerate(self.labels):
            placed = [(end - size, end, self.automaton.ends[s][number]) for end, size, s in matches if number in self.automaton.ends[s]]
            chains: list[list[int]] = []  # start, end, end in the template, covered words
            for start, end, there in placed:
                best = None
                for chain in reversed(chains):
                    if start - chain[1] > self.max_gap:
                        break
                    fresh = min(end - max(start, chain[1]), there - max(there - (end - start), chain[2]))
                    if fresh > 0 and there - (end - start) - chain[2] <= self.max_gap and (best is None or chain[3] > best[0][3]):
                        best = (chain, fresh)
                if best:
                    best[0][1:] = [end, there, best[0][3] + best[1]]
                    chains.sort(key=lambda c: c[1])
                else:
                    chains.append([start, end, there, end - start])
            for start, end, _, covered in chains:
                if covered >= self.min_share * self.sizes[number]:
                    spans.append((label, start, end, covered, covered / self.sizes[number]))
        return sorted(spans, key=lambda s: (s[1], s[0]))


def scan(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 5,
    max_gap: int = 30,
    min_share: float = 0.3,
) -> DataFrame:
    """(id, n_words, places, spans) per row: all places of the phrases and the spans that cover ``min_share`` of a template.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased, counted from 0. A null text is
    empty: 0 words, no places. Every row gives a row, also repeated ones and those without an id; other columns are
    not read. Whole texts are streamed; memory follows one text. No shuffle.
    """
    chosen, named = templates or TEMPLATES, phrases or PHRASES

    def make():
        scanner = Scanner(chosen, named, min_match, max_gap, min_share)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, places, spans = zip(*map(scanner.scan, texts(batch, "text")))
            place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
            span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
            records = lambda rows, kind: pa.array([[dict(zip([f.name for f in kind], x)) for x in r] for r in rows], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), records(places, place), records(spans, span)], ["id", "n_words", "places", "spans"]
            )

        return work

    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, make, f"id {kind}, {FOUND}").withColumnRenamed("id", id)


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The report of a scan: counts, first and last place, labels, and the largest covered share (a phrase counts as whole)."""
    starts, spans = F.col("places.start"), F.col("spans")
    return found.select(
        id,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
        F.size(spans).cast("long").alias("n_spans"),
    )
