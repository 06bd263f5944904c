"""Licence scans by a generalised suffix automaton.

The automaton holds the words of all licence templates and of short licence phrases. Each file's words
are streamed through it; the state gives the longest stretch ending at a word that some template has
(the matching statistics). Long stretches of one template, in order and close together, are chained into
a span; a span that covers enough words labels the file, unless it meets one that covers more. Phrases are
found by the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.text import as_bytes

# Phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The wording of common licence notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "you are free to share copy and redistribute the material in any medium or format and adapt remix transform and build upon the material for any purpose even commercially you must give appropriate credit provide a link to the license and indicate if changes were made",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "bsl": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
}

# Licences as texts name them in one line, and as SPDX writes them; each is a template of its own.
GRANTS = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0", "gnu gpl version 2": "gpl-2.0", "gnu gpl version 3": "gpl-3.0", "gnu gpl v2": "gpl-2.0", "gnu gpl v3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "apache license version 2 0": "apache-2.0", "apache license 2 0": "apache-2.0",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl", "under the isc license": "isc", "under the zlib license": "zlib", "2 clause bsd license": "bsd-2-clause", "bsd 2 clause license": "bsd-2-clause", "3 clause bsd license": "bsd-3-clause", "bsd 3 clause license": "bsd-3-clause",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0 1 0": "cc0", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
}
SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")


def notices() -> list[tuple[str, str]]:
    """``label, words`` of all templates: whole notices, one-line grants, and SPDX lines."""
    spdx = [(i.lower(), " ".join(w.decode() for w in words(f"SPDX-License-Identifier: {i}".encode()))) for i in SPDX]
    return [*TEMPLATES.items(), *((label, text) for text, label in GRANTS.items()), *spdx]


#: Bytes of words: ASCII digits and letters, and all bytes of other characters.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text after lower-casing A-Z: digits, a-z and everything beyond ASCII."""
    return text.translate(_CLEAN).split()


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, size: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _extended(self, last: int, word: int) -> int:
        """The state of ``last``'s string with ``word`` after it, made if the automaton lacks it."""
        there = self.next[last].get(word)
        if there is not None and self.size[there] == self.size[last] + 1:
            return there
        new = None if there is not None else self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][word]
        if self.size[q] != self.size[p] + 1:
            copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = copy
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            q = copy
        if new is None:
            return q
        self.link[new] = q
        return new

    def add(self, text: int, sequence: list[int]) -> None:
        state = 0
        for at, word in enumerate(sequence):
            state = self._extended(state, word)
            self.ends[state].append((text, at))


class Scanner:
    """The automaton of templates and phrases, and the scan of one file's words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], shortest: int, gap: int, covered: int):
        self.gap = gap
        texts = [t.split() for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.lengths = [len(t) for t in texts]
        # a template with fewer words counts where all of it stands
        self.shortest, self.covered = ([min(least, n) for n in self.lengths] for least in (shortest, covered))
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.number: dict[bytes, int] = {}
        self.automaton = Automaton()
        for i, t in enumerate([*texts, *(p for p, _ in self.phrases)]):
            self.automaton.add(i, [self.number.setdefault(w.encode(), len(self.number) + 1) for w in t])
        a = self.automaton
        order = sorted(range(1, len(a.size)), key=a.size.__getitem__)
        # phrases that a state's string ends with, its own and those of its shorter suffixes
        self.phrase_ends: list[tuple[int, ...]] = [()] * len(a.size)
        for s in order:
            own = tuple(t - len(texts) for t, at in a.ends[s] if t >= len(texts) and at + 1 == len(self.phrases[t - len(texts)][0]) == a.size[s])
            self.phrase_ends[s] = own + self.phrase_ends[a.link[s]]
        # for each state, the templates and places where its string ends
        self.places: list[list[tuple[int, int]]] = [[x for x in e if x[0] < len(texts)] for e in a.ends]
        for s in reversed(order):
            self.places[a.link[s]] = sorted({*self.places[a.link[s]], *self.places[s]}) if a.link[s] > 0 else self.places[a.link[s]]

        # the fewest words of a state's string that count for any template
        self.least = [min((self.shortest[t] for t, _ in x), default=1 << 30) for x in self.places]
        # shorter ends of a state's string that count for further templates, such as a grant within a notice
        self.also: list[list[tuple[int, set[int]]]] = [[] for _ in a.size]
        for s in order:
            seen, p = {t for t, _ in self.places[s]}, a.link[s]
            while p > 0:
                if more := self.counted(a.size[p], p) - seen:
                    self.also[s].append((p, more))
                    seen |= more
                p = a.link[p]

    def counted(self, length: int, state: int) -> set[int]:
        """Templates for which a stretch counts."""
        return {t for t, _ in self.places[state] if length >= self.shortest[t]}

    def matched(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Matching statistics ``(place, length, state)``, where two words or more match, or one where a phrase is one word."""
        alone = any(len(p) == 1 for p, _ in self.phrases)
        again = np.append(ids[1:] > 0, False) | np.append(False, ids[:-1] > 0) if len(ids) else np.zeros(0, bool)
        known = np.flatnonzero((ids > 0) & (again | alone))
        state = length = 0
        before = -2
        for i, word in zip(known.tolist(), ids[known].tolist(), strict=True):
            # without a known word before it, a run begins
            state, length = self._step(state, length, word) if i == before + 1 else self._step(0, 0, word)
            if length > 1 or alone:
                yield i, length, state
            before = i

    def _step(self, state: int, length: int, word: int) -> tuple[int, int]:
        a = self.automaton
        while state and word not in a.next[state]:
            state = a.link[state]
            length = min(length, a.size[state])
        if word in a.next[state]:
            return a.next[state][word], length + 1
        return 0, 0

    def scan(self, text: bytes) -> dict:
        """Counts, places and labels of one file; see :func:`scan`."""
        found = words(text)
        ids = np.fromiter(map(self.number.get, found, repeat(0)), np.int32, len(found))
        starts, base, long = [], set(), []
        for at, length, state in self.matched(ids):
            for p in self.phrase_ends[state]:
                phrase, label = self.phrases[p]
                if len(phrase) <= length:
                    starts.append(at + 1 - len(phrase))
                    base.add(label)
            if length >= self.least[state]:
                counted = self.counted(length, state)
                if long and long[-1][0] == at - 1 and long[-1][1] == length - 1 and long[-1][3] <= counted:
                    long.pop()  # the same stretch of the same templates, longer
                long.append((at, length, state, counted))
            for shorter, templates in self.also[state]:
                if self.automaton.size[shorter] < length:
                    long.append((at, self.automaton.size[shorter], shorter, templates))
        spans = self._chained(long)
        score = max((covered / self.lengths[t] for t, _, _, covered in spans), default=0.0)
        labels = base | {self.labels[t] for t, _, _, _ in _foremost([s for s in spans if s[3] >= self.covered[s[0]]], self.lengths)}
        return {"n_words": len(found), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(1.0, max(score, 0.5 if starts else 0.0)), "spans": [{"label": self.labels[t], "first": a, "last": b, "covered": c} for t, a, b, c in spans]}

    def _chained(self, long: list[tuple[int, int, int, set[int]]]) -> list[tuple[int, int, int, int]]:
        """Spans ``(template, first word, last word, words covered)``: stretches in the template's order, at most ``gap`` words apart."""
        open_: dict[int, list[list[int]]] = {}
        done = []
        for at, length, state, templates in long:
            first = at - length + 1
            for t in templates:
                ends = [e for x, e in self.places[state] if x == t]
                chains = open_.setdefault(t, [])
                for chain in [c for c in chains if first - c[2] > self.gap + 1]:
                    chains.remove(chain)
                    done.append((t, chain[0], chain[2], chain[3]))
                for chain in chains:
                    if after := [e for e in ends if e > chain[1]]:
                        fresh = min(at - chain[2], min(after) - chain[1], length)
                        chain[1:] = [min(after), at, chain[3] + fresh]
                        break
                else:
                    chains.append([first, min(ends), at, length])
        done += [(t, c[0], c[2], c[3]) for t, chains in open_.items() for c in chains]
        return sorted(done, key=lambda x: (x[1], x[0]))


def _foremost(spans: list[tuple[int, int, int, int]], lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """Spans, sorted by their first words, without those that meet one that covers more words, or as many of a
    shorter template: licences share wording."""
    weight = [(covered, -lengths[t]) for t, _, _, covered in spans]
    behind, open_ = set(), []
    for i, (_, first, _, _) in enumerate(spans):
        open_ = [j for j in open_ if spans[j][2] >= first]
        behind |= {j for j in open_ if weight[j] < weight[i]}
        if any(weight[j] > weight[i] for j in open_):
            behind.add(i)
        open_.append(i)
    return [s for i, s in enumerate(spans) if i not in behind]


OUT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, covered: bigint>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, shortest: int = 6, gap: int = 12, covered: int = 12) -> DataFrame:
    """One row for each row of ``docs``: word and phrase counts, labels, a score and template spans.

    A stretch of at least ``shortest`` words of a template counts; stretches at most ``gap`` words apart
    chain; a span of ``covered`` words labels the file if no other such span that it meets covers more. Of a template
    with fewer words, such as a one-line grant, all must stand together. ``score`` is the largest covered share of a
    template, 0.5 at least where a phrase stands. Templates are by label, :func:`notices` by default. Null and empty texts have no words, empty labels, score
    0 and null places. Repeated rows are scanned alike; other columns are not read. The pass has no shuffle.
    """
    scanner = Scanner(notices() if templates is None else list(templates.items()), PHRASES if phrases is None else phrases, shortest, gap, covered)
    kinds = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), *[(n, pa.int64()) for n in ("first", "last", "covered")]])))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [{"doc_id": i, **scanner.scan(t)} for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_pylist(got, schema=kinds)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, OUT)
