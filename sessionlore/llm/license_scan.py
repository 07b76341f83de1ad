"""Licence texts in documents, by a suffix automaton over the words of known templates.

One automaton holds every run of words of every template. Texts are streamed through it: after each word its state
tells the longest run ending there that some template has (the matching statistics). Runs that cannot be longer are
matches; matches that follow each other both in the text and in a template are chained, over gaps of changed or
added words, to the spans that cover the template.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from sessionlore.llm.decontaminate import words
from sessionlore.llm.texts import fields, map_texts

SCANNED = fields("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
                 "score double, span_labels array<string>, span_starts array<int>, span_ends array<int>, "
                 "span_shares array<double>")

# Phrases that name a licence, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# The customary notices of licences, as their publishers word them, and their labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. The software is provided as is, without warranty of any kind, express or implied, including but not "
            "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
               "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
               "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
               "the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
            "License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
             "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
            "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
            "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
            "provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
)


@dataclass(frozen=True)
class Settings:
    """Words of a match at least, words that a chain may skip on either side, share of a template that makes a span."""

    match: int = 3
    gap: int = 8
    share: float = 0.6


class Automaton:
    """Generalised suffix automaton of word sequences: a state for each set of places where runs of words end."""

    def __init__(self, templates: Sequence[Sequence[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.templates = [[number(w, len(self.vocabulary)) for w in t] for t in templates]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for t, ids in enumerate(self.templates):
            last = 0
            for place, c in enumerate(ids):
                last = self._extend(last, c)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add((t, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        #: Of each state the templates and places where its runs end.
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state after ``c`` that holds runs no longer than those of ``p`` and one word."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # another template has this run
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def stream(self, ids: Sequence[int]) -> tuple[list[int], list[int]]:
        """Matching statistics: after each word the state and the length of the longest run ending there."""
        state, length, states, lengths = 0, 0, [], []
        following, link, longest = self.next, self.link, self.length
        for c in ids:
            while c not in following[state] and state:
                state = link[state]
                length = longest[state]
            to = following[state].get(c)
            if to is not None:
                state, length = to, length + 1
            states.append(state)
            lengths.append(length)
        return states, lengths


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]], settings: Settings):
        self.settings = settings
        bodies = [words(p.encode()) for p, _ in phrases] + [words(n.encode()) for _, n in notices]
        if not all(bodies):
            raise ValueError("a phrase or notice without words")
        self.labels = [label for _, label in phrases] + [label for label, _ in notices]
        self.sizes = [len(b) for b in bodies]
        self.phrases = len(phrases)
        self.automaton = Automaton(bodies)
        # Phrases that a run of a state ends with, if it is as long as they are: those of the state and of its suffixes.
        self.named: list[list] = [[] for _ in self.automaton.next]
        for t in range(self.phrases):
            self.named[self.automaton.stream(self.automaton.templates[t])[0][-1]].append((t, self.sizes[t]))
        for state in sorted(range(1, len(self.named)), key=self.automaton.length.__getitem__):
            self.named[state] = self.named[state] + self.named[self.automaton.link[state]]
        self.least = min([settings.match, *self.sizes])

    def scan(self, ids: np.ndarray) -> tuple[list, list]:
        """Places (start, phrase) and spans (start, end, template, share) of one text of word numbers."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        places, matches = [], []
        for begin, end in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            if end - begin < self.least:
                continue
            states, lengths = self.automaton.stream(ids[begin:end].tolist())
            for i, (state, length) in enumerate(zip(states, lengths)):
                for phrase, size in self.named[state]:
                    if size <= length:
                        places.append((begin + i + 1 - size, phrase))
                if length >= self.settings.match and (i + 1 == len(lengths) or lengths[i + 1] <= length):
                    matches += [(begin + i + 1, length, t, stop) for t, stop in self.automaton.ends[state] if t >= self.phrases]
        return sorted(places), chain(matches, self.sizes, self.settings)


def chain(matches: list[tuple[int, int, int, int]], sizes: Sequence[int], settings: Settings) -> list[tuple]:
    """Spans (start, end, template, share) of chained matches (end in the text, length, template, end in it).

    A chain goes forward in the text and in the template and skips at most ``gap`` words of either; a match that
    overlaps the one before it counts from where that ends. The chains that cover most come first, and a match belongs
    to one chain only. The work is in proportion to the matches, each of which looks back over one gap.
    """
    out = []
    by: dict[int, list] = {}
    for stop, length, t, to in matches:
        by.setdefault(t, []).append((stop, length, to))
    for t, own in by.items():
        own.sort()
        best, before, open_ = [], [], 0
        for k, (stop, length, to) in enumerate(own):
            while own[open_][0] < stop - length - settings.gap:
                open_ += 1
            score, back = length, -1
            for j in range(open_, k):
                stop_j, _, to_j = own[j]
                new = min(length, stop - stop_j, to - to_j)
                if new > 0 and to - length - to_j <= settings.gap and best[j] + new > score:
                    score, back = best[j] + new, j
            best.append(score)
            before.append(back)
        used = [False] * len(own)
        for k in sorted(range(len(own)), key=lambda k: (-best[k], k)):
            path = []
            while k >= 0 and not used[k]:
                path.append(k)
                k = before[k]
            if not path:
                continue
            for i in path:
                used[i] = True
            covered = best[path[0]] - (best[k] if k >= 0 else 0)
            first = own[path[-1]]
            if covered >= settings.share * sizes[t]:
                out.append((first[0] - first[1], own[path[0]][0], t, min(1.0, covered / sizes[t])))
    return sorted(out)


@lru_cache(maxsize=2)
def scanner(phrases=PHRASES, notices=NOTICES, settings: Settings = Settings()) -> Scanner:
    return Scanner(phrases, notices, settings)


def find(texts: list[bytes | None], using: Scanner) -> list[list]:
    """Columns of ``SCANNED``."""
    get = using.automaton.vocabulary.get
    out: list[list] = [[] for _ in SCANNED]
    for text in texts:
        found = words(text)
        places, spans = using.scan(np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)))
        base = {using.labels[p] for _, p in places}
        row = (len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None,
               ",".join(sorted(base)), ",".join(sorted(base | {using.labels[t] for _, _, t, _ in spans})),
               max([s[3] for s in spans], default=0.0), [using.labels[s[2]] for s in spans], [s[0] for s in spans],
               [s[1] for s in spans], [s[3] for s in spans])
        for column, value in zip(out, row):
            column.append(value)
    return out


def scan_licenses(docs: DataFrame, *, phrases=PHRASES, notices=NOTICES, settings: Settings = Settings(),
                  text: str = "text") -> DataFrame:
    """``docs`` with ``SCANNED``: places of phrases, and spans of text that cover the templates of licences.

    Words are runs of digits, letters and characters beyond ASCII, lower-cased in A-Z. ``n_base`` counts the places
    where a phrase's words stand consecutively, ``first_word`` and ``last_word`` are their smallest and largest start.
    Spans start and end at words; a span's share is the part of its template that its chain covers, at least
    ``settings.share``; ``score`` is the largest share, 0 without a span. ``labels`` are those of phrases and spans.

    Null and empty texts have no words, no places and score 0. Every row is a document of its own, so repeated rows and
    rows without id get their own results; columns of ``docs`` named like the new ones give way to them. An empty
    table gives no rows. Templates are part of the program, of fixed size; there is no shuffle. The whole text is
    streamed; memory is that of one step of texts.
    """
    def compute(texts):
        return find(texts, scanner(tuple(phrases), tuple(notices), settings))

    return map_texts(docs, SCANNED, compute, text, 1 << 20)
