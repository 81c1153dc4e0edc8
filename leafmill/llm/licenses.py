"""License scans: matching statistics against a generalised suffix automaton of licence texts.

The automaton holds every run of words of all templates. A text is streamed through it word by word; at each word the
longest suffix that occurs in some template is known. Long matches are chained, in the order of text and template, into
spans, and the words of a template that a span covers are its score. Runs of words that no template has are skipped
without stepping, so ordinary prose costs a lookup a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafmill.llm.words import LOWER, NOT_ALNUM

# Phrases that name a licence, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of licence notices, by the label that they give.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "cc-by-4.0": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
}

_SPACES = bytes(0x20 if b in NOT_ALNUM else b for b in range(256))
_TABLE = bytes(_SPACES[b] for b in LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters outside ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of sequences of words. For each state: longest length, suffix link, edges by word,
    and for each sequence the longest suffix of its runs that stands there: (words, or None for all; its first end)."""

    def __init__(self, sequences: list[list[bytes]]):
        self.length, self.link, self.edges = [0], [-1], [{}]
        ends: dict[int, dict[int, int]] = defaultdict(dict)
        for s, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends[last].setdefault(s, i)
        order = sorted(range(1, len(self.length)), key=lambda v: self.length[v])
        for v in reversed(order):  # what ends in a state ends in those of its suffixes
            for s, i in ends[v].items():
                ends[self.link[v]][s] = min(i, ends[self.link[v]].get(s, i))
        self.reach: list[dict[int, tuple[int | None, int]]] = [{} for _ in self.length]
        for v in order:
            up = self.link[v]
            shorter = {s: (self.length[up] if n is None else n, i) for s, (n, i) in self.reach[up].items()}
            self.reach[v] = shorter | {s: (None, i) for s, i in ends[v].items()}

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The part of q that p leads to, as a state of its own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = clone
        while p >= 0 and self.edges[p].get(w) == q:
            self.edges[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: bytes) -> int:
        if (q := self.edges[p].get(w)) is not None:  # an earlier sequence has it
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.edges[p]:
            self.edges[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.edges[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each word."""
        state = size = 0
        for w in words:
            while state and w not in self.edges[state]:
                state = self.link[state]
                size = self.length[state]
            if (to := self.edges[state].get(w)) is None:
                size = 0
            else:
                state, size = to, size + 1
            yield size, state


class Scanner:
    """Finds base phrases and template spans in one text at a time."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int, gap: int, share: float):
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.automaton = Automaton(self.words)
        self.vocabulary = {w for t in self.words for w in t}
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.starts: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for words, label in self.phrases:
            self.starts[words[0]].append((words, label))
        self.least, self.gap, self.share = least, gap, share
        self.at: list[dict[tuple[bytes, ...], list[int]]] = []
        for own in self.words:
            places: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
            for t in range(len(own) - least + 1):
                places[tuple(own[t : t + least])].append(t)
            self.at.append(places)

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand."""
        out = []
        for first, candidates in self.starts.items():
            i = -1
            for _ in range(words.count(first)):
                i = words.index(first, i + 1)
                out += [(i, label) for phrase, label in candidates if words[i : i + len(phrase)] == phrase]
        return sorted(out)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Longest runs of at least `least` words that also stand in a template, for each template that has them:
        (template, place there, place, words)."""
        known = [w in self.vocabulary for w in words]
        out, i, n = [], 0, len(words)
        while i < n:
            try:
                i = known.index(True, i)
            except ValueError:
                break
            try:
                j = known.index(False, i)
            except ValueError:
                j = n
            if j - i >= self.least:
                run = [
                    {t: (size if n is None else n, end) for t, (n, end) in self.automaton.reach[state].items()} if size >= self.least else {}
                    for size, state in self.automaton.statistics(words[i:j])
                ]
                for k, (here, after) in enumerate(zip(run, [*run[1:], {}], strict=True)):
                    for template, (size, end) in here.items():
                        if size >= self.least and after.get(template, (0, 0))[0] <= size:  # it ends here
                            out.append((template, end - size + 1, i + k - size + 1, size))
            i = j
        return out

    def places(self, template: int, run: list[bytes]) -> list[int]:
        """All places where a run of words stands in a template."""
        own, n = self.words[template], len(run)
        return [t for t in self.at[template].get(tuple(run[: self.least]), ()) if own[t : t + n] == run]

    def _chain(self, found: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
        """Of matches (place, place in the template, words), sorted, the chain that covers the most of the template: places
        ascend on both sides, and no more than `gap` words lie between one match and the next."""
        best: list[tuple[int, int]] = []  # words covered by the best chain that ends here, and the match before
        longest = max(size for *_, size in found)
        for k, (here, there, size) in enumerate(found):
            value, before = size, -1
            for q in range(k - 1, -1, -1):
                h, t, n = found[q]
                if here - h > longest + self.gap:
                    break
                if h < here <= h + n + self.gap and t < there and (more := best[q][0] + size - max(0, t + n - there)) > value:
                    value, before = more, q
            best.append((value, before))
        k = max(range(len(best)), key=lambda k: best[k][0])
        value, chain = best[k][0], []
        while k >= 0:
            chain.append(found[k])
            k = best[k][1]
        return value, chain[::-1]

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of chains that cover at least `share` of one. What stands
        before and behind a chain is looked through likewise."""
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for template, _, here, size in self.matches(words):
            by[template] += [(here, there, size) for there in self.places(template, words[here : here + size])]
        out = []
        for template, found in by.items():
            todo = [sorted(found)]
            while todo:
                if not (part := todo.pop()):
                    continue
                covered, chain = self._chain(part)
                if (share := min(1.0, covered / len(self.words[template]))) < self.share:
                    continue
                begin, end = chain[0][0], max(h + n for h, _, n in chain)
                out.append((self.names[template], begin, end, share))
                todo += [[m for m in part if m[0] + m[2] <= begin], [m for m in part if m[0] >= end]]
        return sorted(out, key=lambda s: s[1:3])


_SPAN = [("label", pa.string(), T.StringType()), ("start", pa.int64(), T.LongType()), ("end", pa.int64(), T.LongType()), ("share", pa.float64(), T.DoubleType())]
_ROW = [("n_words", pa.int64(), T.LongType()), ("n_base", pa.int64(), T.LongType()), ("first_word", pa.int64(), T.LongType()), ("last_word", pa.int64(), T.LongType()), ("base_labels", pa.string(), T.StringType()), ("labels", pa.string(), T.StringType()), ("score", pa.float64(), T.DoubleType())]


def with_licenses(docs: DataFrame, text: str = "text", into: str = "license", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 4, gap: int = 12, share: float = 0.2) -> DataFrame:
    """docs with a struct in one more column: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of phrases; first_word and last_word are the smallest and largest of them, counted in words
    from 0, null without any. labels also holds templates of which a chain of matches of `least` words or more, at most
    `gap` words apart, covers `share` or more. score is the largest share covered, and 1 where a phrase stands. Labels
    are distinct, sorted and comma-joined, empty without any. Null texts have no words. Wording that several templates
    share counts for each. A column of the new one's name is replaced.
    """
    docs = docs.drop(into)
    at = docs.columns.index(text)
    templates, phrases = templates or TEMPLATES, phrases or BASE
    span_type = pa.list_(pa.struct([(n, a) for n, a, _ in _SPAN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, least, gap, share)
        for batch in batches:
            rows, spans = [], []
            for x in batch.column(at):
                words = words_of(x.as_py())
                base, found = scanner.base(words), scanner.spans(words)
                named = {label for _, label in base}
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(named)), ",".join(sorted(named | {s[0] for s in found})), 1.0 if base else max((s[3] for s in found), default=0.0)))
                spans.append([dict(zip((n for n, _, _ in _SPAN), s, strict=True)) for s in found])
            columns = [pa.array([r[i] for r in rows], a) for i, (_, a, _) in enumerate(_ROW)]
            struct = pa.StructArray.from_arrays([*columns, pa.array(spans, span_type)], names=[*(n for n, _, _ in _ROW), "spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, into])

    span = T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in _SPAN]))
    out = T.StructType([*(T.StructField(n, t) for n, _, t in _ROW), T.StructField("spans", span)])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, out)]))
