"""Licence detection by matching statistics over a generalised suffix automaton of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import text_of

# The phrases whose every place is reported, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Texts of short licences, and notices that long ones ask to be kept in files.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "bsl": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}
#: Words of a match that counts for a template; words between two matches that one span may bridge;
#: share of a template's words that the matches of a span must cover, in order, to give its label.
LEAST_MATCH, GAP, COVER = 6, 8, 0.5

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words, A-Z lower-cased: runs of digits, letters and anything beyond ASCII."""
    return text.encode().translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences: a state for each class of substrings that
    end at the same places, with suffix links to the next shorter class."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: A sequence and the place after its last token, for one occurrence of the state.
        self.ends: list[tuple[int, int]] = [(-1, 0)]
        self.where: list[list[tuple[int, int]]] = [[]]
        for s, tokens in enumerate(sequences):
            last = 0
            for k, token in enumerate(tokens):
                last = self._extend(last, token, (s, k + 1))
                self.where[last].append((s, k + 1))
        # All ends of a state: its own and those of the states that link to it.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.where[self.link[state]] += self.where[state]
        self.where = [sorted(set(x)) for x in self.where]

    def _state(self, length: int, link: int, moves: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(end)
        self.where.append([])
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The state of the longest string of ``state`` and then ``token``, parted off if need be."""
        there = self.next[state][token]
        if self.length[there] == self.length[state] + 1:
            return there
        copy = self._state(self.length[state] + 1, self.link[there], dict(self.next[there]), self.ends[there])
        self.link[there] = copy
        while state >= 0 and self.next[state].get(token) == there:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int, end: tuple[int, int]) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {}, end)
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, token)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token: the state and length of the longest match that ends with it."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield state, length


class LicenceScanner:
    def __init__(self):
        names = [*PHRASES.items(), *((text, label) for label, texts in TEMPLATES.items() for text in texts)]
        split = [words_of(text) for text, _ in names]
        self.labels = [label for _, label in names]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        self.token = vocabulary.get
        sequences = [[vocabulary[w] for w in words] for words in split]
        self.sizes = list(map(len, sequences))
        self.automaton = SuffixAutomaton(sequences)
        # The phrases that a match at a state ends with, of any length that the match has.
        self.phrases: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.next)):
            found = []
            while state > 0:
                found += [(self.sizes[s], self.labels[s]) for s, end in self.automaton.where[state] if s < len(PHRASES) and end == self.sizes[s] and self.automaton.length[self.automaton.link[state]] < end <= self.automaton.length[state]]
                state = self.automaton.link[state]
            self.phrases.append(sorted(set(found)))

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words; phrases as (first word, label); spans as (first word, word after the
        last, label, share of the template covered)."""
        words = words_of(text)
        tokens = list(map(self.token, words))
        bases: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        # Only runs of two or more words that some template has can hold a phrase or a match.
        known = np.array([t is not None for t in tokens], np.int8)
        edges = np.diff(np.concatenate(([0], known, [0])))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if b - a < 2:
                continue
            before = (0, 0)
            for k, (state, length) in enumerate(self.automaton.statistics(tokens[a:b]), a):
                for size, label in self.phrases[state]:
                    if size <= length:
                        bases.append((k + 1 - size, label))
                # A match is as long as can be when the next one is not its continuation.
                if before[1] >= LEAST_MATCH and length <= before[1]:
                    matches.append((k - before[1], k, before[0]))
                before = (state, length)
            if before[1] >= LEAST_MATCH:
                matches.append((b - before[1], b, before[0]))
        return len(words), sorted(bases), self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Matches of a template, at their places in it, are chained where they follow each other in
        the text (within GAP words) and in the template; no word of either counts twice. A chain
        that covers COVER of its template is a span; of a label's overlapping spans the one with
        the largest share stays (the first of equals)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for a, b, state in matches:
            for s, end in self.automaton.where[state]:
                if s >= len(PHRASES):
                    by_template.setdefault(s, []).append((a, b, end))
        found: dict[str, list[tuple[float, int, int]]] = {}
        for s, places in by_template.items():
            for start, stop, covered in chains(places):
                if covered >= COVER * self.sizes[s]:
                    found.setdefault(self.labels[s], []).append((-covered / self.sizes[s], start, stop))
        spans = []
        for label, some in found.items():
            kept: list[tuple[int, int]] = []
            for share, start, stop in sorted(some):
                if all(stop <= a or start >= b for a, b in kept):
                    kept.append((start, stop))
                    spans.append((start, stop, label, -share))
        return sorted(spans)


def chains(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """For matches (first word, word after the last, place in the template after the last), the best
    chain that ends with each: (start, stop, words covered).

    The next match of a chain begins no earlier and ends later in the text, begins at most GAP words
    after the last one's end, and ends later in the template; where the two overlap in text or
    template, only its words beyond the overlap count, and there must be some.
    """
    best: list[tuple[int, int, int, int, int]] = []
    near: list[int] = []
    for a, b, end in sorted(places):
        start, covered = a, b - a
        near = [k for k in near if best[k][1] + GAP >= a]
        for k in near:
            first, stop, at, held, begun = best[k]
            more = b - a - max(0, at - (end - (b - a)), stop - a)
            if begun <= a and b > stop and end > at and more > 0 and held + more > covered:
                start, covered = first, held + more
        near.append(len(best))
        best.append((start, b, end, covered, a))
    return [(start, stop, covered) for start, stop, _, covered, _ in best]


_scanner: list[LicenceScanner] = []


def scanner() -> LicenceScanner:
    if not _scanner:
        _scanner.append(LicenceScanner())
    return _scanner[0]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases and template matches come from one pass of the text's words through the automaton.
    Matches of LEAST_MATCH words and more are chained in order per template; a span that covers
    COVER of a template gives its label. score is 1 with a base phrase, else the best cover. spans lists
    start:end:label of the template spans, in words.

    Null texts count as empty (0 words, empty labels); null and repeated ids keep their rows; an
    empty table gives no rows; other columns are not read.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            out = []
            for text in batch.column(1):
                n, bases, spans = scan(text.as_py())
                base = {x for _, x in bases}
                score = 1.0 if bases else max((x[3] for x in spans), default=0.0)
                out.append((n, len(bases), bases[0][0] if bases else None, bases[-1][0] if bases else None, ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in spans})), score, ",".join(f"{a}:{b}:{x}" for a, b, x, _ in spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
