"""License scans with a generalised suffix automaton of license tokens.

The token sequences of all templates go into one suffix automaton. A text's words stream through it and give matching
statistics: at every word the longest run of words ending there that occurs in some template, and by the suffix links the
longest one of every other template. Maximal long matches are chained per template (in order in both, with bounded gaps)
into spans, all that don't overlap; a template's score is the share of its words that its best chain covers. The automaton has at most twice as many states as the templates have words, so its size is fixed
by the templates and doesn't grow with the corpus; the texts are read in one pass without a shuffle.

A match of ``min_match`` words needs that many words in a row that occur in templates at all, so only such runs stream
through the automaton; nothing that could match is left out.

Besides, places of the fixed phrases are reported as such. Null texts have no words; repeated rows give repeated rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import sliced
from codeloom.llm.common import alnum_words, id_text, id_type

MIN_MATCH = 6
MAX_GAP = 12
MIN_SCORE = 0.6
# Phrases and their labels, and the words of widespread public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    ("mit", "grant"): "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ("mit", "short"): "Released under the terms of the MIT License",
    ("apache", "notice"): "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ("apache", "short"): "Licensed under the Apache License, Version 2.0",
    ("gpl", "notice"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ("gpl", "short"): "This work is licensed under the GNU General Public License, version 3",
    ("mit", "warranty"): "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ("bsd", "warranty"): "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ("isc", "warranty"): "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ("zlib", "grant"): "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ("bsd", "grant"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ("isc", "grant"): "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ("mpl", "notice"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ("cc", "by"): "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ("unlicense", "notice"): "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of tokens; where[state]: {sequence: ends of its occurrences}."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.where: list[dict[int, set[int]]] = [{}]
        for k, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._add(last, token)
                self.where[last].setdefault(k, set()).add(at + 1)
        for state in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            for k, ends in self.where[state].items():
                self.where[self.link[state]].setdefault(k, set()).update(ends)

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.len.append(length)
        self.link.append(link)
        self.where.append({})
        return len(self.len) - 1

    def _split(self, p: int, token, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, token) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, token, q)
        return new

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest match that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if (to := self.next[state].get(token)) is not None:
                state, length = to, length + 1
            else:
                state = length = 0
            yield length, state


class Scanner:
    def __init__(self, templates: dict, min_match: int, max_gap: int):
        self.names = list(templates)
        self.words = [alnum_words(t) for t in templates.values()]
        self.vocabulary = {w for ws in self.words for w in ws}
        self.automaton = SuffixAutomaton(self.words)
        self.min_match, self.max_gap = min_match, max_gap

    def _ending(self, length: int, state: int) -> dict[int, tuple[int, int]]:
        """{template: (length, state) of its longest match that ends here}, for lengths of min_match or more."""
        out: dict[int, tuple[int, int]] = {}
        while state and length >= self.min_match:
            for k in self.automaton.where[state]:
                out.setdefault(k, (length, state))
            state = self.automaton.link[state]
            length = self.automaton.len[state]
        return out

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Matches (template, start in the text, start in the template, length) of min_match words or more that can't go on."""
        out, vocabulary, least, n = [], self.vocabulary, self.min_match, len(words)
        inside = [w in vocabulary for w in words]
        at = 0
        while at < n:
            try:
                at = inside.index(True, at)
            except ValueError:
                break
            try:
                stop = inside.index(False, at)
            except ValueError:
                stop = n
            if stop - at >= least:
                before: dict[int, tuple[int, int]] = {}
                for i, (length, state) in enumerate([*self.automaton.statistics(words[at:stop]), (0, 0)]):
                    here = self._ending(length, state) if length >= least else {}
                    for k, (m, s) in before.items():
                        if k not in here or here[k][0] <= m:
                            out += [(k, at + i - m, end - m, m) for end in self.automaton.where[s][k]]
                    before = here
            at = stop
        return out

    def chains(self, words: list[bytes]) -> list[tuple[float, int, int, int]]:
        """Chains that don't overlap, best first for each template that matches: (score, template, first word, end)."""
        of: dict[int, list[tuple[int, int, int]]] = {}
        for k, s, t, length in self.matches(words):
            of.setdefault(k, []).append((s, t, length))
        out = []
        for k, parts in of.items():
            parts.sort()
            best: list[tuple[int, int]] = []  # covered words, first word, by part
            low = 0
            for j, (s, t, length) in enumerate(parts):
                mine = (length, s)
                while low < j and parts[low][0] + len(self.words[k]) + self.max_gap < s:
                    low += 1
                for i in range(low, j):
                    ps, pt, plen = parts[i]
                    over = max(0, ps + plen - s, pt + plen - t)
                    if ps < s and pt < t and over < length and s - ps - plen <= self.max_gap and t - pt - plen <= self.max_gap:
                        mine = max(mine, (best[i][0] + length - over, best[i][1]))
                best.append(mine)
            taken: list[tuple[int, int]] = []  # spans, sorted
            for j in sorted(range(len(parts)), key=lambda j: (-best[j][0], best[j][1], j)):
                first, stop = best[j][1], parts[j][0] + parts[j][2]
                near = bisect(taken, (first, stop))
                if all(b <= first or a >= stop for a, b in taken[max(0, near - 1) : near + 1]):
                    taken.insert(near, (first, stop))
                    out.append((min(1.0, best[j][0] / len(self.words[k])), k, first, stop))
        return out


@lru_cache(maxsize=4)
def _scanner(templates: tuple, min_match: int, max_gap: int) -> Scanner:
    return Scanner(dict(templates), min_match, max_gap)


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    text, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at, seen, word = text.find(key), 0, 0
        while at >= 0:
            word += text.count(b" ", seen, at)
            seen = at
            out.append((word, label))
            at = text.find(key, at + 1)
    return sorted(out)


_OUT = "n_words long, places array<struct<word: long, label: string>>, spans array<struct<label: string, template: string, first: long, stop: long, score: double>>, score double"
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, *, templates: dict = TEMPLATES, phrases: dict = PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> DataFrame:
    """``doc_id, n_words, places, spans, score`` for every row: phrase places, all chains of every template, the best score."""
    fixed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(fixed, min_match, max_gap)
        for batch in batches:
            for part in sliced(batch):
                counts, places, spans, scores = [], [], [], []
                for text in part.column("text").to_pylist():
                    words = alnum_words(text)
                    chains = scanner.chains(words)
                    counts.append(len(words))
                    places.append([{"word": w, "label": x} for w, x in phrase_places(words, phrases)])
                    spans.append([{"label": scanner.names[k][0], "template": scanner.names[k][1], "first": a, "stop": b, "score": s} for s, k, a, b in sorted(chains, key=lambda c: c[1:])])
                    scores.append(max((c[0] for c in chains), default=0.0))
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, type=pa.int64()), pa.array(places, type=_PLACES), pa.array(spans, type=_SPANS), pa.array(scores, type=pa.float64())], names=["doc_id", "n_words", "places", "spans", "score"])

    return id_text(docs).mapInArrow(run, f"doc_id {id_type(docs)}, {_OUT}")


def report(docs: DataFrame, *, min_score: float = MIN_SCORE, **options) -> DataFrame:
    """The result of op10: counts and places of phrases, their labels, all labels, and the best template's score."""
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    own = F.transform(F.filter("spans", lambda s: s["score"] >= min_score), lambda s: s["label"])
    return scan(docs, **options).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, own)).alias("labels"),
        "score",
    )
