"""License scans: templates with optional and replaceable regions as automata over words.

A template is plain wording with markup: `[ ... ]` may be absent (and may nest), `{name:a-b}` stands for a to b
arbitrary words, `{name=x|y z}` for one of the given wordings. All other words are mandatory and must stand exactly,
in order (signs don't count). A template becomes a non-deterministic automaton over words; a text is accepted where a run from some word
reaches the end. Only places whose word can begin a template start a run, and only texts holding a word that
every accepted text of some template must hold are looked at closely.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a blank. Bytes from 0x80 on are kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases and labels of the base result.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wordings of public licenses and notices.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: [1.] Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """[3.] Neither the name of {who:1-14} nor the names of {whose=its|any} contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY {who:1-14} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {who:1-14} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {holder:1-12} BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, {link=and|and or} distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND {who:1-12} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who:1-12} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, versions: str) -> str:
    """The notice that the GNU licenses ask for."""
    return f"""{{what:1-4}} is free software[;] [:] you can redistribute it and/or modify it under the terms of the {name} as published by the
    Free Software Foundation, either version {{n={versions}}} of the License, or (at your option) any later version.
    {{what:1-4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
    [You should have received a copy of the {name} along with {{what:1-4}}[;] if not, {{where:1-20}}]"""


TEMPLATES = {
    "mit-notice": "[this {what:0-3} is] {verb=released|licensed|distributed|available|provided} under the [terms of the] MIT [x11] license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [the license]",
    "gpl-notice": "[this {what:0-3} is] {verb=licensed|released|distributed} under the [terms of the] GNU {kind=general|lesser general|affero general} public license [as published by the free software foundation] [either] version {n=1|2|2 1|3} [or [at your option] any later version] [of the license]",
    "cc-by-nc-4.0-notice": "[this {what:0-3} is] licensed under [a] {name=cc|creative commons} {terms=by nc|attribution noncommercial} [international] 4 0 [international] [license]",
    "cc-by-4.0-notice": "[this {what:0-3} is] licensed under [a] {name=cc|creative commons} {terms=by|attribution} [international] 4 0 [international] [license]",
    "mit": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [(including
        the next paragraph)] shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}""",
    "isc": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "0bsd": f"{_ISC_GRANT}. {_ISC_WARRANTY}",
    "bsd-2-clause": f"{_BSD} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD} {_BSD_THIRD} {_BSD_WARRANTY}",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at {address:1-12} Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at {address:1-8}""",
    "gpl-header": _gnu("GNU General Public License", "2|3"),
    "lgpl-header": _gnu("GNU {kind=lesser|library} General Public License", "2|2 1|3"),
    "agpl-header": _gnu("GNU Affero General Public License", "3"),
    "unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law. {_MIT_WARRANTY}
        [For more information, please refer to {{address:1-6}}]""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will {who=the authors|the author} be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        [1.] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an {word=acknowledgment|acknowledgement} in the product documentation would be appreciated but is not
        required. [2.] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. [3.] This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
        subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
        works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated
        by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL
        THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "cc0-notice": """To the extent possible under law, {who:1-14} {act=has waived|have waived|has dedicated|have dedicated} all copyright and
        related {link=or|and} neighboring rights to {work:1-14} [worldwide]""",
}


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(FOLD).split()


class Automaton:
    """One template. State 0 starts, state `end` accepts; any edge set may hold the key None, which takes every word."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes | None, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.size = 0
        must: list[bytes] = []
        at, opened = 0, []
        for part in re.findall(r"\{[^}]*\}|\[|\]|[^\s\[\]{}]+", template):
            if part == "[":
                opened.append(at)
            elif part == "]":
                self.free[opened.pop()].add(at)
            elif part[0] == "{" and "=" in part:
                begin, at = at, self._state()
                for wording in part[1:-1].partition("=")[2].split("|"):
                    self._line(begin, words_of(wording), at)
                self.size += 1
            elif part[0] == "{":
                low, high = map(int, part[1:-1].partition(":")[2].split("-"))
                line = [at]
                for _ in range(high):
                    line.append(self._state())
                    self.edges[line[-2]].setdefault(None, set()).add(line[-1])
                at = line[-1]
                for state in line[low:-1]:  # enough words: the rest of the region may be left out
                    self.free[state].add(at)
            else:
                for w in words_of(part):
                    to = self._state()
                    self.edges[at].setdefault(w, set()).add(to)
                    at = to
                    self.size += 1
                    if not opened:
                        must.append(w)
        self.end = at
        #: The longest word that every accepted text holds: texts without it are passed over.
        self.trigger = max(must, key=len)
        self.start = self.closure({0})
        self.first = set().union(*(self.edges[s] for s in self.start))

    def _state(self) -> int:
        self.edges.append({})
        self.free.append(set())
        return len(self.edges) - 1

    def _line(self, at: int, words: list[bytes], to: int) -> None:
        for i, w in enumerate(words):
            nxt = to if i == len(words) - 1 else self._state()
            self.edges[at].setdefault(w, set()).add(nxt)
            at = nxt

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def longest(self, words: list[bytes], at: int) -> int:
        """Number of words of the longest accepted run from words[at] on; 0 if there is none."""
        states, found, i = self.start, 0, at
        while states and i < len(words):
            w, nxt = words[i], set()
            for s in states:
                e = self.edges[s]
                nxt |= e.get(w, ()) or set()
                nxt |= e.get(None, ()) or set()
            states, i = self.closure(nxt), i + 1
            if self.end in states:
                found = i - at
        return found

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, number of words) of accepted runs, from left to right, none inside another."""
        found, upto = [], 0
        for i, w in enumerate(words):
            if i >= upto and (w in self.first or None in self.first) and (n := self.longest(words, i)):
                found.append((i, n))
                upto = i + n
        return found


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: Automaton(t) for label, t in templates.items()}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.triggers = {a.trigger for a in self.automata.values()} | {max(p, key=len) for p, _ in self.phrases}

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Number of words; base places and accepted templates as (label, first word, number of words)."""
        folded = text.translate(FOLD)
        words = folded.split()
        if not any(t in folded for t in self.triggers):
            return len(words), [], []
        base = [(label, i, len(p)) for p, label in self.phrases if p[-1] in folded for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
        held = set(words)
        found = [(label, i, n) for label, a in self.automata.items() if a.trigger in held for i, n in a.find(words)]
        taken, spans = bytearray(len(words)), []
        for label, i, n in sorted(found, key=lambda x: (-x[2], x[1], x[0])):  # the longest of templates that overlap
            if not any(taken[i : i + n]):
                taken[i : i + n] = b"\1" * n
                spans.append((label, i, n))
        return len(words), base, sorted(spans, key=lambda x: x[1])


def _score(n: int, base: list, spans: list) -> float:
    if spans:
        return 0.5 + 0.5 * sum(m for _, _, m in spans) / n
    return 0.5 if base else 0.0


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, word, words) of every row.

    Whole texts are read; null counts as empty. Of templates that overlap the longest is taken. The score is 0.5 and half
    the share of words that accepted templates cover; 0.5 where only base phrases stand; else 0. A row for each input row; repeated rows get equal results.
    """
    kinds = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))

    def run(it):
        scanner = Scanner(templates, phrases)
        for b in it:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column("text"):
                n, base, spans = scanner.scan(text.as_buffer().to_pybytes() if text.is_valid else b"")
                starts = [i for _, i, _ in base]
                labels = {x for x, _, _ in base}
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _, _ in spans})), _score(n, base, spans), [{"label": x, "word": i, "words": m} for x, i, m in spans])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,words:long>>")
