"""License scans by patience alignment of texts with license templates.

A text's words are looked up in the words of all templates once; a template is
tried where a stretch of the text about as long as the template holds enough of
its words. Stretch and template are then aligned: words that occur once in both
are anchors, the longest increasing subsequence of anchors is kept, and the gaps
between them are aligned the same way, after equal words at both ends are taken
off. Coverage is the share of the template's words that are aligned. All
words that tell licenses apart (names, versions, NC, SA, ND) must be aligned, with
no other such word between. Short notices must not follow a negation, and phrases
of under five words stand as they are. Full texts of Apache-2.0, GPL, LGPL, AGPL, MPL, CC0 and
Unlicense are not among the templates. Where several templates fit one place, the one with most aligned words is reported.

Cases: a null or blank text has no license; repeated rows give repeated results;
a license that stands twice in a text is reported twice; the place of a template
is a range of word numbers, the end exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.common import prepare, texts

COVERAGE = 0.8
#: Notices and texts of well-known public licenses (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
}

_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.")
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + _BSD_3 + _BSD_END
TEMPLATES["BSD-2-Clause"] += _BSD_END
TEMPLATES["BSD-notice"] = "Released under the BSD License."
for _name, _words in {"GPL-2.0": ("General", "2"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"),
                      "AGPL-3.0": ("Affero General", "3")}.items():
    for _kind in ("notice", "header"):
        TEMPLATES[f"{_name}-{_kind}"] = TEMPLATES[f"GPL-3.0-{_kind}"].replace("General", _words[0]).replace(
            "version 3", f"version {_words[1]}")
for _variant in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    TEMPLATES[f"CC-{_variant}-4.0-short-notice"] = f"Licensed under CC {_variant} 4.0."
for _variant in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    TEMPLATES[f"CC-{_variant}-4.0-line"] = f"License: CC {_variant} 4.0"
#: Names of licenses as they stand in titles and lines (fixed values).
TEMPLATES |= {
    "MIT-title": "MIT License", "MIT-long-title": "The MIT License (MIT)", "Apache-2.0-title": "Apache License, Version 2.0",
    "ISC-title": "ISC License", "Zlib-title": "zlib License", "BSL-1.0-title": "Boost Software License - Version 1.0",
    "MPL-2.0-title": "Mozilla Public License, Version 2.0",
    "GPL-2.0-or-later-notice": "GPL version 2 or later", "GPL-3.0-or-later-notice": "GPL version 3 or later",
    "LGPL-2.1-or-later-notice": "LGPL version 2.1 or later", "LGPL-3.0-or-later-notice": "LGPL version 3 or later",
    "AGPL-3.0-or-later-notice": "AGPL version 3 or later",
}
for _id in ("MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSL-1.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0",
            "CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only",
            "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"):
    TEMPLATES[f"SPDX-{_id}"] = f"SPDX-License-Identifier: {_id}"
#: A short notice after one of these words is none; a template of fewer words is a notice, and of still fewer a fixed phrase.
NEGATIONS = frozenset("not no never without cannot isn aren wasn".split())
NOTICE_WORDS, PHRASE_WORDS = 16, 5
#: Words that tell licenses apart: a place must align those of its template and hold no other between.
IDENTIFYING = frozenset("mit bsd apache lesser library affero mozilla gpl lgpl agpl mpl by nc sa nd noncommercial sharealike "
                        "noderivatives noderivs endorse spdx isc zlib boost bsl cc0 unlicense".split())

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, given by the first, in which the second increases too."""
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(places):
        at = bisect.bisect_left(piles, b)
        back.append(tops[at - 1] if at else -1)
        piles[at : at + 1] = [b]
        tops[at : at + 1] = [i]
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in sorted(templates.items())}
        self.number = {w: i for i, w in enumerate(sorted({w for t in self.templates.values() for w in t}))}
        self.own = {}
        # Numbers are versions but in the clauses of longer texts; "by" tells only the short names of Creative Commons apart.
        self.telling = {name: IDENTIFYING if "cc" in words else IDENTIFYING - {"by"} for name, words in self.templates.items()}
        self.marks = {name: {w for w in words if w in self.telling[name] or w.isdigit() and not name.startswith("BSD")}
                      for name, words in self.templates.items()}
        self.mark_numbers = {name: np.array([self.number[w] for w in marks], np.int64) for name, marks in self.marks.items()}
        for name, words in self.templates.items():
            held = np.zeros(len(self.number) + 1, bool)
            held[[self.number[w] for w in words]] = True
            self.own[name] = held

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(license, start word, end word, aligned words, coverage) by start."""
        words = words_of(text)
        other = len(self.number)
        ids = np.array([self.number.get(w, other) for w in words], np.int64)
        present = np.zeros(other + 1, bool)
        present[ids] = True
        found = []
        for name, template in self.templates.items():
            if present[self.mark_numbers[name]].all():  # all identifying words must be aligned
                found += self._places(name, template, words, ids)
        # Of overlapping places the one with most aligned words stays, then the better covered, then the first name.
        # A negated notice takes its place like others, so that no shorter one inside it counts, and is left out then.
        kept: list[tuple] = []
        for place in sorted(found, key=lambda p: (-p[3], -p[4], p[0], p[1])):
            if all(place[2] <= k[1] or place[1] >= k[2] for k in kept):
                kept.append(place)
        return sorted((p[:5] for p in kept if not p[5]), key=lambda p: p[1])

    def _named(self, name: str, stretch: list[str], aligned: list[str]) -> bool:
        """Whether all identifying words of the template are aligned and the stretch has no others."""
        marks = self.marks[name]
        versions = any(m.isdigit() for m in marks)
        return marks <= set(aligned) and not any(
            w not in marks and (w in self.telling[name] or versions and w.isdigit() and w != "0") for w in stretch)

    def _places(self, name: str, template: list[str], words: list[str], ids: np.ndarray) -> list[tuple]:
        size = len(template)
        need = int(np.ceil(self.coverage * size - 1e-9))
        hits = self.own[name][ids]
        if hits.sum() < need:
            return []
        # Stretches with enough hits within the template's length and half as much again.
        reach = size + size // 2 + 1
        total = np.concatenate([[0], np.cumsum(hits)])
        dense = np.flatnonzero(hits & (total[np.minimum(np.arange(len(ids)) + reach, len(ids))] - total[:-1] >= need))
        # After a stretch without the template the next one begins a quarter of its length on: each word is
        # aligned a bounded number of times, whatever the text.
        step = max(1, size // 4)
        out = []
        done = 0
        for start in dense.tolist():
            if start < done:
                continue
            stop = min(len(words), start + reach)
            pairs = align(words[start:stop], template)
            done = start + step
            if len(pairs) < need:
                continue
            first, last = start + pairs[0][0], start + pairs[-1][0] + 1
            negated = size < NOTICE_WORDS and not NEGATIONS.isdisjoint(words[max(0, first - 2) : first])
            scattered = size < PHRASE_WORDS and last - first > size
            if not scattered and self._named(name, words[first:last], [template[j] for _, j in pairs]):
                out.append((name, first, last, len(pairs), len(pairs) / size, negated))
                done = last
        return out


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with licenses: array of (license, start_word, end_word, aligned, coverage)."""
    prepare(docs.sparkSession)
    docs = docs.drop("licenses")
    place = T.StructType([T.StructField("license", T.StringType()), T.StructField("start_word", T.LongType()),
                          T.StructField("end_word", T.LongType()), T.StructField("aligned", T.LongType()),
                          T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("licenses", T.ArrayType(place))])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()),
                                ("aligned", pa.int64()), ("coverage", pa.float64())]))
    names = [f.name for f in place.fields]
    known = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, coverage)
        for batch in batches:
            found = [[dict(zip(names, p)) for p in scanner.scan(t)]
                     for t in texts(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, "licenses"])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license found: doc_id, license, start_word, end_word, aligned, coverage."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scan(rows).select("doc_id", F.explode("licenses").alias("p")).select("doc_id", "p.*")
