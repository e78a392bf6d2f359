"""License scans through a generalised suffix automaton of license templates.

Every document's words stream past the templates' automaton, which gives each template's longest match that ends at each word
(documents without any run of LEAST template words are passed by a vectorised look-up, which loses nothing). Each template's own maximal
matches of LEAST words or more are chained, whatever longer match of another template they lie in: in order in the document and in the template, at most GAP words apart in either. A chain that
covers COVERAGE of its template is reported, best first, where no better one lies.

Ties go to more matched words, then the higher coverage, the earlier place, the first template. Null and empty documents have no
chains; null and repeated ids are rows like any other. Very long texts are read whole. Without templates nothing is found, nor in an empty
table. Extra columns are ignored. `templates_of` takes templates from a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.automaton import SuffixAutomaton
from graphloom.llm.common import Filter, Words, hashes_of, pieces, utf8

LEAST = 3
GAP = 12
COVERAGE = 0.8
_built: dict[tuple, "Templates"] = {}

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""
#: (license, template)
TEMPLATES = [
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_WARRANTY),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL3),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD", _BSD),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved."),
    ("GPL-2.0", _GPL3.replace("version 3 of", "version 2 of")),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", _GPL3.replace("GNU General", "GNU Lesser General")),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL-3.0", _GPL3.replace("GNU General", "GNU Affero General")),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("BSD", _BSD_DISCLAIMER),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least: int = LEAST, gap: int = GAP, coverage: float = COVERAGE):
        self.least, self.gap, self.coverage = least, gap, coverage
        tokens = [hashes_of(t) for _, t in templates]
        self.names = [name for name, _ in templates]
        self.automaton = SuffixAutomaton(tokens, least)
        self.sizes = self.automaton.sizes
        grams = []
        for _, t in templates:
            raw = np.frombuffer(t.encode(), np.uint8)
            grams.append(Words(raw, np.array([0, len(raw)])).grams(least)[0])
        self.seen = Filter(np.concatenate([*grams, np.zeros(0, np.uint64)]))

    def chains(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """(template, first word, word after the last, matched words), not overlapping, by place."""
        found = []
        for k, matches in self.automaton.own(tokens).items():
            found += [(matched, matched / self.sizes[k], -a, -k, b) for a, b, matched in self._chained(sorted(set(matches))) if matched >= self.coverage * self.sizes[k]]
        taken: list[tuple[int, int, int, int]] = []
        for matched, _, a, k, b in sorted(found, reverse=True):
            if all(b <= x or -a >= y for _, x, y, _ in taken):
                taken.append((-k, -a, b, matched))
        return sorted(taken, key=lambda x: x[1])

    def _chained(self, matches: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Best chains that share no match: (first word, word after the last, matched words)."""
        n = len(matches)
        score, before = [0] * n, [-1] * n
        low = 0
        longest = max(b - a for a, b, _, _ in matches)
        for j, (a, b, s, e) in enumerate(matches):
            score[j] = b - a
            while matches[low][0] < a - self.gap - longest:
                low += 1
            for i in range(low, j):
                a2, b2, s2, e2 = matches[i]
                if a2 < a and b2 < b and s2 < s and e2 < e and a - b2 <= self.gap and s - e2 <= self.gap:
                    gain = score[i] + (b - a) - max(0, b2 - a, e2 - s)
                    if gain > score[j]:
                        score[j], before[j] = gain, i
        used = [False] * n
        for j in sorted(range(n), key=lambda j: (-score[j], j)):
            path, i = [], j
            while i != -1 and not used[i]:
                path.append(i)
                i = before[i]
            if path and i == -1:
                for i in path:
                    used[i] = True
                yield matches[path[-1]][0], matches[j][1], score[j]


def _templates(templates: tuple, limits: tuple) -> Templates:
    if (templates, limits) not in _built:
        _built.clear()
        _built[templates, limits] = Templates(list(templates), *limits)
    return _built[templates, limits]


def templates_of(table: DataFrame, license: str = "license", text: str = "text") -> list[tuple[str, str]]:
    """Templates from a table, by license and text; rows without a word are left out, repeated ones count once. All templates are held in memory."""
    rows = table.select(F.col(license).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("l is not null and t is not null").distinct().collect()
    return sorted((x["l"], x["t"]) for x in rows if hashes_of(x["t"]))


def scanned(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id: str = "doc_id", text: str = "text", least: int = LEAST, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """A row per covered span: id, license, template's number, start and end in characters, coverage, matched words."""
    kind = documents.schema[id].dataType.simpleString()
    known, limits = tuple(templates), (least, gap, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _templates(known, limits)
        for b in batches:
            rows, out = [], []
            data, offsets = utf8(b.column(1))
            for lo, _, words in pieces(data, offsets):
                h, at = words.grams(least)
                for d in np.unique(np.searchsorted(words.lo, at[t.seen(h)], "right") - 1).tolist():
                    base, first = words.offsets[d], words.lo[d]
                    found = t.chains(words.hash[first : words.hi[d]].tolist())
                    if found:
                        chars = np.concatenate([[0], np.cumsum((words.data[base : words.offsets[d + 1]] & 0xC0) != 0x80)])
                    for k, a, e, matched in found:
                        rows.append(lo + d)
                        out.append((t.names[k], k, int(chars[words.start[first + a] - base]), int(chars[words.end[first + e - 1] - base]), round(matched / t.sizes[k], 6), matched))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], ["i", "license", "template", "start", "end", "coverage", "matched"])

    return documents.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, license string, template int, start long, end long, coverage double, matched int")
