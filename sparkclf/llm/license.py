"""License scan: Dice coefficient over word bigrams against licence templates.

Units are every line, every paragraph of several lines (between blank lines) and the
whole text, normalised to lower-case words without punctuation.  Beside them stand
windows of consecutive sentences, over line ends and blank lines: per template the best
window from each sentence on, less those that better ones cover by half, given where no
unit of the same lines has the same licence.  The Dice coefficient
2 |A n B| / (|A| + |B|) of two bigram sets can reach t only if their sizes differ by
at most the factor (2 - t) / t, and the same share of the smaller one is common to both:
a template of which the whole text holds less is not compared at all, a text without any
such template is dropped at once, and windows end at the template's size times the factor.
Texts are read whole, each in its row; the templates are a fixed list, the full
texts of the longer licences among them, in the task's closure.  Paragraphs of a template are templates too, unless they stand, or nearly so, in
several licences.  A unit inside a better match of another licence, of whose text it is
at least as much, is no row.

Defined cases: null and empty texts match nothing; a unit of one word has no bigram;
of equally good templates the first by name wins; repeated rows give repeated
results; an empty table gives an empty result.
"""
from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

THRESHOLD = 0.8
_HOPE = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
         "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details.")
_COPY = "You should have received a copy of the GNU {}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free "
        "Software Foundation{} either version {} of the License, or (at your option) any later version.")
_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
         "the Free Software Foundation.")
_WRITE = ("You should have received a copy of the GNU {}General Public License along with this {}; if not, write to the Free Software Foundation, Inc., "
          "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")
_LIBRARY = _HOPE.replace("program", "library").format("Lesser ")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain.",
              "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
              "for any purpose, commercial or non-commercial, and by any means.",
              "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
              "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
              "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
              "law.", _MIT[2].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"))
# Short notices and standard headers of common public licences; those of several paragraphs as tuples.
_TEXTS = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
                 *((_GNU.format("program", ":", "Affero ", ",", 3), _HOPE.format("Affero "), *y) for y in ((), (_COPY.format("Affero "),)))],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                    "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0",
                    "Unless required by applicable law or agreed to in "
                    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                    "either express or implied. See the License for the specific language governing permissions and limitations under the License.")],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.",
                     ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
                      "are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                      "disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                      "disclaimer in the documentation and/or other materials provided with the distribution."), (*_BSD[:3], _BSD[4])],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD[:4], _BSD],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                *((_GNU.format("program", *x), _HOPE.format(""), *y) for x in ((";", "", ";", 2), (":", "", ",", 2))
                  for y in ((), (_WRITE.format("", "program"),), (_COPY.format(""),))), (_ONLY,), (_ONLY, _HOPE.format(""))],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", _HOPE.format("")),
                ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", _HOPE.format(""), _COPY.format(""))],
    "ISC": ["Released under the ISC License.",
            _ISC[0], _ISC],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 *((_GNU.format("library", ";", "Lesser ", ";", 2.1), _LIBRARY, *y) for y in ((), (_WRITE.format("Lesser ", "library"),)))],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 *((_GNU.format("program", ":", "Lesser ", ",", 3), _HOPE.format("Lesser "), *y) for y in ((), (_COPY.format("Lesser "),)))],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            _MIT[:2], _MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _UNLICENSE],
}
# Full texts beside this module, as they stand: a template each.
FULL = ("AGPL-3.0", "Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")


def bigrams(text: str) -> frozenset:
    words = _WORD.findall(text.casefold())
    return frozenset(zip(words, words[1:]))


def _with_paragraphs(texts: dict[str, list]) -> dict[str, list[str]]:
    """Texts joined from their paragraphs, the full text, and then each paragraph that one licence alone has."""
    parts = {name: {bigrams(p): p for t in ts if isinstance(t, tuple) for p in t} for name, ts in texts.items()}
    held = Counter(b for p in parts.values() for b in p)
    shared = [b for b, n in held.items() if n > 1]
    own = lambda b: b and all(b != x and 2 * len(b & x) < THRESHOLD * (len(b) + len(x)) for x in shared)
    return {name: [*(t if isinstance(t, str) else " ".join(t) for t in texts.get(name, ())),
                   *(pkgutil.get_data(__package__, f"licenses/{x}.txt").decode() for x in FULL if x == name),
                   *(p for b, p in parts.get(name, {}).items() if own(b))]
            for name in sorted({*texts, *FULL})}


TEMPLATES = _with_paragraphs(_TEXTS)


class Matcher:
    """Best templates of a text's units and windows, by size-bounded candidates."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        sets = dict.fromkeys((name, bigrams(t), len(_WORD.findall(t))) for name in sorted(templates) for t in templates[name])
        self.sets = [(k, *x) for k, x in enumerate(x for x in sets if x[1])]
        self.threshold, self.reach = threshold, (2 - threshold) / threshold + 1e-9     # the comparison with the threshold decides
        self.known = frozenset().union(*(s for _, _, s, _ in self.sets))

    def live(self, whole: frozenset) -> list[tuple]:
        """The templates of which a text's bigrams hold enough for any part of it to match, by size."""
        hits = whole & self.known
        return sorted((x for x in self.sets if len(x[2]) <= len(hits) * self.reach and len(x[2]) <= len(hits & x[2]) * self.reach), key=lambda x: len(x[2]))

    def best(self, unit: frozenset, live: list[tuple]) -> tuple[str, float, frozenset] | None:
        n, found = len(unit), None
        size = lambda x: len(x[2])
        for k, name, s, _ in live[bisect_left(live, n / self.reach, key=size):bisect_right(live, n * self.reach, key=size)]:
            dice = 2 * len(unit & s) / (n + len(s))
            if dice >= self.threshold and (found is None or (dice, -k) > found[:2]):
                found = dice, -k, name, s
        return found and (found[2], found[0], found[3])

    def windows(self, text: str, live: list[tuple]) -> Iterator[tuple[int, int, str, float, frozenset]]:
        """(first line, line after the last, licence, Dice, template) of the best windows of sentences, less those that better ones cover by half."""
        words, start, line = [], [], []
        for i, x in enumerate(text.split("\n")):
            for piece in _SENTENCE.split(x):
                w = _WORD.findall(piece.casefold())
                if w:
                    start.append(len(words))
                    line.append(i)
                    words += w
        start.append(len(words))
        pairs, found = list(zip(words, words[1:])), []
        for k, _, s, n_words in live:
            before = [0]                                     # hits among the pairs before each
            for p in pairs:
                before.append(before[-1] + (p in s))
            for i in range(len(line)):
                last = min(len(pairs), start[i] + int(n_words * self.reach))
                if before[min(start[i + 1], len(pairs))] == before[start[i]] or (before[last] - before[start[i]]) * self.reach < len(s):
                    continue
                seen, hits, top, at = set(), 0, None, start[i]
                for j in range(i + 1, len(start)):
                    if start[j] - start[i] > n_words * self.reach:
                        break
                    for p in pairs[at:start[j] - 1]:
                        if p not in seen:
                            seen.add(p)
                            hits += p in s
                    at = max(at, start[j] - 1)
                    if len(seen) > len(s) * self.reach:
                        break
                    dice = 2 * hits / (len(seen) + len(s))
                    if dice >= self.threshold and (top is None or dice > top[0]):
                        top = dice, j
                if top:
                    found.append((-top[0], -len(s), i, k, top[1]))
        taken = bytearray(len(line))
        by = {x[0]: x[1:3] for x in live}
        for dice, _, i, k, j in sorted(found):
            if 2 * sum(taken[i:j]) < j - i:
                taken[i:j] = b"\1" * (j - i)
                yield line[i], line[j - 1] + 1, by[k][0], -dice, by[k][1]

    def rows(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, line after the last, licence, Dice) of the matching units, then of windows that no unit gives."""
        live = self.live(bigrams(text))
        if not live:
            return []
        found = [((lo, hi, *best), b) for lo, hi, unit in units(text) if (best := self.best(b := bigrams(unit), live))]
        windows = list(self.windows(text, live))
        every = [x for x, _ in found] + windows
        # a part of a better match that is its text at least as much is no notice of another licence
        out = [x[:4] for x, b in found if not any(lo <= x[0] and x[1] <= hi and name != x[2] and dice > x[3] and len(b & s) >= len(b & x[4])
                                                  for lo, hi, name, dice, s in every)]
        given = {x[:3] for x in out}
        for x in windows:
            if x[:3] not in given:
                given.add(x[:3])
                out.append(x[:4])
        return out


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, line after the last, text) of lines, paragraphs of several lines and the whole text."""
    lines = text.split("\n")
    yield from ((i, i + 1, x) for i, x in enumerate(lines) if x.strip())
    seen, start = set(), None
    for i, x in enumerate([*lines, ""]):
        if x.strip():
            start = i if start is None else start
        elif start is not None:
            if i - start > 1:
                seen.add((start, i))
                yield start, i, "\n".join(lines[start:i])
            start = None
    if len(lines) > 1 and (0, len(lines)) not in seen:
        yield 0, len(lines), text


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, first_line, end_line, license, dice), one row per matching unit or window."""
    d = pick(docs, doc_id=id_col, text=text_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, first_line long, end_line long, license string, dice double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(templates, threshold)
        for b in batches:
            rows = []
            for r, text in enumerate(b.column("text").to_pylist()):
                rows += ((r, *x) for x in match.rows(text or ""))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], ["doc_id", "first_line", "end_line", "license", "dice"])

    return d.mapInArrow(run, schema)
