"""Licence scans (operator 9): Dice coefficient over word bigrams.

A text in lower case, letters and digits only, is a string of words.  Every run of words, in
long sentences too, is compared with every licence template by the Dice coefficient of their
word bigrams (as multisets), save what cannot reach the threshold ``t``: a run must have
between ``t / (2 - t)`` and ``(2 - t) / t`` times the template's bigrams, begin and end with a
bigram of the template (trimming others only raises the coefficient), and hold at least
``t / (2 - t)`` times the template's bigrams that are the template's.  For each first word the
best run of each template is a candidate; of overlapping candidates the one with the highest
coefficient stays, then the longer, then the earlier, then by name.  So every occurrence of
every licence is reported.

Templates are notices and whole texts of short licences; callers pass others, such as whole
texts of long licences, as ``templates``.

Cases: null and empty texts match nothing; very long texts are scanned whole; repeated rows
match each; rows with a null id keep it; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallkit.llm.common import map_arrow, slices

THRESHOLD = 0.8

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_TAIL = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
)


def _gnu(kind: str, thing: str, version: str, mark: str) -> str:
    """The notice that the GNU licences ask programs to carry."""
    return (
        f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} "
        f"Public License as published by the Free Software Foundation{',' if mark == ':' else mark} either version {version} "
        "of the License, or (at your option) any later version."
    )


#: Public licence notices, and the texts of short licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        _MIT_GRANT,
        _MIT_GRANT + _MIT_TAIL,
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _gnu("General", "program", "3", ":"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("General", "program", "2", ";"),
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        _gnu("Lesser General", "library", "3", ":"),
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        _gnu("Lesser General", "library", "2.1", ";"),
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _gnu("Affero General", "program", "3", ":"),
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD_HEAD} {_BSD_TAIL}"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        f"promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
for _name, _texts in TEMPLATES.items():
    _texts.append(f"SPDX-License-Identifier: {_name}")

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    """Templates with an index from bigrams to the templates that hold them."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, i, bigrams(words_of(t))) for name, texts in templates.items() for i, t in enumerate(texts)]
        self.holders: dict[tuple, list[int]] = defaultdict(list)
        for at, (_, _, grams) in enumerate(self.templates):
            for gram in grams:
                self.holders[gram].append(at)
        self.starts = {a for a, _ in self.holders}

    def scan(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """Licence, template, Dice, first word and number of words of each occurrence."""
        words = words_of(text)
        hits: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words[:-1]):
            if word in self.starts:
                for at in self.holders.get((word, words[i + 1]), ()):
                    hits[at].append(i)
        found = [run for at, places in hits.items() for run in self._runs(at, places, words)]
        taken: list[tuple] = []
        covered: set[int] = set()
        for name, number, score, first, n in sorted(found, key=lambda x: (-x[2], -x[4], x[3], x[0])):
            if covered.isdisjoint((first, first + n - 1)) and covered.isdisjoint(range(first, first + n)):
                taken.append((name, number, score, first, n))
                covered.update(range(first, first + n))
        return sorted(taken, key=lambda x: (x[3], x[0]))

    def _runs(self, at: int, places: list[int], words: list[str]) -> Iterator[tuple]:
        """The best run of a template from each place where one of its bigrams begins."""
        name, number, grams = self.templates[at]
        n, t = grams.total(), self.threshold
        low, high = n * t / (2 - t), n * (2 - t) / t
        end = 0
        for start, first in enumerate(places):
            while end < len(places) and places[end] - first < high:
                end += 1
            if end - start < low - 1e-9:  # hits bound the shared bigrams
                continue
            left, shared, best = dict(grams), 0, (t, 0)
            for last in places[start:end]:
                gram = (words[last], words[last + 1])
                if left[gram]:
                    left[gram] -= 1
                    shared += 1
                size = last - first + 1
                score = 2 * shared / (n + size)
                if low - 1e-9 <= size <= high + 1e-9 and score >= best[0]:
                    best = (score, size)
            if best[1]:
                yield name, number, best[0], first, best[1] + 1


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, license, template, dice, first_word, n_words``: each occurrence in each row."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in slices(batches, 1):
            rows = [
                (i, *found)
                for i, text in enumerate(batch.column(1).to_pylist())
                if text
                for found in scanner.scan(text)
            ]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns[1:], kinds)],
                names=["doc_id", "license", "template", "dice", "first_word", "n_words"],
            )

    schema = f"doc_id {kind}, license string, template int, dice double, first_word bigint, n_words bigint"
    return source.transform(map_arrow, run, schema)
