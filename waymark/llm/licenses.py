"""Licence scans: Dice coefficient over word bigrams against licence templates.

The units of a text are the whole text, its paragraphs (between blank
lines) and its lines. A unit is normalised to lower-case words of letters
and digits and compared with each template by the Dice coefficient of
their sets of word bigrams. With threshold t only sizes between
``n * t / (2 - t)`` and ``n * (2 - t) / t`` can match a template of n
bigrams, so templates are looked up by size and others are never compared.

Null and empty texts have no match, nor have units of fewer than two
words. Units with equal sets count once. Each row is scanned on its own,
also rows that share an id or have none.

``scan_license_windows`` has windows of words in place of units: every run
of words of the whole text, across lines and paragraphs and inside
sentences, at any place, also compared with the full licence wordings in
``wordings``. A best window begins and ends with bigrams of its template,
as others at its ends only lower the coefficient.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import small_batches

# The wording of common licences and of their usual notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
# Wordings that differ little from others, for the scanner that tells them apart by the better coefficient.
NEAR_TEMPLATES = [
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
THRESHOLD = 0.8
_NOT_WORD, _BLANK_LINES = re.compile(r"[\W_]+"), re.compile(r"\n[ \t]*\n")


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of an ASCII template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that can reach the threshold with a set of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


class Scanner:
    """The templates by the sizes of unit that can match them."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.by_size: dict[int, list[tuple[str, frozenset[str]]]] = {}
        for name, wording in templates:
            grams = frozenset(bigrams(wording))
            low, high = size_bounds(len(grams), threshold)
            for size in range(max(1, low), high + 1):
                self.by_size.setdefault(size, []).append((name, grams))
        self.fewest = min(self.by_size, default=1)

    def scan(self, text: str) -> list[tuple[str, float, int]]:
        """(licence, best coefficient, number of different units that match) of one text."""
        found: dict[str, dict[frozenset, float]] = {}
        for unit in {text, *_BLANK_LINES.split(text), *text.split("\n")}:
            words = _NOT_WORD.sub(" ", unit.lower()).split()
            if len(words) <= self.fewest:
                continue
            grams = set(zip(words, words[1:], strict=False))
            near = self.by_size.get(len(grams), ())
            if not near:
                continue
            joined = frozenset(map(" ".join, grams))
            for name, template in near:
                dice = 2.0 * len(joined & template) / (len(joined) + len(template))
                if dice >= self.threshold:
                    best = found.setdefault(name, {})
                    best[joined] = max(dice, best.get(joined, 0.0))
        return [(name, max(units.values()), len(units)) for name, units in sorted(found.items())]


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, license_id, dice, n_units): each licence found in each row, its best coefficient and how many units match."""
    small_batches(df.sparkSession)
    slim = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(text).isNotNull())

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b["doc_id"], b["text"], strict=True) for hit in scanner.scan(t)]
            got = pd.DataFrame(rows, columns=["doc_id", "license_id", "dice", "n_units"])
            yield got.astype({"doc_id": "Int64", "license_id": "object", "dice": "float64", "n_units": "int64"})

    return slim.mapInPandas(scanned, "doc_id long, license_id string, dice double, n_units long")


def full_wordings() -> list[tuple[str, str]]:
    """(licence, wording) of the full texts beside this module."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("wordings").glob("*.txt"))]


class WindowScanner:
    """The templates by their bigrams, to find windows of words that match them."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.templates: list[tuple[str, frozenset[tuple[str, str]], int, int]] = []
        self.by_gram: dict[tuple[str, str], list[int]] = {}
        for name, wording in templates:
            grams = frozenset(tuple(g.split(" ")) for g in bigrams(wording))
            if grams:
                for g in grams:
                    self.by_gram.setdefault(g, []).append(len(self.templates))
                # a window has at least as many common bigrams as the least size that can match
                self.templates.append((name, grams, *size_bounds(len(grams), threshold)))

    def windows(self, seq: list[tuple[str, str]], n: int) -> list[tuple[float, int, int]]:
        """(coefficient, first bigram, last bigram) of the best window from each first bigram of template ``n``, where it matches.

        From the end of the text on, keeps the places where the bigrams after a start come first, as far as the sizes that can match.
        """
        _, grams, low, high = self.templates[n]
        places: list[int] = []  # below zero, as they fall
        at: dict[tuple[str, str], int] = {}
        sizes, common, out = np.arange(1, high + 1) + len(grams), 0, []
        hits = np.fromiter((g in grams for g in seq), bool, len(seq))
        for i in range(len(seq) - 1, -1, -1):
            gram = seq[i]
            if (old := at.get(gram)) is not None:
                del places[bisect.bisect_left(places, -old)]
            else:
                common += bool(hits[i])
            places.append(-i)
            at[gram] = i
            if len(places) > high:
                last = -places.pop(0)
                del at[seq[last]]
                common -= bool(hits[last])
            if hits[i] and common >= low:
                first_at = -np.array(places[::-1])
                dice = 2.0 * np.cumsum(hits[first_at]) / sizes[: len(first_at)]
                best = int(np.argmax(dice))
                if dice[best] >= self.threshold:
                    out.append((float(dice[best]), i, int(first_at[best])))
        return out

    def places(self, text: str) -> list[tuple[float, int, int, str]]:
        """(coefficient, first bigram, last bigram, licence) of one text: of each template's windows, those that overlap a
        better or an equal earlier one are no place of their own."""
        words = _NOT_WORD.sub(" ", text.lower()).split()
        seq = list(zip(words, words[1:], strict=False))
        count: dict[int, int] = {}
        for g in self.by_gram.keys() & set(seq):
            for n in self.by_gram[g]:
                count[n] = count.get(n, 0) + 1
        found = []
        for n in sorted(count):
            name, _, low, _ = self.templates[n]
            if count[n] < low:
                continue
            taken = np.zeros(len(seq), bool)
            for dice, a, b in sorted(self.windows(seq, n), key=lambda w: (-w[0], w[1])):
                if not taken[a] and not taken[b] and not taken[a : b + 1].any():
                    taken[a : b + 1] = True
                    found.append((dice, a, b, name))
        return found

    def scan(self, text: str) -> list[tuple[str, float, int]]:
        """(licence, best coefficient, number of places) of one text; places of a licence that overlap are one."""
        return [(name, dice, n) for name, dice, n, _ in self.scan_apart(text)]

    def scan_apart(self, text: str) -> list[tuple[str, float, int, int]]:
        """As ``scan``, with the number of places that are not better explained by another licence."""
        found = self.places(text)
        own = told_apart(found)
        out = []
        for name in sorted({p[3] for p in found}):
            n, n_own = (groups([(a, b) for _, a, b, who in places if who == name]) for places in (found, own))
            out.append((name, max(p[0] for p in found if p[3] == name), n, n_own))
        return out


def told_apart(places: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    """The ``places`` but for those of which a better one of another licence covers more than half of the longer of both.

    Better is the higher coefficient, then the longer, the earlier, the lower name; a place that gave way covers none. Two
    such places hold each other's middle, so only places with their middle inside one are looked at.
    """
    kept: list[tuple[float, int, int, str]] = []
    middles: list[tuple[int, int]] = []  # (middle, number in kept), in order
    for place in sorted(places, key=lambda p: (-p[0], p[1] - p[2], p[1], p[3])):
        _, a, b, name = place
        inside = middles[bisect.bisect_left(middles, (a, 0)) : bisect.bisect_right(middles, (b, len(kept)))]
        for _, k in inside:
            _, c, d, other = kept[k]
            if other != name and 2 * (min(b, d) - max(a, c) + 1) > max(b - a, d - c) + 1:
                break
        else:
            bisect.insort(middles, ((a + b) // 2, len(kept)))
            kept.append(place)
    return kept


def groups(spans: list[tuple[int, int]]) -> int:
    """The number of groups of spans (first, last) that overlap."""
    n, end = 0, -1
    for a, b in sorted(spans):
        n, end = n + (a > end), max(end, b)
    return n


def scan_license_windows(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, license_id, dice, n_places, n_own): each licence of which a window of words of a row matches a wording.

    ``n_own`` counts the places that are the licence's own: at the others a better match of another licence covers more
    than half. Of licences whose wordings are nearly alike (GPL, LGPL and AGPL; CC BY and CC BY-NC; BSD with two and with
    three clauses) a notice is thus one's own; take the rows with ``n_own > 0`` for one licence a notice.
    """
    wordings = TEMPLATES + NEAR_TEMPLATES + full_wordings() if templates is None else templates
    small_batches(df.sparkSession)
    slim = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col(text).isNotNull())

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = WindowScanner(wordings, threshold)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b["doc_id"], b["text"], strict=True) for hit in scanner.scan_apart(t)]
            got = pd.DataFrame(rows, columns=["doc_id", "license_id", "dice", "n_places", "n_own"])
            yield got.astype({"doc_id": "Int64", "license_id": "object", "dice": "float64", "n_places": "int64", "n_own": "int64"})

    return slim.mapInPandas(scanned, "doc_id long, license_id string, dice double, n_places long, n_own long")


def oracle_sql() -> str:
    """DuckDB text for ``scan_licenses`` over ``documents`` with the defaults; a unit counts once by its set of bigrams."""
    values = ",\n".join(
        f"('{name}', {len(g)}, {g!r}::VARCHAR[], {lo}, {hi})"
        for name, wording in TEMPLATES
        for g in [bigrams(wording)]
        for lo, hi in [size_bounds(len(g), THRESHOLD)]
    )
    return rf"""
    WITH t(license_id, t_size, t_grams, lo, hi) AS (VALUES {values}),
    u AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || regexp_split_to_array(text, '\n[ \t]*\n') || [text])) AS unit
          FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
    g AS (SELECT doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS seq FROM w WHERE len(words) > 1),
    d AS (SELECT doc_id, list_sort(list_distinct(seq)) AS grams, len(list_distinct(seq)) AS u_size FROM g),
    m AS (SELECT doc_id, license_id, grams, 2.0::DOUBLE * len(list_intersect(grams, t_grams)) / (u_size + t_size) AS dice
          FROM d JOIN t ON u_size BETWEEN lo AND hi)
    SELECT doc_id, license_id, round(max(dice), 6) AS dice, count(DISTINCT grams) AS n_units
    FROM m WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY doc_id, license_id"""
