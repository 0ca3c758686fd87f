"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Words of a text are hashed in runs of ``GRAM``; of every ``WINNOW`` neighbouring hashes the smallest is kept, in
texts and templates alike, so any match of ``GRAM + WINNOW - 1`` words shares a fingerprint. An inverted index
from fingerprint to (template, place) gives diagonals. Neighbouring ones are merged, long templates need two
fingerprints there, and the template is aligned with the text inside a band around each, and across the bands of diagonals
that lie within the template's length of each other, so that words inserted or left out anywhere, up to that many, do not
break a match; what covers enough of the template is reported with its character span.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import text_of

GRAM, WINNOW, BAND, COVERAGE = 2, 3, 4, 0.8
#: Diagonals so near to one that is aligned are not aligned again; its band is wider by as much.
NEAR = 2
#: A template of so many words needs two fingerprints near one diagonal.
LONG_WORDS = 12
_WORD = re.compile(r"[^\W_]+")
_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = (
    "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {1} for more details. "
)
_GNU_COPY = "You should have received a copy of the GNU {1} along with {0}. If not, see <https://www.gnu.org/licenses/>."
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version "
    "{2} of the License, or (at your option) any later version. "
)
#: Public license texts, the notices that longer licenses ask for, and short statements.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "AGPL-3.0-notice": (_GNU + _GNU_END + _GNU_COPY).format("This program", "Affero General Public License", "3"),
    "BSD-2-Clause": _BSD_GRANT + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_GRANT + _BSD_THIRD + _BSD_DISCLAIMER,
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and "
        "to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "GPL-2.0-notice": (_GNU.replace("software:", "software;") + _GNU_END).format("This program", "General Public License", "2"),
    "GPL-3.0-notice": (_GNU + _GNU_END + _GNU_COPY).format("This program", "General Public License", "3"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-notice": (_GNU.replace("software:", "software;") + _GNU_END).format("This library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": (_GNU + _GNU_END + _GNU_COPY).format("This library", "Lesser General Public License", "3"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
}


def words_and_hashes(text: str) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Words, each lowered, their spans in the text, and the hashes of their runs of GRAM."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    words, spans = [w for w, _ in found], [s for _, s in found]
    raw = [zlib.crc32(w.encode()) for w in words]
    one = np.array(raw, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grams = one[: max(0, len(one) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[k : k + len(grams)]
    return words, spans, grams ^ (grams >> np.uint64(32))


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: of every WINNOW neighbours the smallest, the rightmost at a tie."""
    if len(grams) <= WINNOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)[:, ::-1]
    return np.unique(np.arange(len(rows)) + WINNOW - 1 - rows.argmin(axis=1))


@lru_cache(maxsize=4)
def template_index(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, list[str]]], dict[int, list[tuple[int, int]]], np.ndarray]:
    known, index = [], {}
    for t, (name, text) in enumerate(templates):
        words, _, grams = words_and_hashes(text)
        known.append((name, words))
        for p in winnow(grams):
            index.setdefault(int(grams[p]), []).append((t, int(p)))
    return known, index, np.array(sorted(index), dtype=np.uint64)


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order with the text within ``band`` of the diagonal: ``(matched, first, last)``.

    ``first`` and ``last`` are the places in the text of the outermost matched words, nearest together at a tie.
    """
    none = (0, 0, 0)  # matched, minus first place, last place
    row = [none] * (2 * band + 1)
    for i, word in enumerate(template):
        new = []
        for b in range(2 * band + 1):
            j = i + diagonal + b - band
            best = max(row[b + 1] if b < 2 * band else none, new[b - 1] if b else none)
            if 0 <= j < len(words) and words[j] == word:
                n, first, _ = row[b]
                best = max(best, (n + 1, first if n else -j, j))
            new.append(best)
        row = new
    n, first, last = max(row)
    return n, -first, last


def centres(diagonals: dict[int, set[int]], least: int) -> list[int]:
    """Diagonals to align: those with ``least`` different fingerprints within NEAR, the fullest first, none near another."""
    near = {d: set().union(*(diagonals.get(x, ()) for x in range(d - NEAR, d + NEAR + 1))) for d in diagonals}
    out: set[int] = set()
    for d in sorted((d for d in diagonals if len(near[d]) >= least), key=lambda d: (-len(near[d]), d)):
        if not any(x in out for x in range(d - NEAR, d + NEAR + 1)):
            out.add(d)
    return sorted(out)


def align_chain(template: list[str], words: list[str], diagonals: list[int], band: int = BAND + NEAR) -> tuple[int, int, int]:
    """As :func:`align`, over the bands of several diagonals: a match may go from one to another, over inserted or missing words.

    The longest common subsequence of the equal words inside the bands, row by row, over prefix maxima of places in the text.
    """
    offsets = sorted({d + b for d in diagonals for b in range(-band, band + 1)})
    cells = [[j for o in offsets if 0 <= (j := i + o) < len(words) and words[j] == word] for i, word in enumerate(template)]
    rank = {j: k + 1 for k, j in enumerate(sorted({j for row in cells for j in row}))}
    tree = [(0, 0)] * (len(rank) + 1)  # matched, first place; maxima over prefixes of places
    best = (0, 0, 0)
    for row in cells:
        new = []
        for j in row:
            k, before = rank[j] - 1, (0, 0)
            while k > 0:
                before = max(before, tree[k])
                k -= k & -k
            new.append((j, (before[0] + 1, before[1] if before[0] else j)))
        for j, found in new:
            k = rank[j]
            while k < len(tree):
                tree[k] = max(tree[k], found)
                k += k & -k
            best = max(best, (*found, -j))
    return best[0], best[1], -best[2]


def chains(diagonals: list[int], reach: int) -> list[list[int]]:
    """Groups of two or more diagonals that lie within ``reach`` words of their lowest, none part of another."""
    out: list[list[int]] = []
    for k, d in enumerate(diagonals):
        own = [x for x in diagonals[k:] if x <= d + reach]
        if len(own) > 1 and not (out and out[-1][-1] == own[-1]):
            out.append(own)
    return out


def scan(text: str, templates: tuple[tuple[str, str], ...], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """``(template, coverage, start, end)`` of every match, in characters of ``text``, by start and name.

    Overlapping matches of one template keep the best.
    """
    known, index, keys = template_index(templates)
    words, spans, grams = words_and_hashes(text)
    places = winnow(grams)
    places = places[np.isin(grams[places], keys)] if len(places) else places
    diagonals: dict[int, dict[int, set[int]]] = {}
    for p in places.tolist():
        for t, q in index[int(grams[p])]:
            diagonals.setdefault(t, {}).setdefault(p - q, set()).add(q)
    out = []
    for t, own in diagonals.items():
        name, template = known[t]
        matches, broken = [], []
        for diagonal in centres(own, 2 if len(template) >= LONG_WORDS else 1):
            n, first, last = align(template, words, diagonal, BAND + NEAR)
            if n and n / len(template) >= coverage:
                matches.append((n / len(template), first, last))
            if n < len(template):
                broken.append(diagonal)
        if len(template) >= LONG_WORDS:
            for group in chains(broken, len(template)):
                n, first, last = align_chain(template, words, group)
                if n / len(template) >= coverage:
                    matches.append((n / len(template), first, last))
        taken: list[tuple[int, int]] = []
        for share, first, last in sorted(matches, key=lambda m: (-m[0], m[2] - m[1], m[1])):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((name, share, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda m: (m[2], m[0]))


def license_spans(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per match: ``doc_id, template, coverage, start_char, end_char``.

    Texts without a match, null and empty texts give no row; repeated rows and null ids as often as they come. Spans are
    of the text as it is, also where lower case has other lengths. An empty table gives an empty result.
    """
    known = tuple((TEMPLATES if templates is None else templates).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = scan(text, known, coverage)
                source += [k] * len(found)
                rows += found
            names, shares, starts, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(source, pa.int32())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "template", "coverage", "start_char", "end_char"])

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, template string, coverage double, start_char long, end_char long")
