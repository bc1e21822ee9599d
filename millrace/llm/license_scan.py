"""License scan: winnowed fingerprints in an inverted index, then banded alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

#: Public notices and whole license texts by name; a license may have several.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "All-Rights-Reserved": ("All rights reserved.",),
}
#: Words of a fingerprint; the smallest hash of so many neighbouring fingerprints is kept.
#: A run of K + WINDOW - 1 template words is always found.
K, WINDOW = 3, 2
#: Share of a template's words that must be aligned, and the share of its fingerprints that makes a candidate.
MIN_COVERAGE, MIN_HITS = 0.8, 0.25

_WORD = re.compile(r"[A-Za-z0-9]+")
_ANY_WORD = re.compile(rb"[a-z0-9]+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Index:
    """Inverted index from winnowed word-K-gram fingerprints to places in templates."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], min_coverage: float = MIN_COVERAGE, min_hits: float = MIN_HITS):
        self.min_coverage, self.min_hits = min_coverage, min_hits
        self.names, self.texts = [], []
        for name, variants in templates.items():
            for text in variants:
                self.names.append(name)
                self.texts.append(_words(text))
        vocabulary = sorted({w for t in self.texts for w in t})
        self.number = {w.encode(): i for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.ids = [[self.number[w.encode()] for w in t] for t in self.texts]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.n_prints = []
        for t, ids in enumerate(self.ids):
            places = self.winnow(np.array(ids, dtype=np.int64))
            self.n_prints.append(len(places))
            for p in places.tolist():
                self.places[self._gram(ids, p)].append((t, p))

    def _gram(self, ids, p: int) -> int:
        g = 0
        for i in ids[p : p + K]:
            g = g * self.size + int(i)
        return g

    def winnow(self, ids: np.ndarray) -> np.ndarray:
        """Places of the K-grams of template words that have the smallest hash in one of the windows around them."""
        n = len(ids) - K + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64)
        gram, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(K):
            gram = gram * self.size + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        if not known.any():
            return np.zeros(0, dtype=np.int64)
        hashed = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
        hashed[~known] = np.uint64((1 << 64) - 1)  # never the smallest
        if n <= WINDOW:
            return np.unique(np.argmin(hashed)[None])
        windows = np.lib.stride_tricks.sliding_window_view(hashed, WINDOW)
        chosen = np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))
        return chosen[known[chosen]]

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(template, start in the document) where enough fingerprints lie on neighbouring diagonals."""
        hits: dict[int, list[int]] = defaultdict(list)
        for p in self.winnow(ids).tolist():
            for t, q in self.places.get(self._gram(ids, p), ()):
                hits[t].append(p - q)
        out = set()
        for t, starts in hits.items():
            starts.sort()
            slack, least = self.slack(t), max(1, int(self.min_hits * self.n_prints[t]))
            i = 0
            for j in range(1, len(starts) + 1):
                if j == len(starts) or starts[j] - starts[j - 1] > slack:
                    if j - i >= least:
                        out.add((t, starts[(i + j) // 2]))
                    i = j
        return out

    def slack(self, t: int) -> int:
        return 2 + len(self.ids[t]) // 8

    def align(self, t: int, ids: list[int], start: int) -> tuple[int, int, int]:
        """Most words of template t in order around start, within a band of slack: their number, and the first and last place (exclusive)."""
        own, slack = self.ids[t], self.slack(t)
        lo, width = start - slack, 2 * slack + 1
        # cell (i, d): template words up to i, document words up to lo + i + d; value: matched, -first place, last place
        row = [(0, 0, 0)] * (width + 1)
        for i, word in enumerate(own):
            now = []
            for d in range(width):
                j = lo + i + d
                best = row[d + 1] if d + 1 < width else (0, 0, 0)  # the template word is missing
                if d and now[d - 1][0] > best[0]:
                    best = now[d - 1]  # a word too many in the document
                if 0 <= j < len(ids) and ids[j] == word and row[d][0] + 1 > best[0]:
                    m, first, _ = row[d]
                    best = (m + 1, first if m else -j, j + 1)
                now.append(best)
            row = [*now, (0, 0, 0)]
        m, first, last = max(row)
        return m, -first, last


def find(index: Index, text: str) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) in code points; of overlapping finds the one with more words stays, then the one covered more, then the earlier."""
    get = index.number.get
    ids = [get(w, -1) for w in _ANY_WORD.findall(text.lower().encode())]
    known = np.array(ids, dtype=np.int64)
    near = index.candidates(known)
    if not near:
        return []
    # places in the text, needed for few documents only; lower() may change lengths, so case is folded for A-Z alone
    spans = [m.span() for m in _WORD.finditer(text)]
    ids = [get(text[a:b].lower().encode(), -1) for a, b in spans]
    found = []
    for t, start in near | index.candidates(np.array(ids, dtype=np.int64)):
        m, first, last = index.align(t, ids, start)
        if m and m >= index.min_coverage * len(index.ids[t]):
            found.append((-m, -m / len(index.ids[t]), first, last, t))
    taken, out = [], []
    for m, coverage, first, last, t in sorted(found):
        if all(last <= a or first >= b for a, b in taken):
            taken.append((first, last))
            out.append((index.names[t], spans[first][0], spans[last - 1][1], -coverage))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE, min_hits: float = MIN_HITS) -> DataFrame:
    """doc_id and finds, an array of (license, start, end, coverage); documents without one have an empty array.

    The templates are configuration of fixed size, and their index goes along with the task. Null or empty text has no finds.
    Rows that repeat are returned as often; an empty table stays empty; rows stay where they are: no shuffle.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates, min_coverage, min_hits)
        for batch in batches:
            found = [[{"license": a, "start": s, "end": e, "coverage": c} for a, s, e, c in find(index, t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "finds": found})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, finds array<struct<license:string,start:long,end:long,coverage:double>>")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    listed = F.transform("finds", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.format_number(x["coverage"], 3)))
    return found.select("doc_id", F.size("finds").cast("long").alias("n_finds"), F.array_join(listed, ",").alias("finds"), F.coalesce(F.array_max(F.transform("finds", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"))
