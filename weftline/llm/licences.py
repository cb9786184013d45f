"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Text is lower-cased and cut into words; of all passages between two of a template's
bigrams, the one whose bigram set is most like the template's counts. Size bounds
prune: where fewer than t / (2 - t) of the template's bigrams occur no passage can
reach Dice t, nor can one with more distinct bigrams than (2 - t) / t times the
template's.

All matches of a text are reported that overlap no better one, those of one template
at several places too.

Defined cases: a null or empty text has no licence; of equally similar templates the
larger counts, then the first by name; of equally similar passages the first counts,
with the words around it whose bigrams it already holds; a text of any length is scanned whole; rows
that repeat give rows that repeat; other columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.bpe import Remembered
from weftline.llm.common import texts

#: Least Dice coefficient of a match.
LEAST = 0.8
WORD = re.compile(r"\w+")

# Licence texts and notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause (notice)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}


@lru_cache(maxsize=1)
def _word_hashes() -> Remembered:
    import xxhash

    return Remembered(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


def bigrams(text: str) -> np.ndarray:
    """64-bit hashes of the bigrams of normalised words, in order; one word alone counts as a bigram with nothing."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(_word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) == 1:
        return h * np.uint64(0x9E3779B97F4A7C15)
    return (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(29)))


class Scanner:
    """The templates' bigram sets and the vocabulary of all of them."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.sets = {name: np.unique(bigrams(t)) for name, t in sorted(templates.items())}
        self.vocabulary = np.unique(np.concatenate(list(self.sets.values()))) if self.sets else np.zeros(0, dtype=np.uint64)
        self.member = {name: np.isin(self.vocabulary, s) for name, s in self.sets.items()}

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, words) of the text's matches, the most similar first; none overlaps a better one."""
        grams = bigrams(text)
        if not len(grams) or not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        hits = np.flatnonzero(self.vocabulary[at] == grams)
        found = at[hits]
        passages = []
        before = after = code = None
        for name, own in self.sets.items():
            size = len(own)
            need = self.least / (2 - self.least) * size - 1e-9
            mine = self.member[name][found]
            if not len(hits) or mine.sum() < need or len(np.unique(at[hits[mine]])) < need:
                continue  # too few of the template's bigrams occur
            if before is None:
                before, after, code = self._neighbours(grams)
            own_at = np.zeros(len(grams), dtype=bool)
            own_at[hits[mine]] = True
            most = int((2 - self.least) / self.least * size + 1e-9)
            passages += [(-dice, -size, name, first, last) for dice, first, last in self._passages(own_at, before, after, size, most, need) if dice >= self.least]
        taken: list[tuple[int, int]] = []  # apart, in order
        out = []
        for minus, _, name, first, last in sorted(passages):
            k = bisect_right(taken, (first, len(grams)))
            if (k and taken[k - 1][1] >= first) or (k < len(taken) and taken[k][0] <= last):
                continue
            first, last = self._widened(code, first, last, taken[k - 1][1] + 1 if k else 0, taken[k][0] if k < len(taken) else len(code))
            taken.insert(k, (first, last))
            out.append((name, -minus, first, last - first + 2))
        return out

    @staticmethod
    def _neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each bigram occurs before (-1 if nowhere) and next (the end if nowhere), and a number for each distinct one."""
        n = len(grams)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        before, after, code = np.full(n, -1), np.full(n, n), np.empty(n, dtype=np.int64)
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        code[order] = np.cumsum(np.concatenate(([0], ~same)))
        return before, after, code

    @staticmethod
    def _passages(own_at: np.ndarray, before: np.ndarray, after: np.ndarray, size: int, most: int, need: float):
        """(Dice, first, last bigram) of the best passage from each start.

        A best passage starts and ends at a hit. Its first bigram needn't occur in it
        again, as it would hold the same set without the first place, so the starts of
        one bigram share the text between them. Every end up to ``most`` distinct
        bigrams is tried by running counts.
        """
        starts = np.flatnonzero(own_at)
        n_hits = np.concatenate(([0], np.cumsum(own_at)))
        for s in starts.tolist():
            stop, width = int(after[s]), 2 * most
            while n_hits[min(stop, s + width)] - n_hits[s] >= need or s + width < stop:
                end = min(stop, s + width)
                new = before[s:end] < s
                distinct = np.cumsum(new)
                if distinct[-1] <= most and end < stop:
                    width *= 2
                    continue
                common = np.cumsum(new & own_at[s:end])
                if common[-1] >= need:
                    dice = 2.0 * common / (size + distinct)
                    e = int(dice.argmax())
                    yield float(dice[e]), s, s + e
                break

    @staticmethod
    def _widened(code: np.ndarray, first: int, last: int, low: int, high: int) -> tuple[int, int]:
        """The passage with the bigrams around it, from ``low`` and before ``high``, that it already holds."""
        held = set(code[first : last + 1].tolist())
        while first > low and int(code[first - 1]) in held:
            first -= 1
        while last + 1 < high and int(code[last + 1]) in held:
            last += 1
        return first, last


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence, dice, first_word, n_words) of each document's best match, and ``matches``, all of them by place.

    licence is null, the rest 0 and matches empty where none is similar enough.
    """
    given = dict(TEMPLATES if templates is None else templates)
    names = ("licence", "dice", "first_word", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(given, least)
        for batch in batches:
            found = [own.scan(t) for t in batch.column(1).to_pylist()]
            best = [f[0] if f else (None, 0.0, 0, 0) for f in found]
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            every = pa.array([[dict(zip(names, m, strict=True)) for m in sorted(f, key=lambda m: m[2])] for f in found], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in best], kind) for k, kind in enumerate(kinds)), every], names=[id_col, *names, "matches"])

    match = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.IntegerType(), T.IntegerType()), strict=True)]
    schema = T.StructType([docs.schema[id_col], *match, T.StructField("matches", T.ArrayType(T.StructType(match)))])
    return texts(docs, id_col, text_col).mapInArrow(run, schema)
