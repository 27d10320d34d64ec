"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are grouped by length; a group's windows are twice as long as its
longest template and overlap by half, so every passage of that length lies
whole in some window. A window that holds a share c of a template's shingles
has at least a known Jaccard similarity to it; the number of bands is chosen so
that such a window shares a band with probability RETRIEVED or more. Retrieved
templates are verified by the exact share of their shingles in the window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, table
from .tokens import Memo

#: Words of a shingle, rows of a band, probability of retrieval, least containment.
SHINGLE, ROWS, RETRIEVED, CONTAINMENT = 3, 2, 0.9999, 0.8
#: Longest template of the first group, in words; each further group's is twice as long.
FIRST_GROUP = 8

#: Public license notices, (template, SPDX identifier, text).
TEMPLATES = (
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit-notice", "MIT", "Released under the MIT License"),
    ("mit-licensed", "MIT", "Licensed under the MIT License"),
    ("mit-text", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("gpl3-notice", "GPL-3.0-only", "licensed under the GNU General Public License, version 3"),
    ("gpl2-notice", "GPL-2.0-only", "licensed under the GNU General Public License, version 2"),
    ("gpl-header", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-notice", "LGPL-3.0-only", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-notice", "AGPL-3.0-only", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd-conditions", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorsement", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-text", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-full", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc-full", "ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("unlicense-text", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
SCHEMA = "doc_id long, template string, license string, containment double, first_word long, last_word long"

_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else (c if c >= 128 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case (only ASCII is folded)."""
    return text.encode().translate(_FOLD).split() if text else []


def shingles(words: list[bytes], memo: Memo) -> np.ndarray:
    """64-bit hashes of the word shingles, in order; one for fewer words than a shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    w = min(SHINGLE, len(h))
    n = len(h) - w + 1
    acc = mix64(h[:n] + np.uint64(w))
    for k in range(1, w):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return acc


def bands_for(similarity: float, rows: int = ROWS, retrieved: float = RETRIEVED) -> int:
    """Fewest bands with 1 - (1 - s^rows)^bands >= retrieved."""
    return math.ceil(math.log(1 - retrieved) / math.log1p(-(similarity**rows)))


class Scanner:
    def __init__(self, templates=TEMPLATES, containment: float = CONTAINMENT):
        self.containment, self.memo = containment, Memo(xxhash.xxh3_64_intdigest)
        self.names = [(t, s) for t, s, _ in templates]
        self.sets, by_group = [], {}
        for k, (_, _, text) in enumerate(templates):
            words = words_of(text)
            self.sets.append(np.unique(shingles(words, self.memo)))
            if words:  # a template without words is in no text
                by_group.setdefault(max(FIRST_GROUP, 1 << (len(words) - 1).bit_length()), []).append(k)
        self.groups = []
        for longest, members in sorted(by_group.items()):
            size = 2 * longest - SHINGLE + 1  # shingles of a window
            least = min(containment * len(self.sets[k]) / (size + (1 - containment) * len(self.sets[k])) for k in members)
            bands = bands_for(least)
            seeds = mix64(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            table: dict[tuple[int, int], list[int]] = {}
            for k in members:
                for b, v in enumerate(self.bands(self.sets[k], seeds)):
                    table.setdefault((b, v), []).append(k)
            self.groups.append((longest, size, seeds, table))
        self.all = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.all & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def bands(s: np.ndarray, seeds: np.ndarray) -> list[int]:
        low = mix64(s[:, None] ^ seeds).min(axis=0).reshape(-1, ROWS)
        return mix64(low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1]).tolist()

    def scan(self, text: str | None) -> list[tuple]:
        """(template, license, containment, first word, last word) of each template found:
        its best window (the first of equals), and the span of its shingles there."""
        s = shingles(words_of(text), self.memo)
        if not len(s):
            return []
        # A band can only be shared through a shingle of a template, so windows without any are passed over.
        hit = np.flatnonzero(self.maybe[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        hit = hit[np.isin(s[hit], self.all)]
        best: dict[int, tuple] = {}
        for longest, size, seeds, table in self.groups:
            if not len(hit):
                break
            first = np.maximum(hit // longest - 1, 0)
            for w in np.unique(np.concatenate([first, hit // longest])).tolist():
                start = w * longest
                window = s[start : start + size]
                if not len(window):
                    continue
                own = np.unique(window)
                for k in sorted({k for b, v in enumerate(self.bands(own, seeds)) for k in table.get((b, v), ())}):
                    share = np.isin(self.sets[k], own).mean()
                    if share >= self.containment and (k not in best or share > best[k][0]):
                        at = np.flatnonzero(np.isin(window, self.sets[k]))
                        best[k] = (share, start + int(at[0]), start + int(at[-1]) + SHINGLE - 1)
        return [(*self.names[k], float(share), a, z) for k, (share, a, z) in sorted(best.items())]


def scan_licenses(df: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, template, license, containment,
    first_word, last_word (places among the text's words).

    Null and empty texts find nothing; repeated rows give repeated rows; null ids
    stay null; other columns are left out; an empty table gives no rows. Whole texts
    are read, however long, and templates may be of any length, whole license texts
    too; one without words is found nowhere. One pass, no shuffle; templates are few and fixed.
    """

    def run(batches):
        scanner = Scanner(templates, containment)
        for b in batches:
            rows = [(d, t, x, round(c, 6), a, z) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, x, c, a, z in scanner.scan(text)]
            c = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], names=["doc_id", "template", "license", "containment", "first_word", "last_word"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
