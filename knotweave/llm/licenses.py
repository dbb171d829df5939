"""License scans: MinHash bands over text windows retrieve templates.

Texts are cut into segments; three neighbouring ones are a window, so windows
overlap by two thirds, and two segments hold a template with a quarter of its
length put in between. Every window has a MinHash signature; its bands are
looked up in the table of the templates' bands. There are so many bands that a
template of which the least allowed part is present shares one with its window
with probability ``COLLIDE`` or more. Exact containment of the template's
shingles then decides.

A band has ``BAND_ROWS`` values. One is the best here: a window is longer than
its template, so similarity is 0.3 to 0.4 at the least, and texts without a
template's words share no value with it anyway. Two would need 120 values where
one needs 25.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, small_batches
from .words import Words, chunks

SHINGLE, CONTAINED = 5, 0.8
COLLIDE = 0.9999
BAND_ROWS = 1
#: Words that may stand between a template's words, as a share of its length.
SLACK = 0.25
#: Segments of a window.
SEGMENTS = 3

_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices and whole texts by license. Shorter ones than a shingle count as one shingle.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC,),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC,),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSD-2-Clause": (f"{_BSD} {_BSD_END}",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.split(" IN NO EVENT")[0] + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "All-Rights-Reserved": ("All rights reserved.",),
}


def fold_letters() -> np.ndarray:
    """ASCII letters lowered, other ASCII but digits to spaces; bytes over 127 stay."""
    fold = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        fold[b] = ord(c.lower()) if c.isalnum() else 0x20
    return fold


class Scanner:
    """All templates' bands, by shingle size and segment length."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], contained: float, collide: float, rows: int = BAND_ROWS):
        self.fold, self.contained, self.rows = fold_letters(), contained, rows
        self.names: list[tuple[str, int]] = []
        self.shingles: list[np.ndarray] = []
        self.groups: dict[tuple[int, int], list[int]] = {}
        need: dict[tuple[int, int], float] = {}
        for name in sorted(templates):
            for number, text in enumerate(templates[name]):
                words = Words(pa.array([text]), self.fold)
                if not len(words):
                    continue
                size = min(SHINGLE, len(words))
                own = words.grams(size)[1]
                step = next(s for s in (k for p in range(30) for k in (1 << p, 3 << p >> 1)) if 2 * s >= len(own) * (1 + SLACK) - 1)
                own = np.unique(own)
                least = contained * len(own) / (SEGMENTS * step + (1 - contained) * len(own))
                need[size, step] = min(least, need.get((size, step), 1.0))
                self.groups.setdefault((size, step), []).append(len(self.names))
                self.names.append((name, number))
                self.shingles.append(own)
        lengths = {t: SEGMENTS * step for (_, step), own in self.groups.items() for t in own}
        # Templates that hold enough of another's shingles to be taken for it.
        every = range(len(self.names))
        self.variants = {(a, b): max(lengths[a], lengths[b]) for a in every for b in every if a != b and len(np.intersect1d(self.shingles[a], self.shingles[b])) >= contained * len(self.shingles[a])}
        self.bands = {g: max(1, math.ceil(math.log(1 - collide) / math.log(1 - min(s, 0.999) ** rows))) for g, s in need.items()}
        draws = rows * max(self.bands.values(), default=0)
        self.odd = mix64(np.arange(1, draws + 1, dtype=np.uint64)) | np.uint64(1)
        self.tables = {g: self._table(own, self.bands[g]) for g, own in self.groups.items()}

    def _band(self, mins: list[np.ndarray]) -> np.ndarray:
        """One number for the values of a band."""
        key = mins[0]
        for m in mins[1:]:
            key = mix64(key) ^ m
        return key

    def _table(self, templates: list[int], bands: int) -> list[tuple]:
        """For each band: its keys in order, the template of each, and which 16-bit beginnings they have."""
        out = []
        for b in range(bands):
            keys = np.array([self._band([(self.shingles[t] * a).min(keepdims=True) for a in self.odd[b * self.rows : (b + 1) * self.rows]])[0] for t in templates], np.uint64)
            order = np.argsort(keys, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[(keys >> np.uint64(48)).astype(np.int64)] = True
            out.append((keys[order], np.array(templates)[order], known))
        return out

    def scan(self, column: pa.Array) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of every window that holds one."""
        words = Words(column, self.fold)
        out = []
        for size in sorted({size for size, _ in self.groups}):
            start, h = words.grams(size)
            if not len(h):
                continue
            text = words.text[start]
            at = start - words.begin[text]
            steps = sorted(step for s, step in self.groups if s == size)
            cuts = {step: np.flatnonzero(at % step == 0) for step in steps}
            met: set[tuple[int, int, int]] = set()
            for b in range(max(self.bands[size, step] for step in steps)):
                values = [h * a for a in self.odd[b * self.rows : (b + 1) * self.rows]]
                for step in steps:
                    if b < self.bands[size, step]:
                        key = self._band([_window_mins(v, cuts[step], text[cuts[step]]) for v in values])
                        keys, templates, known = self.tables[size, step][b]
                        for w in np.flatnonzero(known[(key >> np.uint64(48)).astype(np.int64)]).tolist():
                            same = slice(*(int(np.searchsorted(keys, key[w], side)) for side in ("left", "right")))
                            met.update((step, w, t) for t in templates[same].tolist())
            for step, w, template in sorted(met):
                a = int(cuts[step][w])
                own = h[a : a + SEGMENTS * step][text[a : a + SEGMENTS * step] == text[a]]
                here = np.isin(own, self.shingles[template])
                share = len(np.unique(own[here])) / len(self.shingles[template])
                if share >= self.contained:
                    out.append((int(text[a]), template, share, int(at[a + int(here.argmax())])))
        return self._closest(out)

    def _closest(self, hits: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
        """Hits without those of which a variant has more shingles in the same place, or as many and a larger share."""
        by_text: dict[int, list[tuple[int, tuple, int]]] = {}
        fit = lambda template, share: (round(share * len(self.shingles[template])), share)
        for t, template, share, first in hits:
            by_text.setdefault(t, []).append((template, fit(template, share), first))
        return [(t, a, share, first) for t, a, share, first in hits if not any(more > fit(a, share) and abs(at - first) <= self.variants.get((a, b), -1) for b, more, at in by_text[t])]


def _window_mins(values: np.ndarray, cuts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least value of each window: the segment that begins at a cut and the next ones of its text."""
    own = np.minimum.reduceat(values, cuts)
    out = own
    for k in range(1, SEGMENTS):
        later = np.full(len(own), np.iinfo(np.uint64).max)
        same = text[k:] == text[:-k]
        later[: len(own) - k][same] = own[k:][same]
        out = np.minimum(out, later)
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, contained: float = CONTAINED, collide: float = COLLIDE) -> DataFrame:
    """``doc_id license template containment first_word``: licenses in whole texts.

    One row for each document row, license and template found, with the largest
    containment of its windows and the first word of that match; where a variant
    of a template (another version of a notice) fits better in the same place,
    only the variant is reported (words are runs
    of ASCII letters and digits in any case, and of bytes beyond ASCII). A null
    or empty text holds none; null and repeated doc_ids are scanned like others;
    other columns are not carried. There is no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, contained, collide)
        for batch in batches:
            for part in chunks(batch, "text"):
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for text, template, share, first in scanner.scan(part.column("text")):
                    new = (share, -first)
                    best[text, template] = max(best.get((text, template), new), new)
                rows = [(text, *scanner.names[template], share, -first) for (text, template), (share, first) in sorted(best.items())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                ids = part.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64())], ["doc_id", "license", "template", "containment", "first_word"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, template int, containment double, first_word bigint")
