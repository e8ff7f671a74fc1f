"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and templates are words of ASCII letters and digits and all other
characters beyond ASCII, lower-cased; a shingle is five words (a shorter
template is one shingle). For templates of more than L/2 and up to L shingles a
text is cut into blocks of L shingles, and every two neighbours form a window,
so that a run of L shingles lies in some window as a whole. A window that holds
0.8 of such a template has a Jaccard similarity above 0.19 with it; with 64
bands of one hash each it collides with probability 1 - 0.81^64, over 0.999998.
Candidates are then compared shingle by shingle.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
BANDS = 64
CONTAINMENT = 0.8
LEAST_BLOCK = 2
#: Shingles hashed in one go.
STRETCH = 1 << 14
#: Bits of a band value that are looked up before the search.
LOW_BITS = 14
#: Text of the templates that a job carries at most.
MAX_TEMPLATE_BYTES = 32 << 20
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

# Public license notices and texts, as they are commonly written.
LICENSES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))] if words else []


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A mixed 32-bit hash of each five-word shingle, from the words' checksums."""
    if len(words) < WIDTH:
        return np.zeros(0, np.uint32)
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 31, BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS, dtype=np.uint32)


_A, _B = _coefficients()


def _permuted(hashes: np.ndarray) -> np.ndarray:
    """One column for each band."""
    x = hashes[:, None] * _A + _B
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


class SizeClass:
    """Templates of about one size, found by their band values.

    A table of bits by the low end of a band value lets most values of a window
    go at once; the others are searched in the sorted (band, value) keys of all
    templates, so the work does not grow with their number.
    """

    def __init__(self, members: list[tuple[str, frozenset, np.ndarray]]):
        self.names = [m[0] for m in members]
        self.held = [m[1] for m in members]
        signatures = np.vstack([m[2] for m in members])
        owners = np.repeat(np.arange(len(members)), BANDS)
        keys = (np.tile(np.arange(BANDS, dtype=np.uint64), len(members)) << np.uint64(32)) | signatures.ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.low_bits = np.zeros((BANDS, 1 << LOW_BITS), bool)
        self.low_bits[np.arange(BANDS), signatures & np.uint32((1 << LOW_BITS) - 1)] = True

    def retrieve(self, windows: np.ndarray) -> list[tuple[int, int]]:
        """(window, template) of every pair with a common band."""
        at, band = np.nonzero(self.low_bits[np.arange(BANDS), windows & np.uint32((1 << LOW_BITS) - 1)])
        keys = (band.astype(np.uint64) << np.uint64(32)) | windows[at, band]
        first, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        counts = end - first
        place = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return sorted(set(zip(np.repeat(at, counts).tolist(), self.owners[place].tolist(), strict=True)))


class Templates:
    """Templates by size class, with their signatures and shingles."""

    def __init__(self, templates: dict[str, str]):
        members: dict[int, list[tuple[str, frozenset, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if len(words) < WIDTH:
                continue
            block = LEAST_BLOCK
            while block < len(words) - WIDTH + 1:
                block *= 2
            members.setdefault(block, []).append((name, frozenset(shingles(words)), _permuted(shingle_hashes(words)).min(axis=0)))
        self.classes = {block: SizeClass(held) for block, held in members.items()}

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word of the window, shared shingles, containment) of the best window, for each license found."""
        words = words_of(text)
        hashes = shingle_hashes(words)
        best: dict[str, tuple[str, int, int, float]] = {}
        largest = max(self.classes, default=LEAST_BLOCK)
        stretch = max(STRETCH, 2 * largest)
        # Stretches overlap by the largest block, so no window is lost between them.
        for at in range(0, max(len(hashes), 1), stretch - largest):
            part = hashes[at : at + stretch]
            if not len(part):
                break
            lows, block = _permuted(part), 1
            while block < largest:
                if len(lows) % 2:
                    lows = np.vstack([lows, np.full((1, BANDS), 0xFFFFFFFF, np.uint32)])
                lows, block = np.minimum(lows[::2], lows[1::2]), 2 * block
                if block in self.classes:
                    windows = np.minimum(lows[:-1], lows[1:]) if len(lows) > 1 else lows
                    known = self.classes[block]
                    for k, template in known.retrieve(windows):
                        name, held, start = known.names[template], known.held[template], at + k * block
                        shared = len(held.intersection(shingles(words[start : start + 2 * block + WIDTH - 1])))
                        if shared >= CONTAINMENT * len(held) and (name not in best or shared > best[name][2]):
                            best[name] = (name, start, shared, shared / len(held))
            if at + stretch >= len(hashes):
                break
        return [best[k] for k in sorted(best)]


_ready: dict[str, Templates] = {}


def _index(name: str, sent: Broadcast) -> Templates:
    """The templates of this broadcast, prepared once in a worker."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Templates(sent.value)
    return _ready[name]


def template_table(templates: DataFrame, max_bytes: int = MAX_TEMPLATE_BYTES) -> dict[str, str]:
    """The templates of a table (license, text): rows without a name or text are left out, of two texts for a name the smaller string stands.

    The table is sent to every task; one of more than ``max_bytes`` is an error.
    """
    given = templates.where("license IS NOT NULL AND text IS NOT NULL").groupBy("license").agg(F.min("text").alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{size} bytes of license texts; up to {max_bytes} can be sent")
    return {r.license: r.text for r in given.collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(doc_id, license, first_word, shared, containment), a row for each license that a row of ``docs`` holds.

    first_word is the place of the best window (of equal ones the first).
    ``templates`` is a table (license, text), a dict, or the notices and texts
    of this module. Templates of fewer than five words are ignored. Null, empty
    and short texts hold none. Repeated rows and null ids give their own rows;
    other columns are ignored.
    """
    known = LICENSES if templates is None else template_table(templates) if isinstance(templates, DataFrame) else templates
    schema = "doc_id long, license string, first_word long, shared long, containment double"
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(known)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent)
        kind = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])
        for batch in it:
            found = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.scan(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 5, kind, strict=True)], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, schema)
