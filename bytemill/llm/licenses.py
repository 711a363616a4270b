"""Licence scans: Dice coefficient over word bigrams between parts of a text and licence templates.

Words are runs of ASCII letters and digits and of bytes from 0x80 up; A-Z count as a-z; all else separates. A span's set holds its distinct
pairs of neighbouring words; Dice is 2 |A and B| / (|A| + |B|). Spans are a text's lines, its paragraphs (between blank lines), the
whole text, and the stretches in which a template's pairs are dense and enough for it, wherever lines end: a notice inside a sentence, a licence over many
paragraphs. A template can reach `least` only for spans with |A| / |B| between least / (2 - least) and its inverse, which prunes
most templates for a span; and a text is looked at only if some template shares enough distinct pairs with all of it, which
one sorted lookup of 64-bit hashes tells for all pairs of a batch. Dice itself is computed on the words.

A text's matches are its spans at `least` or above, each with its best template (ties: the smaller name), and of overlapping ones the one
that shares most pairs with its template (ties: the higher Dice, the earlier, the shorter), so a licence goes before a notice that it quotes; the licence of the
text is that of the match, among those that are no mere notice of rights, that comes first in the same order. Null and
empty texts, and spans of fewer than two words, match nothing. Rows are independent of one another, repeated ones alike; an empty table gives an
empty result; a text of any length is one span only if its set is small enough for a template; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.llm.arrow import LOWER, U64, hash_spans, mapped, mix, slices, utf8, words

PIECE, LEAST, GAP = 2 << 20, 0.8, 0.5
#: Templates that say something of rights but are no licence: among the matches, never the licence of a text.
NOTICES = {"all rights reserved"}
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Bytes of words as they are, a line feed as it is, all else a space.
_PLAIN = np.full(256, 0x20, dtype=np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100), 0x0A]:
    _PLAIN[_b] = _b

#: Public licence texts and notices, fixed values; the long ones are the files in FOLDER.
FOLDER = Path(__file__).parent / "licences"
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0 header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "all rights reserved": 'All rights reserved.',
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0 notice": 'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    "CC-BY-NC-4.0 notice": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-SA-4.0 notice": 'Licensed under CC BY-SA 4.0.',
    "CC0-1.0 notice": 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
    "GPL-2.0 header": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "GPL-3.0 header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "GPL-3.0 notice": 'This work is licensed under the GNU General Public License, version 3.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0 header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT notice": 'Released under the MIT License.',
    "MPL-2.0 header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def pairs(part: bytes) -> set[tuple[bytes, bytes]]:
    """The distinct pairs of neighbouring words."""
    w = _WORD.findall(part.lower())
    return set(zip(w, w[1:], strict=False))


def templates() -> dict[str, str]:
    """All that ship: TEMPLATES, and the files' texts under their names."""
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(FOLDER.glob("*.txt"))}


class Templates:
    """Templates by the size of their sets, and which templates each pair's hash is in."""

    def __init__(self, texts: dict[str, str], least: float):
        made = sorted(((len(s), name, s) for name, t in texts.items() if (s := pairs(t.encode()))), key=lambda x: x[:2])
        self.sizes, self.sets, self.least = [x[0] for x in made], made, least
        data, offsets = utf8(pa.array([texts[name] for _, name, _ in made], type=pa.string()))
        code, _, _, number = bigrams(data, offsets)
        both = np.unique(np.stack([code, number.astype(U64)], axis=1), axis=0) if len(code) else np.zeros((0, 2), U64)
        self.hashes, first = np.unique(both[:, 0], return_index=True)
        self.owner, self.first = both[:, 1].astype(np.int64), np.append(first, len(both))
        #: Pairs that a span must share with each template at least: 2 i >= least (|A| + |B|) and |A| >= i.
        self.need = np.array(self.sizes) * least / (2 - least) - 1e-9
        self.most = (2 - least) / least * max(self.sizes, default=0) + 1e-9

    def best(self, part: bytes) -> tuple[float, str, int] | None:
        """Dice and name of the best template, if it reaches the least, and the pairs shared."""
        s = pairs(part)
        low, high = len(s) * self.least / (2 - self.least), len(s) * (2 - self.least) / self.least
        found = None
        for n, name, t in self.sets[bisect_left(self.sizes, low - 1e-9) : bisect_right(self.sizes, high + 1e-9)]:
            shared = len(s & t)
            dice = 2 * shared / (len(s) + n)
            if dice >= self.least and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name, shared
        return found


def stretches(at: list[int], size: int) -> Iterator[tuple[int, int]]:
    """First and last of the places `at` (ascending) of each stretch in which a template's pairs are dense.

    A place counts 1 and what lies between two of them GAP each; a stretch ends at its highest sum, when the sum comes down to 0 or
    by a fifth of the template's size (8 at least) from there.
    """
    drop = max(8, size / 5)
    first = last = total = high = None
    for i, x in enumerate(at):
        if first is not None:
            total -= GAP * (x - at[i - 1] - 1)
            if total > 0 and total > high - drop:
                total += 1
                if total > high:
                    last, high = x, total
                continue
            yield first, last
        first, last, total, high = x, x, 1, 1
    if first is not None:
        yield first, last


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each pair of neighbouring words of a text, where its first word starts and its second ends, and the text's number."""
    plain = _PLAIN[LOWER[data]]
    start, end, row = words(plain, offsets)
    word = hash_spans(plain, start, end)
    same = row[1:] == row[:-1]
    code = mix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:])[same]
    return code, start[:-1][same], end[1:][same], row[1:][same]


def _parts(text: bytes) -> Iterator[tuple[int, int]]:
    """Lines, paragraphs of several lines, and the whole text if it has several paragraphs."""
    at, first, lines = 0, None, 0
    paragraphs = 0
    for line in [*text.split(b"\n"), b""]:
        if line.strip():
            yield at, at + len(line)
            first, lines = at if first is None else first, lines + 1
            last = at + len(line)
        elif first is not None:
            paragraphs += 1
            if lines > 1:
                yield first, last
            first, lines = None, 0
        at += len(line) + 1
    if paragraphs > 1:
        yield 0, len(text)


def _rank(m: dict) -> tuple:
    return -m["shared"], -m["dice"], m["start"], m["end"], m["license"]


def _apart(found: list[dict]) -> list[dict]:
    """Of spans that overlap the first by rank stays; in the order of the text."""
    out: list[dict] = []
    for m in sorted(found, key=_rank):
        if all(m["end"] <= x["start"] or m["start"] >= x["end"] for x in out):
            out.append(m)
    return sorted(out, key=lambda m: m["start"])


def scan(df: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, license, dice (null without a match), matches: array of (start, end, license, dice, shared), places in bytes of the text."""
    shared = df.sparkSession.sparkContext.broadcast(Templates(templates() if texts is None else texts, least))

    def candidates(held: Templates, code: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Rows that share enough pairs with a template, with the stretches of pairs (first, last) in which they do."""
        if not len(held.hashes) or not len(code):
            return
        at = np.minimum(np.searchsorted(held.hashes, code), len(held.hashes) - 1)
        place = np.flatnonzero(held.hashes[at] == code)
        which = at[place]
        count = held.first[which + 1] - held.first[which]
        owner = held.owner[np.repeat(held.first[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        place, which = np.repeat(place, count), np.repeat(which, count)
        key = row[place] * len(held.sizes) + owner
        by = np.argsort(key, kind="stable")
        key, place, which = key[by], place[by], which[by]
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        enough = np.diff(cuts) >= held.need[key[cuts[:-1]] % len(held.sizes)]
        found: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(cuts[:-1][enough].tolist(), cuts[1:][enough].tolist(), strict=True):
            t = int(key[a]) % len(held.sizes)
            if len(np.unique(which[a:b])) >= held.need[t]:
                mine = found.setdefault(int(key[a]) // len(held.sizes), [])
                for i, j in stretches(place[a:b].tolist(), held.sizes[t]):
                    inside = which[a:b][(place[a:b] >= i) & (place[a:b] <= j)]
                    if len(np.unique(inside)) >= held.need[t]:
                        mine.append((i, j))
        yield from found.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in slices(batches, "t", PIECE):
            data, offsets = utf8(batch.column("t"))
            code, start, end, row = bigrams(data, offsets)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r, spans in candidates(held, code, row):
                base, text = int(offsets[r]), data[offsets[r] : offsets[r + 1]].tobytes()
                mine = slice(*np.searchsorted(row, [r, r + 1]).tolist())
                s, e = start[mine] - base, end[mine] - base
                parts = {(int(start[i]) - base, int(end[j]) - base) for i, j in spans}
                for a, b in sorted(parts.union(_parts(text))):
                    pairs_in = code[mine][np.searchsorted(s, a) : np.searchsorted(e, b, side="right")]
                    if held.need[0] <= len(pairs_in) and (len(pairs_in) <= held.most or len(np.unique(pairs_in)) <= held.most) and (m := held.best(text[a:b])):
                        found[r].append({"start": a, "end": b, "license": m[1], "dice": m[0], "shared": m[2]})
                found[r] = _apart(found[r])
            best = [min((m for m in f if m["license"] not in NOTICES), key=_rank, default=None) for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64()), ("shared", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([b and b["license"] for b in best], pa.string()), pa.array([b and b["dice"] for b in best], pa.float64()), pa.array(found, kind)], names=[id_col, "license", "dice", "matches"])

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, f"`{id_col}` {kind}, license string, dice double, matches array<struct<start: long, end: long, license: string, dice: double, shared: long>>")
