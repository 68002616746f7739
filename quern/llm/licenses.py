"""License scans by conditional compression.

Texts are read as words, so it doesn't matter how a license is wrapped,
indented or commented out. Around words that license texts use, windows are
searched whose size depends on the template alone, not on lines: each holds
any stretch of the template's size, with up to half as many words and SLACK
added at each side of the longest run of words they share. A template is
confirmed by its exact wording: the words that stretch and template share, in
order, must be SHARE of the template's, and the words that differ inside of
the stretch are reported. Windows whose words can't reach SHARE are passed
over; that loses none.

Stretches are compressed with zstandard alone and with their template as raw
dictionary. The one whose template saves the most bytes counts, those that
overlap it don't, and so on with the rest until nothing is confirmed; so each
license of a text has its row.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, pick, table

SHARE, LEAST_SAVED, LEVEL, SLACK = 0.8, 6, 9, 8
#: Words around which licenses are looked for. Also read by Java, so without look-around.
CUE = r"(?i)licen[cs]|copyright|permission is hereby|redistribut|warrant|merchantab|creative commons|\bcc[ -](by|0)|\bgpl|public domain|all rights reserved|without limitation|damages|software"
SCHEMA = "doc_id long, block int, first_line int, last_line int, license string, saved int, plain int, share double, exact boolean, differences string"

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

#: Notices and reference lines, by license and variant.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT/line": "Released under the MIT License.",
    "MIT/text": _MIT,
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause/text": _BSD,
    "BSD-3-Clause/text": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD/line": "Released under the BSD License.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_CUE = re.compile(CUE)
_WORD = re.compile(r"[\w.]*\w")


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def located(text: str) -> tuple[list[str], list[int], list[int]]:
    """The text's words, the line of each, and the indices of words at which a cue begins, ascending."""
    words: list[str] = []
    line: list[int] = []
    cues: list[int] = []
    for i, row in enumerate(text.lower().split("\n")):
        at = [(m.group(), m.end()) for m in _WORD.finditer(row)]
        ends = [e for _, e in at]
        cues += [len(words) + k for m in _CUE.finditer(row) if (k := bisect_right(ends, m.start())) < len(at)]
        words += [w for w, _ in at]
        line += [i] * len(at)
    return words, line, cues


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES) -> None:
        # with the text it looks for, zstandard is asked for the same search effort, dictionary or not
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
        self.given = {}
        #: names of templates by the words that a stretch of theirs can have at most
        self.sizes: dict[int, list[str]] = {}
        for name, text in sorted(templates.items()):
            words = normal(text)
            d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = (words, Counter(words), zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)
            if words:
                self.sizes.setdefault(2 * ((1 << (len(words) - 1).bit_length()) + SLACK), []).append(name)

    def possible(self, name: str, words: list[str]) -> bool:
        template, bag, _ = self.given[name]
        have = bag.keys() & set(words)
        return sum(bag[w] for w in have) >= SHARE * len(template)

    def wording(self, block: list[str], template: list[str]) -> tuple[float, int, int, list[str]]:
        """Share of the template's words found in order, the stretch of the block they are in, and the differences inside of it."""
        runs = [r for r in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if r.size]
        # single words that happen to stand before or after the license aren't its own, as long as the rest confirms it
        best = None
        for i in range(len(runs)):
            found = 0
            for k in range(i, len(runs)):
                found += runs[k].size
                if found >= SHARE * len(template):
                    score = found - (runs[k].b + runs[k].size - runs[i].b - found) / 2
                    if best is None or score > best[0]:
                        best = (score, found, runs[i : k + 1])
        if best is None:
            return 0.0, 0, 0, []
        _, found, runs = best
        diffs, i, j = [], 0, runs[0].b
        for r in runs:
            if (r.a, r.b) != (i, j):
                diffs.append(f"-{' '.join(template[i : r.a])} +{' '.join(block[j : r.b])}")
            i, j = r.a + r.size, r.b + r.size
        if i < len(template):
            diffs.append(f"-{' '.join(template[i:])} +")
        return found / len(template), runs[0].b, j, diffs

    def confirmed(self, name: str, words: list[str], lo: int, hi: int) -> Iterator[tuple[float, int, int, list[str]]]:
        """(share, first word, end, differences) of the template's stretches in words[lo:hi]."""
        template = self.given[name][0]
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            part = words[lo:hi]
            if len(part) < SHARE * len(template) or not self.possible(name, part):
                continue
            m = difflib.SequenceMatcher(None, template, part, autojunk=False).find_longest_match(0, len(template), 0, len(part))
            if not m.size:
                continue
            room = len(template) // 2 + SLACK
            a, b = max(lo, lo + m.b - m.a - room), min(hi, lo + m.b - m.a + len(template) + room)
            share, i, j, diffs = self.wording(words[a:b], template)
            if share >= SHARE:
                a, b = a + i, a + j
                yield share, a, b, diffs
            else:
                a, b = lo + m.b, lo + m.b + m.size
            todo += [(lo, a), (b, hi)]

    def candidates(self, words: list[str], cues: list[int], lo: int, hi: int) -> list[tuple]:
        """(-saved, number of differences, -words of the template, name, first word, end, plain, share, differences) of the confirmed stretches in words[lo:hi]."""
        out = {}
        for size, names in self.sizes.items():
            for s in range(lo, hi, size):
                e = min(hi, s + 2 * size)
                k = bisect_left(cues, s)
                if k == len(cues) or cues[k] >= e:
                    continue
                for name in names:
                    template, _, given = self.given[name]
                    for share, a, b, diffs in self.confirmed(name, words, s, e):
                        if (name, a, b) in out:
                            continue
                        data = " ".join(words[a:b]).encode("utf-8", "replace")
                        plain = len(self.plain(data))
                        saved = plain - len(given(data))
                        if saved >= LEAST_SAVED:
                            out[name, a, b] = (-saved, len(diffs), -len(template), name, a, b, plain, share, diffs)
        return sorted(out.values())

    def scan(self, text: str | None) -> list[tuple[int, int, int, str, int, int, float, bool, str]]:
        words, line, cues = located(text) if text else ([], [], [])
        taken: list[tuple] = []
        todo = [(0, len(words))] if cues else []
        while todo:
            lo, hi = todo.pop()
            mine: list[tuple] = []
            over: list[tuple] = []
            for c in self.candidates(words, cues, lo, hi):
                (over if any(c[4] < t[5] and t[4] < c[5] for t in mine) else mine).append(c)
            taken += mine
            # what overlaps a license may have another one in the words that are left
            edges = [lo, *(x for t in sorted(mine, key=lambda t: t[4]) for x in t[4:6]), hi]
            todo += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if any(c[4] < b and a < c[5] for c in over)]
        taken.sort(key=lambda t: t[4])
        return [(n, line[a], line[b - 1], name, -saved, plain, share, not diffs, "; ".join(diffs)) for n, (saved, _, _, name, a, b, plain, share, diffs) in enumerate(taken)]


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """A row for each confirmed license: doc_id, block, first and last line, license, saved and plain bytes, share, exact, differences.

    Blocks are the stretches of words that licenses have, numbered within a
    text; lines and bytes are theirs. Of templates that save equally much the
    one with the fewest differences counts, then the longest. Null and empty texts have no rows; repeated rows
    are each scanned; a null doc_id stays null; further columns of docs are
    left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(shared.value)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]
        for b in batches(it, 16 << 20):
            rows, idx = [], []
            for k, t in enumerate(b["text"].to_pylist()):
                for r in s.scan(t):
                    rows.append(r)
                    idx.append(k)
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(idx, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], [c.split()[0] for c in SCHEMA.split(", ")])

    src = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.where(F.col("text").rlike(CUE)).mapInArrow(run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
