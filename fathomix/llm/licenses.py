"""License scans by patience alignment with templates.

Words common to a template and a stretch of text, and unique in both, are anchors; the longest
increasing subsequence of anchors is kept and the gaps between them are aligned in the same way.  A gap
without anchors is aligned by the longest common subsequence of all its equal words.  Coverage is the
share of a template's words that are aligned.

A stretch is up to twice a template's length to each side of a key word; shorter ones, from the
template's length on, keep copies apart that stand close together, and begin after the copy before.  The
key words of a template are its longest, so many that a text without any of them cannot reach the coverage asked for; texts are
tokenised only if they hold one.  Stretches are bounded by the template, so a text costs in proportion
to its key words.  Of overlapping finds the one with more aligned words stays.

Defined cases: null, empty and wordless texts have no licenses; a notice that occurs several times is found
as often; of overlapping finds with equally many aligned words the one of greater coverage stays, then the first,
then the one whose name sorts first; very long texts are read whole, in time in proportion to their key words; rows that repeat an id are
reported row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomix.llm.arrow import map_text

COVERAGE = 0.8
#: Aligned words are at least this share of the words from the first to the last.
DENSITY = 0.6
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Well-known notices, by their usual names.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}

FIELDS = [
    T.StructField(
        "licenses",
        T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("license", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType())])),
    )
]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, given by first element, in which both elements strictly increase."""
    # Of pairs with the same first element only one may stand: the larger second element comes first.
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tails, b)
        back[i] = last[k - 1] if k else -1
        tails[k : k + 1] = [b]
        last[k : k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned words a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1 and na[b[j]] == 1}
        anchors = increasing([(i, once[a[i]]) for i in range(a0, a1) if a[i] in once])
        if not anchors:
            at: dict[str, list[int]] = {}
            for j in range(b0, b1):
                at.setdefault(b[j], []).append(j)
            out += increasing([(i, j) for i in range(a0, a1) for j in at.get(a[i], ())])
            continue
        out += anchors
        limits = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(limits, limits[1:], strict=False)]
    return sorted(out)


class Templates:
    """Word lists of templates and, for each key word, the templates it stands for."""

    def __init__(self, texts: dict[str, str], coverage: float):
        self.words = {name: [w.lower() for w in WORD.findall(t)] for name, t in texts.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.coverage = coverage
        spread = Counter(w for words in self.words.values() for w in set(words))
        self.keys: dict[str, list[str]] = {}
        for name, words in self.words.items():
            n, total = Counter(words), 0
            for w in sorted(n, key=lambda w: (-len(w), spread[w], w)):
                self.keys.setdefault(w, []).append(name)
                total += n[w]
                if total > (1 - coverage) * len(words) + 1e-9:
                    break

    def find(self, text: str | None) -> list[dict]:
        low = (text or "").lower()
        if not any(k in low for k in self.keys):
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in spans]
        found: list[dict] = []
        reach: dict[str, int] = {}  # the last word of each template's finds
        for i, w in enumerate(words):
            for name in self.keys.get(w, ()):
                if i <= reach.get(name, -1):
                    continue
                pairs = self._best(words, i, name, reach.get(name, -1) + 1)
                if pairs:
                    first, reach[name] = pairs[0][0], pairs[-1][0]
                    n = len(self.words[name])
                    found.append({"start": spans[first][0], "end": spans[reach[name]][1], "license": name, "matched": len(pairs), "coverage": round(len(pairs) / n, 6)})
        out: list[dict] = []
        starts: list[int] = []
        for f in sorted(found, key=lambda f: (-f["matched"], -f["coverage"], f["start"], f["license"])):
            k = bisect.bisect_left(starts, f["end"])
            if not k or out[k - 1]["end"] <= f["start"]:
                out.insert(k, f)
                starts.insert(k, f["start"])
        return out

    def _best(self, words: list[str], i: int, name: str, least: int) -> list[tuple[int, int]]:
        """The alignment that reaches over word i, holds no word before ``least``, and has most aligned
        words less the others between them; empty if there is none.

        Stretches from a template's own length on are tried, so that the words of a near copy stay out.
        """
        template = self.words[name]
        n, best, most = len(template), [], 0
        widest = (max(least, i - 2 * n), min(len(words), i + 2 * n + 1))
        stretches = {widest}
        if not self._may_hold(words, *widest, name):
            return []
        for p in (p for p, w in enumerate(template) if w == words[i]):
            for slack in (0, n // 8 + 1, n // 3 + 1):
                stretches.add((max(least, i - p - slack), min(len(words), i - p + n + slack)))
        for low, high in sorted(stretches, key=lambda x: (x[1] - x[0], x)):
            if not self._may_hold(words, low, high, name):
                continue
            pairs = self._densest([(low + a, b) for a, b in align(words[low:high], template)])
            if len(pairs) < self.coverage * n or not pairs[0][0] <= i <= pairs[-1][0]:
                continue
            span = pairs[-1][0] - pairs[0][0] + 1
            if len(pairs) >= DENSITY * span and 2 * len(pairs) - span > most:
                best, most = pairs, 2 * len(pairs) - span
        return best

    def _may_hold(self, words: list[str], low: int, high: int, name: str) -> bool:
        """Whether a stretch has words enough to reach the coverage."""
        left = dict(self.counts[name])
        common = 0
        for w in words[low:high]:
            if left.get(w):
                left[w] -= 1
                common += 1
        return common >= self.coverage * len(self.words[name])

    def _densest(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """pairs without those at the ends that lie far from all others."""
        while len(pairs) > 2 and pairs[-1][0] - pairs[0][0] + 1 > len(pairs) / DENSITY:
            head, tail = pairs[1][0] - pairs[0][0], pairs[-1][0] - pairs[-2][0]
            pairs = pairs[1:] if head >= tail else pairs[:-1]
        return pairs


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and licenses (start, end, license, matched, coverage; code points): one row a row of docs."""
    every = Templates(templates or TEMPLATES, coverage)

    def run(texts: pa.Array) -> list:
        return [[every.find(t) for t in texts.to_pylist()]]

    return map_text(docs, text, FIELDS, lambda: run, [doc_id])


def license_string(licenses: str):
    return F.array_join(F.transform(licenses, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.format_string("%.4f", x["coverage"]))), ",")
