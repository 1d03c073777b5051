"""License scans by patience alignment (operator 2).

A text and a license template are aligned by words: words that occur once in both are
anchors, the longest increasing subsequence of their places is kept, equal neighbours extend
it, and the gaps between anchors are aligned in the same way. The aligned words over the
template's words are its coverage. Words that tell a license from its kin (names, versions;
marked by braces) have to be among the aligned. A template is aligned around each occurrence
of the word of it that the text has least often, for every place of that word in the
template; around a long template the window is widened until the coverage stops growing, so
text put in between does not hide a copy. Of copies that overlap, the one with most aligned words
counts. A text that lacks too many of a template's words is never aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from weftlake.llm.common import documents, idle, text_or_empty, text_runs

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. {Neither} the {name} of the copyright holder nor the names of its {contributors} may be used to {endorse} or {promote} products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation"
#: Public license texts, titles and notices, by SPDX identifier. Braces mark the words that have to be there.
TEMPLATES = {
    "MIT": "Released under the {MIT} License.",
    "MIT (notice)": "Licensed under the {MIT} License.",
    "MIT (text)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT (text and warranty)": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "Apache-2.0": "Licensed under the {Apache} License, Version {2.0}.",
    "Apache-2.0 (header)": "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 (title)": "{Apache} License Version {2.0}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": "This work is licensed under the {GNU} {General} Public License, version {3}.",
    "GPL-2.0": "This work is licensed under the {GNU} {General} Public License, version {2}.",
    "LGPL-3.0": "This work is licensed under the {GNU} {Lesser} General Public License, version {3}.",
    "LGPL-2.1": "This work is licensed under the {GNU} {Lesser} General Public License, version {2.1}.",
    "AGPL-3.0": "This work is licensed under the {GNU} {Affero} General Public License, version {3}.",
    "GPL (header)": "This program is free software: " + _GNU.format(name="{General}"),
    "LGPL (header)": "This library is free software; " + _GNU.format(name="{Lesser} General"),
    "AGPL (header)": "This program is free software: " + _GNU.format(name="{Affero} General"),
    "GPL-3.0 (title)": "GNU {GENERAL} PUBLIC LICENSE Version {3}, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-2.0 (title)": "GNU {GENERAL} PUBLIC LICENSE Version {2}, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0 (title)": "GNU {LESSER} GENERAL PUBLIC LICENSE Version {3}, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "AGPL-3.0 (title)": "GNU {AFFERO} GENERAL PUBLIC LICENSE Version {3}, 19 November 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0": "Licensed under the {Mozilla} Public License, version {2.0}.",
    "EPL-2.0 (header)": "This program and the accompanying materials are made available under the terms of the {Eclipse} Public License {2.0} which is available at",
    "BSD": "Released under the {BSD} License.",
    "BSD-2-Clause": "Licensed under the {BSD} {2}-Clause License.",
    "BSD-3-Clause": "Licensed under the {BSD} {3}-Clause License.",
    "BSD-2-Clause (text)": _BSD + _BSD_END,
    "BSD-3-Clause (text)": _BSD + _BSD_3 + _BSD_END,
    "ISC (text)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib (text)": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0 (notice)": "Distributed under the {Boost} Software License, Version {1.0}.",
    "Unlicense (text)": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author has {waived} all copyright and related or neighboring rights to this work.",
}
#: The parts of Creative Commons names, from which their notices are made.
_CC_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _name in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _version in ("4.0", "3.0", "2.0"):
        _long = "-".join(_CC_PARTS[x] for x in _name.split("-"))
        TEMPLATES[f"CC-{_name}-{_version}"] = f"Licensed under {{CC}} {{{_name}}} {{{_version}}}."
        TEMPLATES[f"CC-{_name}-{_version} (notice)"] = f"This work is licensed under a {{Creative}} {{Commons}} {{{_long}}} {{{_version}}} License."
#: Aligned words over a template's words, from which it counts as found.
LEAST_COVERAGE = 0.8
#: Templates of at most so many words are notices: aligned in a window of about their length.
SHORT = 20
#: Coverage of a first window from which a wider one is tried.
WORTH = 0.3
_WORD = re.compile(rb"[a-z0-9]+")
_PLACED = re.compile(r"[A-Za-z0-9]+")


def words(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(text.encode("utf-8", "replace").lower())]


def increasing(places: list[int]) -> list[int]:
    """Positions in places of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), in order, of equal words. Gaps are kept on a list, not a call stack."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [both[i] for i in increasing([j for _, j in both])]
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in anchors:
            out.append((i, j))
            gaps.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        gaps.append((i0, a1, j0, b1))
    return sorted(out)


class Template:
    """A template's words, the places of each, and the places that have to be aligned."""

    def __init__(self, name: str, text: str):
        self.name, self.words, self.telling = name, [], set()
        for i, part in enumerate(re.split(r"[{}]", text)):
            new = words(part)
            if i % 2:
                self.telling.update(range(len(self.words), len(self.words) + len(new)))
            self.words += new
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        missing = len(self.words) - self.least()
        self.least_distinct = max(1, len(self.places) - missing)
        self.told_by = {self.words[i] for i in self.telling}

    def least(self) -> int:
        """Aligned words that make the coverage."""
        n = len(self.words)
        return next(k for k in range(n + 1) if k >= LEAST_COVERAGE * n)

    def aligned(self, text: list[str], at: int, low: int) -> tuple[int, list[tuple[int, int]]]:
        """The best alignment around a text's word at: (first word of the window, pairs). The window of a
        short notice is its length and a little; that of a longer text grows while it covers more."""
        best: tuple[int, list] = (at, [])
        n = len(self.words)
        for i in self.places[text[at]]:
            slack, before = max(2, n // 5), -1
            while True:
                lo, hi = max(low, at - i - slack, 0), min(len(text), at - i + n + slack)
                pairs = patience(text[lo:hi], self.words)
                if len(pairs) > len(best[1]):
                    best = lo, pairs
                if n <= SHORT or len(pairs) <= max(before, WORTH * n) or (lo == max(low, 0) and hi == len(text)):
                    break
                before, slack = len(pairs), 2 * slack
        return best


def plain(template: str) -> str:
    """A template without its marks."""
    return re.sub(r"[{}]", "", template)


def find(text: list[str], seen: dict[str, int], templates: list[Template]) -> list[tuple[int, int, int, Template]]:
    """(first word, end word, aligned words, template) of each copy, in order; copies do not overlap."""
    out = []
    for t in templates:
        there = [w for w in t.places if w in seen]
        if len(there) < t.least_distinct or not t.told_by <= seen.keys():
            continue
        # A copy may lack the rarest word: with one more word than a copy can lack, one of them is in it.
        rare = set(sorted(there, key=lambda w: (seen[w], t.places[w]))[: len(t.words) - t.least() + 1])
        if t.told_by:  # a copy holds all of these
            rare = {min(t.told_by, key=lambda w: (seen[w], t.places[w]))}
        done = 0
        for p in [i for i, w in enumerate(text) if w in rare]:
            if p < done:
                continue
            lo, pairs = t.aligned(text, p, done)
            if len(pairs) >= t.least() and t.telling <= {j for _, j in pairs}:
                done = lo + pairs[-1][0] + 1
                out.append((lo + pairs[0][0], done, len(pairs), t))
    kept: list[tuple[int, int, int, Template]] = []
    for h in sorted(out, key=lambda h: (-h[2], -h[2] / len(h[3].words), h[0], h[3].name)):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h[0])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_licenses, license, coverage, spans.

    docs needs doc_id and text; other columns are ignored, whatever their names. spans lists
    name:start:end:coverage of each copy (code points, end exclusive) in order; license is
    the one with most aligned words (ties: the first), with its coverage. A null text counts
    as empty. Where none is found: 0, null, 0.0 and an empty string. Repeated rows are
    scanned each, and texts of any length are scanned whole. An empty table gives an empty result.
    """
    given = templates or TEMPLATES
    names = ["doc_id", "n_licenses", "license", "coverage", "spans"]

    def run(batches):
        known = [Template(k, v) for k, v in given.items()]
        wanted = {w.encode() for t in known for w in t.words}
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in (t for _, texts in text_runs(batch) for t in texts):
                found = _WORD.findall(text.encode("utf-8", "replace").lower())
                hits = []
                if len(wanted.intersection(found)) >= min(t.least_distinct for t in known):
                    plain = [w.decode() for w in found]
                    hits = find(plain, Counter(plain), known)
                best, spans = None, []
                if hits:
                    places = [m.span() for m in _PLACED.finditer(text)]
                    spans = [f"{t.name}:{places[i][0]}:{places[j - 1][1]}:{n / len(t.words):.3f}" for i, j, n, t in hits]
                    best = max(hits, key=lambda h: h[2])
                for c, v in zip(cols, (len(hits), best and best[3].name, best[2] / len(best[3].words) if best else 0.0, ",".join(spans))):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)
        idle()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_licenses long, license string, coverage double, spans string")


def op2(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
