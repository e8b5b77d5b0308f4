"""Operator 4: license scan by patience alignment.

A license is a template of words. Words that stand once in the text and once in the template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned the same way, after equal words at either end of a gap
have been taken. Coverage is the share of the template's words that the alignment reaches.

A text is aligned only where that can reach the threshold: every region whose words include enough words of the template is a candidate,
found by running counts over the whole text, so a short notice in a long text and several notices in one text are all seen. In a region
an alignment starts at each place from which enough words follow, no word counted more often than the template has it, and takes in no
more text than those words need: so a second notice close by leaves the words of the first one single. What is left before and behind
a match is searched again. Overlapping matches go to the highest coverage, then to the longer template.

Defined cases: null and empty texts have no license; of equal coverage the longer template is reported, then the earlier place;
repeated rows are scanned alike; other columns are not read.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.arrow import map_text
from pulsegrid.llm.registry import query, table
from pulsegrid.llm.words import LOWER, Words, span_hashes, text_bytes

# Public license notices, as their licences ask to place them or as they open.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
THRESHOLD, REGION = 0.75, 2
EDGES = np.zeros(256, bool)
EDGES[list(b".,;:!?\"'()[]{}<>*#|")] = True
EDGE_MARKS = ".,;:!?\"'()[]{}<>*#|"


def plain_words(text: str) -> list[str]:
    """Words in lower case (A-Z) without marks at their edges; words of marks alone stay."""
    return [w.strip(EDGE_MARKS) or w for w in re.findall(r"[^\x20\x09-\x0D]+", text.translate({k: k + 32 for k in range(65, 91)}))]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        anchors = increasing(once(a, i, j), once(b, k, m))
        ends = [*anchors, (j, m)]
        out += anchors
        if anchors:
            work += [(x + 1, y, p + 1, q) for (x, p), (y, q) in zip([(i - 1, k - 1), *anchors], ends)]
    return sorted(out)


def once(words: list, first: int, last: int) -> dict:
    """Words of a range that stand in it once, with their place."""
    place, twice = {}, set()
    for at in range(first, last):
        if words[at] in place:
            twice.add(words[at])
        place[words[at]] = at
    return {w: p for w, p in place.items() if w not in twice}


def increasing(a: dict, b: dict) -> list[tuple[int, int]]:
    """Longest run of words common to both, in order of their places in both: piles whose tops stay sorted."""
    pairs = sorted((a[w], b[w]) for w in a.keys() & b.keys())
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, p) in enumerate(pairs):
        pile = bisect_left(tops, p)
        back[n] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(p)
            last.append(n)
        else:
            tops[pile], last[pile] = p, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Templates:
    """Words of each template, and which templates each word (by hash) belongs to, as bits."""

    def __init__(self, templates: dict[str, str]):
        if len(templates) > 63:
            raise ValueError("at most 63 templates at a time")
        self.names, self.words = list(templates), [plain_words(t) for t in templates.values()]
        bits: dict[int, int] = {}
        for k, words in enumerate(self.words):
            for w in set(words):
                h = int(span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
                bits[h] = bits.get(h, 0) | 1 << k
        self.hash = np.array(sorted(bits), np.uint64)
        self.bits = np.array([bits[h] for h in sorted(bits)], np.int64)
        self.first = np.zeros(1 << 16, bool)
        self.first[self.hash >> np.uint64(48)] = True


@lru_cache(maxsize=4)
def templates_of(items: tuple) -> Templates:
    return Templates(dict(items))


def regions(places: np.ndarray, row_end: np.ndarray, length: int, need: int) -> list[tuple[int, int]]:
    """Word ranges in which ``need`` of the given places lie within ``REGION`` template lengths."""
    stop = np.minimum(places + REGION * length, row_end)
    dense = np.searchsorted(places, stop) - np.arange(len(places)) >= need
    out: list[list[int]] = []
    for a, b in zip(places[dense].tolist(), stop[dense].tolist()):
        if out and a < out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def promising(text: list, room: Counter, first: int, last: int, reach: int, need: int):
    """Places from which ``reach`` words hold ``need`` of the template's, each counted as often as it stands there at most."""
    inside, seen, total = deque(), Counter(), 0
    places = [q for q in range(first, last) if text[q] in room]
    ahead = 0
    for p in places:
        while ahead < len(places) and places[ahead] < p + reach:
            w = text[places[ahead]]
            total += seen[w] < room[w]
            seen[w] += 1
            inside.append(w)
            ahead += 1
        if total >= need:
            yield p
        w = inside.popleft()
        seen[w] -= 1
        total -= seen[w] < room[w]


def aligned(text: list, template: list, room: Counter, first: int, last: int, need: int) -> list[tuple[int, int]]:
    """Best alignment from ``first`` on, among the shortest ranges that hold need, need + 1, ... words of the template (empty: none)."""
    seen, ends = Counter(), []
    for q in range(first, last):
        w = text[q]
        if seen[w] < room.get(w, 0):
            seen[w] += 1
            ends.append(q + 1)
    best: list[tuple[int, int]] = []
    for n in range(len(ends), need - 1, -1):
        if len(best) >= n:
            break
        pairs = patience(text[first:ends[n - 1]], template)
        if len(pairs) >= max(need, len(best) + 1):
            best = [(first + i, k) for i, k in pairs]
    return best


def notices(text: list, template: list, need: int) -> list[list[tuple[int, int]]]:
    """Disjoint alignments of at least ``need`` words, as many as the text holds."""
    room, reach = Counter(template), REGION * len(template)
    out, work = [], [(0, len(text))]
    while work:
        lo, hi = work.pop()
        if hi - lo < need:
            continue
        for p in promising(text, room, lo, hi, reach, need):
            pairs = aligned(text, template, room, p, min(hi, p + 2 * reach), need)
            if not pairs:
                continue
            while True:                                                   # words before the notice may have stood for some of its end
                x = pairs[0][0]
                more = aligned(text, template, room, x, min(hi, x + 2 * reach), need)
                if len(more) <= len(pairs):
                    break
                pairs = more
            # The end may be borrowed from a next notice that begins in a gap.
            for n in range(need, len(pairs)):
                start = next((q for q in range(pairs[n - 1][0] + 1, pairs[n][0]) if text[q] in room), None)
                if start is not None and (more := aligned(text, template, room, start, min(hi, start + 2 * reach), need)) and more[0][0] < pairs[n][0]:
                    pairs = pairs[:n]
                    break
            # A gap that holds a notice itself: the match is on one side of it.
            gap = next((n for n, (i, j) in enumerate(zip(pairs, pairs[1:])) if j[0] - i[0] > need and notices(text[i[0] + 1:j[0]], template, need)), None)
            if gap is not None:
                left, right = pairs[:gap + 1], pairs[gap + 1:]
                pairs = max(left, right, key=len)
                if len(pairs) < need:
                    work += [(p, left[-1][0] + 1), (left[-1][0] + 1, right[0][0]), (right[0][0], hi)]
                    break
            out.append(pairs)
            work += [(p, pairs[0][0]), (pairs[-1][0] + 1, hi)]
            break
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: best license (null: none), its coverage and word range, number of notices and their licenses."""
    items = tuple(templates.items())

    def run(batch):
        own = templates_of(items)
        data, offsets = text_bytes(batch.column("text"))
        words = Words(LOWER[data], offsets)
        starts, ends = words.starts.copy(), words.ends.copy()
        while len(starts):
            head = (ends - starts > 0) & EDGES[words.data[np.minimum(starts, len(data) - 1)]]
            tail = (ends - starts > 1) & EDGES[words.data[ends - 1]] & ~head
            if not head.any() and not tail.any():
                break
            starts[head] += 1
            ends[tail] -= 1
        marks = ends <= starts                                            # words of marks alone
        starts[marks], ends[marks] = words.starts[marks], words.ends[marks]
        hashes = span_hashes(words.data, starts, ends)
        known = np.flatnonzero(own.first[hashes >> np.uint64(48)]) if len(hashes) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(own.hash, hashes[known]), len(own.hash) - 1)
        known, at = known[own.hash[at] == hashes[known]], at[own.hash[at] == hashes[known]]
        found: dict[int, list] = {}
        for k, template in enumerate(own.words):
            places = known[(own.bits[at] >> k) & 1 == 1]
            need = int(np.ceil(threshold * len(template)))
            row_end = words.first[1:][words.row[places]]
            for a, b in regions(places, row_end, len(template), need):
                text = [words.data[starts[w]:ends[w]].tobytes().decode("utf-8", "replace") for w in range(a, b)]
                row = int(words.row[a])
                begin = int(words.first[row])
                for pairs in notices(text, template, need):
                    found.setdefault(row, []).append((len(pairs) / len(template), len(template), -(a + pairs[0][0] - begin), a + pairs[-1][0] + 1 - begin, k))
        for row, matches in found.items():
            found[row] = []
            for x in sorted(matches, reverse=True):
                if all(x[3] <= -y[2] or y[3] <= -x[2] for y in found[row]):
                    found[row].append(x)
        best = [max(found[r]) if r in found else None for r in range(batch.num_rows)]
        return {"doc_id": batch.column("doc_id"), "license": [own.names[x[4]] if x else None for x in best], "coverage": [x[0] if x else 0.0 for x in best],
                "first_word": [-x[2] if x else None for x in best], "end_word": [x[3] if x else None for x in best],
                "n_notices": [len(found.get(r, ())) for r in range(batch.num_rows)],
                "licenses": [sorted({own.names[x[4]] for x in found.get(r, ())}) for r in range(batch.num_rows)]}

    return map_text(docs.select("doc_id", "text"), run,
                    "doc_id long, license string, coverage double, first_word long, end_word long, n_notices long, licenses array<string>")


@query("op4_patience_licenses")
def op4(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
