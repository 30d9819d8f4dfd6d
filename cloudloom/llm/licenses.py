"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mix64, stable_hash, text_bytes
from .decontamination import _NORMAL, _characters, words_of

#: Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
GRAM, WINDOW = 3, 4
#: Templates of fewer words are found by all their grams: winnowing may keep none of a piece of up to five words at an end.
SHORT = 30


class Fingerprinter:
    """Hashes of the 3-word grams of a text, and the places of those that winnowing keeps."""

    def __init__(self):
        self.memo = Memo(stable_hash)

    def grams(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - GRAM + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        return mix64(h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))

    @staticmethod
    def winnow(grams: np.ndarray) -> np.ndarray:
        """In each window the place of the least gram, the last such; a text of fewer grams keeps all."""
        if len(grams) < WINDOW:
            return np.arange(len(grams))
        view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
        return np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))


def align(template: list[bytes], words: list[bytes], diagonal: int, band: int) -> tuple[int, int, int]:
    """The longest common subsequence of the template and the words near the diagonal: matches, first and last place.

    Cell (i, k) compares template word i with word i + diagonal + k - band.
    """
    width = 2 * band + 1
    score = [(0, 0, -1, -1)] * width  # matches, minus the gaps inside, first, last
    for i, t in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for k in range(width):
            j = i + diagonal + k - band
            best = score[k]  # word j - 1 with template word i - 1
            if 0 <= j < len(words) and words[j] == t:
                best = (best[0] + 1, best[1] - (j - best[3] - 1 if best[3] >= 0 else 0), best[2] if best[2] >= 0 else j, j)
            if k + 1 < width and score[k + 1][:2] > best[:2]:  # the template word stays unmatched
                best = score[k + 1]
            if k and new[k - 1][:2] > best[:2]:  # the text's word stays unmatched
                best = new[k - 1]
            new.append(best)
        score = new
    matches, _, first, last = max(score, key=lambda s: s[:2])
    return matches, first, last


def _chained(anchors: list[tuple[int, int]], length: int, drift: int) -> list[tuple[int, int]]:
    """Ranges (lowest, highest) of diagonals, one for each occurrence, from anchors (text place, template place) in text order.

    An anchor's best chain is the longest of anchors that rise in the text and in the template and whose diagonals differ by no
    more than ``drift``; of equally long ones the one with the least drift. The longest chain is an occurrence, the anchors within
    its stretch of the text go, and so on: a stray anchor of a repeated phrase neither moves nor ends an occurrence.
    """
    t, p = np.array(anchors, np.int64).T
    d = t - p
    n = len(t)
    count, low, high, back = np.ones(n, np.int64), d.copy(), d.copy(), np.full(n, -1)
    since = np.searchsorted(t, t - length - drift)  # a chain's stretch of the text is no longer
    for i in range(1, n):
        s = slice(since[i], i)
        spread = np.maximum(high[s], d[i]) - np.minimum(low[s], d[i])
        worth = np.where((t[s] < t[i]) & (p[s] < p[i]) & (spread <= drift), count[s] * (drift + 1) - spread, -1)
        if len(worth) and worth.max() >= 0:
            j = since[i] + len(worth) - 1 - int(worth[::-1].argmax())  # the nearest of equals
            count[i], back[i], low[i], high[i] = count[j] + 1, j, min(low[j], d[i]), max(high[j], d[i])
    taken, found = np.zeros(n, bool), []
    for i in np.lexsort((t, high - low, -count)).tolist():
        if taken[i]:
            continue
        own, j = [i], int(back[i])
        while j >= 0 and not taken[j]:
            own.append(j)
            j = int(back[j])
        taken |= (t >= t[own[-1]]) & (t <= t[i])
        found.append((int(t[own[-1]]), int(d[own].min()), int(d[own].max())))
    return [(lo, hi) for _, lo, hi in sorted(found)]


class Scanner:
    def __init__(self, templates: dict[str, str], band: int, coverage: float):
        self.band, self.coverage, self.finger = band, coverage, Fingerprinter()
        self.words = {n: words_of(t.encode()) for n, t in templates.items()}
        self.long: dict[int, list] = defaultdict(list)  # of winnowed grams
        self.short: dict[int, list] = defaultdict(list)  # templates too short for winnowing have all their grams here
        for name, words in sorted(self.words.items()):
            grams = self.finger.grams(words)
            short = len(words) < SHORT
            for p in range(len(grams)) if short else self.finger.winnow(grams).tolist():
                (self.short if short else self.long)[int(grams[p])].append((name, p))
        self.keys = {kind: np.array(sorted(own), np.uint64) for kind, own in (("long", self.long), ("short", self.short))}

    def _hits(self, grams: np.ndarray, places: np.ndarray, kind: str):
        keys, own = self.keys[kind], getattr(self, kind)
        if not len(keys) or not len(places):
            return
        g = grams[places]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        for k in np.flatnonzero(keys[at] == g).tolist():
            for name, p in own[int(g[k])]:
                yield name, p, int(places[k])

    def __call__(self, raw: bytes) -> list[tuple[str, int, float, int, int]]:
        """(template, words matched, coverage, start, end in characters) of each occurrence, by place."""
        words = words_of(raw)
        grams = self.finger.grams(words)
        anchors: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for kind, places in (("short", np.arange(len(grams))), ("long", self.finger.winnow(grams))):
            for name, p, t in self._hits(grams, places, kind):
                anchors[name].add((t, p))
        found = []
        for name, own in anchors.items():
            template, last_end = self.words[name], -1
            band = min(self.band, max(1, len(template) // 4))  # so that short templates close together stay apart
            bag = Counter(template)
            for low, high in _chained(sorted(own), len(template), max(2 * band, len(template) // 2)):
                # words in common bound the alignment from above
                window = words[max(0, low - band) : high + len(template) + band]
                if sum((bag & Counter(window)).values()) < self.coverage * len(template):
                    continue
                middle = (low + high) // 2
                matches, first, last = align(template, words, middle, band + max(high - middle, middle - low))
                if matches >= self.coverage * len(template) and first > last_end:
                    found.append((name, matches, matches / len(template), first, last))
                    last_end = last
        if not found:
            return []
        normal = np.frombuffer(raw.translate(_NORMAL), np.uint8)
        edge = np.diff(np.concatenate([[1], np.isin(normal, (32, 9, 10, 11, 12, 13)).astype(np.int8), [1]]))
        starts, ends = _characters(raw, np.flatnonzero(edge == -1)), _characters(raw, np.flatnonzero(edge == 1))
        return sorted(((n, m, c, int(starts[a]), int(ends[z])) for n, m, c, a, z in found), key=lambda r: (r[3], r[0]))


_MATCH = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = 6, coverage: float = 0.8) -> DataFrame:
    """doc_id and matches (template, matched words, coverage, start, end) of every whole text.

    A match needs ``coverage`` of the template's words in order, within ``band`` words (a quarter of a short template) of the
    diagonals that shared fingerprints set; the longest chains of fingerprints, by dynamic programming, reach over words put in or
    left out at any places, up to half the template's length in all. Occurrences of one template don't overlap: of those that would, the first in the text stays, and of equal
    alignments the one with fewer gaps. Whole texts are scanned, however long; a text that repeats a template's phrase is aligned
    there once for each repetition whose words could cover enough. Null and empty texts match nothing; repeated rows and null ids
    are scanned like others; columns besides doc_id and text are not read. Templates of fewer than three words never match.
    The templates travel with the tasks, so they should stay within a few MB.
    """
    used = TEMPLATES if templates is None else templates
    if sum(map(len, used.values())) > 16_000_000:
        raise ValueError("more than 16 MB of templates: scan for them in several calls")

    def run(batches):
        scanner = Scanner(used, band, coverage)
        for b in batches:
            rows = [[dict(zip(("template", "matched", "coverage", "start", "end"), m)) for m in scanner(r)] for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _MATCH)], ["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes()).mapInArrow(
        run, "doc_id bigint, matches array<struct<template:string,matched:bigint,coverage:double,start:bigint,end:bigint>>"
    )
