"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

Texts are words without marks at their edges, in lower case; shingles are five words (shorter templates are
one shingle of all their words). For a template of t shingles, windows of W = 2^l >= 2t shingles overlap by
half, so any t neighbouring shingles lie within some window. A window that holds the share c of the
template has similarity J >= c t / (W + (1 - c) t) > 0.19 at c = 0.8 and W < 4t; with BANDS bands of one row
the two share a band with probability 1 - (1 - J)^BANDS > 0.99995.

Every window of every text has its least shingle hash in each band looked up in an index (window length, band,
value) -> templates, made once. The least hashes of half windows come from those of their halves, so all window
lengths together cost two look-ups a shingle and band. Retrieved pairs are verified by exact containment of the
template's shingles in the window.

The templates are a fixed table (a parameter), sent to the tasks whole; the index grows with them, the work of
a window does not.

Edge cases: null, empty or short texts have no findings; texts are read whole, whatever their length; equal
findings in overlapping windows are merged into one span; without templates (an empty table) there are no
findings; rows that repeat give their findings each; rows without a doc_id stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import BASE, BASE_INV, BYTE, COEF, SPACE, U, _power, bytes_of, chunks, mix

WORDS, BANDS, CONTAINED = 5, 48, 0.8

# Names and texts of public license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT licensed notice": "Licensed under the MIT License",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}

#: Bytes of words: letters, digits and anything beyond ASCII.
SOLID = np.zeros(256, bool)
SOLID[48:58] = SOLID[65:91] = SOLID[97:123] = True
SOLID[128:] = True
SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def bare_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, row) of the words of a chunk of rows, without the marks at their edges."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    ink = ~SPACE[data]
    head, tail = ink.copy(), ink.copy()
    head[1:] &= ~ink[:-1] | cut[1:n]
    tail[:-1] &= ~ink[1:] | cut[1:n]
    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
    solid = SOLID[data]
    places, upto = np.flatnonzero(solid), np.zeros(n + 1, np.int64)
    np.cumsum(solid, out=upto[1:])
    has = upto[b] > upto[a]
    a, b = a[has], b[has]
    a, b = places[upto[a]], places[upto[b] - 1] + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _power("up", BASE, n)[:n], out=run[1:])
    h = mix((run[b] - run[a]) * _power("down", BASE_INV, n)[a] + (b - a).astype(np.uint64))
    return h, a, b, np.searchsorted(off, a, "right") - 1


def word_shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, for as many as there are; rows are not minded."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    s = h[: len(h) - k + 1] * COEF[0]
    for j in range(1, k):
        s = s + h[j : len(h) - k + 1 + j] * COEF[j]
    return mix(s + U(k))


def window_of(shingles: int) -> int:
    """The window's length for a template of so many shingles: a power of two, twice as many at least."""
    return 2 << int(np.ceil(np.log2(shingles)))


@dataclass
class Templates:
    """Templates with their shingles, and the index from (window length, band, least hash) to those that have it, by number of words in a shingle."""

    texts: dict[str, str]
    names: list[str] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.index: dict[int, dict[int, list[dict[int, list[int]]]]] = {}
        for name, text in self.texts.items():
            data = np.frombuffer(text.encode(), np.uint8)
            h = bare_words(data, np.array([0, len(data)]))[0]
            if not len(h):
                continue
            k = min(WORDS, len(h))
            s = np.unique(word_shingles(h, k))
            bands = self.index.setdefault(k, {}).setdefault(window_of(len(h) - k + 1), [{} for _ in range(BANDS)])
            for band, least in zip(bands, mix(s[None, :] ^ SEEDS[:, None]).min(axis=1).tolist(), strict=True):
                band.setdefault(least, []).append(len(self.names))
            self.names.append(name)
            self.sets.append(s)
        # which low bits any indexed value of a window length and band has: most look-ups end here
        self.mask = {}
        for k, lengths in self.index.items():
            for w, bands in lengths.items():
                for j, band in enumerate(bands):
                    self.mask[k, w, j] = np.zeros(1 << 16, bool)
                    self.mask[k, w, j][[v & 0xFFFF for v in band]] = True

    def retrieved(self, s: np.ndarray, first: np.ndarray, last: np.ndarray, k: int) -> set[tuple[int, int, int]]:
        """(first shingle, end, template) of the windows that share a band with a template.

        ``s``: the k-word shingles; ``first``, ``last``: where those of each row begin and end.
        """
        found: set[tuple[int, int, int]] = set()
        some = last > first
        first, last = first[some], last[some]
        if not len(first):
            return found
        inside = np.concatenate([s[f:e] for f, e in zip(first.tolist(), last.tolist(), strict=True)]) if len(first) > 1 or first[0] or last[0] < len(s) else s
        size = last - first
        longest = max(self.index[k])
        # blocks of half a window from each row's first shingle on, by half length: (rows' first blocks, starts in the finer blocks)
        plan, count, half = [], size, 1
        while half <= longest // 2:
            begin = np.concatenate(([0], np.cumsum(count)))
            plan.append((half, begin, count))
            count = (count + 1) // 2
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            plan[-1] += (np.repeat(begin[:-1], count) + 2 * step,)
            half *= 2
        for j in range(BANDS):
            block = mix(inside ^ SEEDS[j])
            for half, begin, count, pairs in plan:
                w = 2 * half
                if w in self.index[k]:
                    ahead = np.minimum(block, np.r_[block[1:], block[-1:]])
                    ends = begin[1:] - 1
                    ahead[ends] = block[ends]  # a row's last block has none after it
                    near = np.flatnonzero(self.mask[k, w, j][(ahead & U(0xFFFF)).astype(np.int64)])
                    table = self.index[k][w][j]
                    for x, v in zip(near.tolist(), ahead[near].tolist(), strict=True):
                        for t in table.get(v, ()):
                            r = int(np.searchsorted(begin, x, "right")) - 1
                            lo = int(first[r]) + (x - int(begin[r])) * half
                            found.add((lo, min(lo + w, int(last[r])), t))
                block = np.minimum.reduceat(block, pairs)
        return found

    def findings(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(row, template, containment, start byte, end byte) in a chunk of rows, overlapping ones merged."""
        h, a, b, row = bare_words(data, off)
        rows = np.arange(len(off) - 1)
        first, end = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
        out = []
        for k in self.index:
            s = word_shingles(h, k)
            for lo, hi, t in self.retrieved(s, first, np.maximum(first, end - k + 1), k):
                own = s[lo:hi]
                inside = np.isin(own, self.sets[t])
                c = len(np.unique(own[inside])) / len(self.sets[t])
                if c >= CONTAINED:
                    at = np.flatnonzero(inside)
                    out.append((int(row[lo]), t, c, int(a[lo + at[0]]), int(b[lo + at[-1] + k - 1])))
        out.sort(key=lambda x: (x[0], x[1], x[3], -x[2]))
        merged: list[list] = []
        for x in out:
            if merged and merged[-1][:2] == list(x[:2]) and x[3] < merged[-1][4]:
                merged[-1][2], merged[-1][4] = max(merged[-1][2], x[2]), max(merged[-1][4], x[4])
            else:
                merged.append(list(x))
        return [(r, self.names[i], c, s - int(off[r]), e - int(off[r])) for r, i, c, s, e in merged]


def license_findings(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, start, end): spans (byte offsets in UTF-8) of ``docs`` (doc_id, text) that hold a template."""
    known = Templates(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytes_of(batch.column(1))
            ids = batch.column(0)
            rows = []
            for a, b in chunks(off):
                rows += [(a + r, *x) for r, *x in known.findings(data[off[a] : off[b]], off[a : b + 1] - off[a])]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "license", "containment", "start", "end"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, license string, containment double, start long, end long")
