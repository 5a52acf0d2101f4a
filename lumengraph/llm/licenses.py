"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Text and templates become runs of ASCII letters (in lower case), digits and characters beyond ASCII. A
span of a document matches a template if 2 * common / (span + template) bigrams, as multisets, is at
least ``threshold``. Spans are the windows of the template's own length, or the whole document where it
is shorter. Pruning loses nothing: a document with fewer than threshold / (2 - threshold) times the
template's bigrams can't match it (size bound), nor can a window with too few bigrams that the template
has at all. Of overlapping matches the best stays (Dice, then length, then place).

Defined results: null, empty and one-word texts match nothing; null doc_ids and repeated rows keep their
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_batches
from .textbytes import ALNUM, Words, buffers, ngrams, within

THRESHOLD = 0.8

# Public licence identifiers and the wording of their notices and texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Proprietary", "All rights reserved."),
]

# Every version of a family has the family's notices, so that the best Dice tells them apart.
for _name, _title, _versions in (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("1", "3"))):
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES += [(_id, f"This work is licensed under the {_title}, version {_v}."), (_id, f"Licensed under the {_title}, version {_v}.")]
        TEMPLATES += [(_id, f"is free software: you can redistribute it and/or modify it under the terms of the {_title} as published by the Free Software Foundation, {_which}") for _which in (f"either version {_v} of the License, or (at your option) any later version.", f"version {_v} of the License.")]
for _parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}[x] for x in _parts.split("-"))
    for _v, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES += [(f"CC-{_parts}-{_v}", f"Licensed under CC {_parts} {_v}."), (f"CC-{_parts}-{_v}", f"This work is licensed under a Creative Commons {_long} {_v} {_port} License.")]

_MAY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_NAME = "{} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
for _id, _clauses in (("BSD-2-Clause", ""), ("BSD-3-Clause", _NAME.format("3.")), ("BSD-4-Clause", _ADVERT + _NAME.format("4."))):
    TEMPLATES += [(_id, _MAY + _SOURCE + _BINARY + _clauses), (_id, _MAY + _SOURCE + _BINARY + _clauses + _AS_IS)]
#: Whole licences, as published.
TEMPLATES += [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def _common(grams: np.ndarray, starts: list[int], width: int, bag: Counter) -> Iterator[int]:
    """Bigrams that the window at each of the rising ``starts`` has in common with the bag; the window is moved, not counted anew."""
    held: Counter = Counter()
    common, lo, hi = 0, 0, 0
    for s in starts:
        if s >= hi:
            held.clear()
            common, lo, hi = 0, s, s
        for g in grams[lo:s].tolist():
            common -= held[g] <= bag.get(g, 0)
            held[g] -= 1
        for g in grams[hi : s + width].tolist():
            held[g] += 1
            common += held[g] <= bag.get(g, 0)
        lo, hi = s, s + width
        yield common


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names, self.bags, self.sizes = [], [], []
        for name, text in templates:
            w = Words(*buffers(pa.array([text], pa.large_string())), ALNUM)
            grams = ngrams(w.hashes(), 2).tolist()
            if grams:
                self.names.append(name)
                self.bags.append(Counter(grams))
                self.sizes.append(len(grams))
        self.known = np.array(sorted(set().union(*self.bags)) if self.bags else [], np.uint64)
        having = [[t for t, bag in enumerate(self.bags) if g in bag] for g in self.known.tolist()]
        #: the templates of each known bigram, in one run
        self.first = np.append(0, np.cumsum([len(h) for h in having])).astype(np.int64)
        self.having = np.array([t for h in having for t in h], np.int64)

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, str, int, int, float, str]]:
        """(document, licence, first word, end word, Dice, the span's text) of every match in a batch."""
        raw = None
        w = Words(*buffers(texts), ALNUM)
        h = w.hashes()
        grams = ngrams(h, 2)
        if not len(grams) or not len(self.known):
            return
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        places = np.flatnonzero((self.known[at] == grams) & within(w.first, len(h), 2))
        docs = np.searchsorted(w.first, places, "right") - 1
        cuts = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            d = int(docs[lo])
            first, n = int(w.first[d]), int(w.counts[d]) - 1
            for name, a, b, dice in self._document(grams[first : first + n], places[lo:hi] - first, at[places[lo:hi]]):
                raw = raw or {}
                if d not in raw:
                    raw[d] = texts[d].as_py().encode()
                o = int(w.off[d])
                yield d, name, a, b, dice, raw[d][w.start[first + a] - o : w.end[first + b - 1] - o].decode("utf-8", "replace")

    def _document(self, grams: np.ndarray, places: np.ndarray, which: np.ndarray) -> list[tuple[str, int, int, float]]:
        n = self.first[which + 1] - self.first[which]
        templates = self.having[np.repeat(self.first[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))]
        sizes = np.array(self.sizes)
        need = self.threshold * (np.minimum(sizes, len(grams)) + sizes) / 2
        enough = (np.bincount(templates, minlength=len(sizes)) >= need) & (len(grams) >= self.threshold / (2 - self.threshold) * sizes)
        found = []
        for t in np.flatnonzero(enough).tolist():
            size, bag = self.sizes[t], self.bags[t]
            width = min(size, len(grams))
            p = np.repeat(places, n)[templates == t]
            starts = np.unique(np.clip(np.concatenate([p, p - width + 1]), 0, len(grams) - width))
            inside = np.searchsorted(p, starts + width) - np.searchsorted(p, starts)
            starts = starts[inside >= need[t]].tolist()
            for s, common in zip(starts, _common(grams, starts, width, bag), strict=True):
                dice = 2 * common / (width + size)
                if dice >= self.threshold:
                    found.append((-dice, -width, s, t))
        # the best first; taken spans don't overlap, so only the neighbours of a place can be in its way
        starts: list[int] = []
        taken: dict[int, tuple[str, int, int, float]] = {}
        for dice, width, s, t in sorted(found):
            k = bisect.bisect_right(starts, s)
            if (k and taken[starts[k - 1]][2] > s) or (k < len(starts) and starts[k] <= s - width):
                continue
            starts.insert(k, s)
            taken[s] = (self.names[t], s, s - width + 1, -dice)
        return [taken[s] for s in starts]


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id and its matches (licence, first and end word, Dice, text)."""
    scanner = Scanner(templates or TEMPLATES, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("licence", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("dice", pa.float64()), ("text", pa.string())]))
        for b in text_batches(batches):
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for d, name, a, z, dice, text in scanner.scan(b.column(1)):
                out[d].append({"licence": name, "first_word": a, "end_word": z, "dice": dice, "text": text})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "matches"])

    return id_text(docs).mapInArrow(run, "doc_id long, matches array<struct<licence:string,first_word:long,end_word:long,dice:double,text:string>>")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, licences (different ones, sorted, comma-joined), best_dice (null if none)."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licences"), F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"))
