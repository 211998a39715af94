"""License scans by patience alignment.

Text and template are compared as words (lowered, without punctuation at the ends). Words that occur once in
both are anchors; the longest increasing subsequence of their places is kept, and the gaps between
anchors are aligned in the same way. Coverage is the share of the template's words that are aligned.

A finding covers LEAST of a template, aligns all its deciding words (name, clause, version), spans at most DENSE times
the template's words, and has no deciding word of another template among the words put in between; so `BSD License` is
not `MIT License`, and the Lesser license not the General one.

A notice that covers LEAST of a template holds at least one of any floor((1 - LEAST) * n) + 1 of its words, so
a text without any of the longest that many words is passed over unread; nothing is lost by that. In other
texts, each place of one of these words gives a window in which the template could lie, and windows are
aligned on their own, so a notice that stands twice, or far into a very long text, is found at both
places; where such a window finds nothing, one of DENSE times the words on both sides follows, for notices with words put in.

Defined results: null and empty texts hold no notice; of overlapping findings the one of the highest
coverage stays (then the longest, the first, the first name); rows that repeat are all scanned; other columns are ignored."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, DENSE = 0.8, 2
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License"
#: Notices by which texts state their license.
NOTICES = {
    "AGPL-3.0": "This program is free software: " + _GNU.format("Affero General Public", "3"),
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-short": "Released under the Apache License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-short": "Released under the BSD License",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-long": "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-long": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": "This program is free software; " + _GNU.format("General Public", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: " + _GNU.format("General Public", "3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": "This library is free software: " + _GNU.format("Lesser General Public", "3"),
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Words that tell these notices apart.
DECIDING = (
    "1.1 2 2.0 2.1 3 4.0 affero apache attribution attribution-noncommercial attribution-sharealike bsd by by-nc by-nd by-sa cc creative fee general gnu lesser "
    "mit mozilla permission redistribution unencumbered"
).split()
_ENDS = ".,;:!?\"'()[]{}<>*#&%$|"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_ENDS) for x in text.lower().split()) if w]


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles)."""
    tops, pile, back = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(pile[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[k], pile[k] = p, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in text, in template) of aligned words."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = Counter(text[a:b])
        here = Counter(template[c:d])
        at = {w: i for i, w in enumerate(text[a:b], a) if once[w] == 1}
        anchors = [(at[w], i) for i, w in enumerate(template[c:d], c) if here[w] == 1 and w in at]
        chain = [anchors[i] for i in rising([p for p, _ in anchors])]
        if not chain:
            continue
        out += chain
        rims = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(rims, rims[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST, deciding: Iterable[str] = ()):
        self.templates = {k: words_of(v) for k, v in templates.items()}
        self.least, self.deciding, self.keys = least, frozenset(deciding), {}
        for k, t in self.templates.items():
            order = sorted(range(len(t)), key=lambda i: (-len(t[i]), i))
            self.keys[k] = {t[i] for i in order[: int((1 - least) * len(t) + 1e-9) + 1]}

    def found(self, words: list[str], a: int, b: int, k: str) -> tuple | None:
        """(-coverage, -aligned words, first word, word after the last, template) in the window from a to b."""
        t, pairs = self.templates[k], aligned(words[max(0, a) : b], self.templates[k])
        if not pairs or len(pairs) < self.least * len(t) - 1e-9:
            return None
        first, last = max(0, a) + pairs[0][0], max(0, a) + pairs[-1][0] + 1
        if last - first > DENSE * len(t):
            return None
        places = {j for _, j in pairs}
        inside = {i for i, _ in pairs}
        if any(w in self.deciding and j not in places for j, w in enumerate(t)):
            return None
        between = {words[i] for i in range(first, last) if i - max(0, a) not in inside}
        if between & self.deciding - set(t):
            return None
        return -len(pairs) / len(t), -len(pairs), first, last, k

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, word after the last, aligned words) of each finding."""
        lowered = (text or "").lower()
        near = [k for k, keys in self.keys.items() if any(w in lowered for w in keys)]
        if not near:
            return []
        words, hits = words_of(text), []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        for k in near:
            t, keys = self.templates[k], self.keys[k]
            if len(at.keys() & set(t)) < self.least * len(set(t)) - (len(t) - len(set(t))) - 1e-9 or any(w in self.deciding and w not in at for w in t):
                continue  # too few of its words occur at all
            slack, places = max(2, len(t) // 4), {w: [j for j, x in enumerate(t) if x == w] for w in keys}
            spots = sorted(i for w in keys for i in at.get(w, ()))
            starts = sorted({i - j - slack for w in keys for i in at.get(w, ()) for j in places[w]})
            here = [h for s in starts if (h := self.found(words, s, s + len(t) + 2 * slack, k))]
            spans = sorted({h[2:4] for h in here})
            for i in spots:
                if not any(x <= i < y for x, y in spans[max(0, bisect_left(spans, (i - DENSE * len(t),))) : bisect_left(spans, (i + 1,))]):
                    here += filter(None, [self.found(words, i - DENSE * len(t), i + DENSE * len(t), k)])
            hits += here
        out = []
        for cover, n, a, b, k in sorted(hits):
            if all(b <= x[2] or a >= x[3] for x in out):
                out.append((k, -cover, a, b, -n))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, deciding: Iterable[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, start_word, end_word, aligned_words."""
    common.tune(docs.sparkSession)
    words = deciding if deciding is not None else DECIDING if templates is None else ()
    scanner = Scanner(NOTICES if templates is None else templates, least, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "start_word", "end_word", "aligned_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, license string, coverage double, start_word long, end_word long, aligned_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
