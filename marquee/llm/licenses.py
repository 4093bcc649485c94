"""License scans: winnowed template fingerprints, inverted index, banded alignment.

A match has at least ``LEAST_COVERAGE`` of a template's words, the others dropped
or changed anywhere, and foreign words in up to ``INSERTED`` more places. From that
follows how many words in a row any match of a template shares with it
(:func:`sure_run`). Templates are fingerprinted for that length: their ``GRAM``-word
hashes are winnowed, so that every sure run holds a fingerprint; where the sure run
is ``GRAM`` words or less, all grams of its length are fingerprints; and where it is
one word, as many of the longest words as a match can not all lack.

An inverted index maps fingerprints to templates and places, and every gram of a
document is looked up. Each diagonal with a hit is a candidate: a banded local
alignment of template and document words around it, twice as wide as a match may
drift, gives the matched words and the span. Words of a region that was found are
taken out before the next diagonals are aligned, so notices in a row count each.
Regions that match ``LEAST_COVERAGE`` of the template are reported; where spans
overlap, the one with more matched words stays.

Templates are a parameter of bounded size, so the index travels with the tasks.
Null and empty texts match nothing; repeated rows are reported each; texts of any
length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.lexer import Lexer, windows

GRAM, BAND, INSERTED = 3, 4, 3
LEAST_COVERAGE = 0.8
#: A match drifts over at most 2 * BAND + 1 diagonals, so it lies this near to each of its hits.
REACH = 2 * BAND

# Public license notices and texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "mit": "Released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights-reserved": "All rights reserved",
}


def sure_run(n: int, least: float) -> int:
    """Words in a row that any match of ``least`` of ``n`` template words shares with it."""
    needed = max(1, math.ceil(least * n))
    return math.ceil(needed / (n - needed + INSERTED + 1))


def fingerprints(words: np.ndarray, lengths: list[int], least: float) -> tuple[int, dict[int, list[int]]]:
    """Gram length, and the places of each fingerprint, of a template's words."""
    n = len(words)
    run = sure_run(n, least)
    k = min(GRAM, run)
    grams = windows(words, k).tolist()
    if run == 1:  # a match lacks at most n - needed words: one of so many and one more is there
        lacking = n - max(1, math.ceil(least * n))
        longest = sorted(set(words.tolist()), key=lambda w: (-max(x for x, v in zip(lengths, words.tolist()) if v == w), w))
        chosen, covered = set(), 0
        for w in longest:
            if covered <= lacking:
                chosen.add(w)
                covered += words.tolist().count(w)
        places = [p for p, w in enumerate(words.tolist()) if w in chosen]
    else:
        span = run - k + 1
        picked = {min(range(i, i + span), key=lambda p: (grams[p], -p)) for i in range(len(grams) - span + 1)}
        # an equal gram elsewhere in the template is a place of the same fingerprint
        known = {grams[p] for p in picked}
        places = [p for p, g in enumerate(grams) if g in known]
    out: dict[int, list[int]] = {}
    for p in places:
        out.setdefault(grams[p], []).append(p)
    return k, out


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int] | None:
    """Best local alignment with ``words`` at ``template`` places + ``shift``,
    at most ``band`` off: (matched words, first word, end). Match 2, else -1."""
    width = 2 * band + 1
    none = (0, 0, -1)  # score, matched, first word
    row, best = [none] * (width + 2), (0, 0, -1, -1)
    for i in range(len(template)):
        new = [none] * (width + 2)
        for d in range(width):
            j = i + shift + d - band
            if not 0 <= j < len(words):
                continue
            same = bool(template[i] == words[j])
            score, matched, first = row[d + 1]
            options = [(score + 2, matched + 1, first if score else j) if same else (score - 1, matched, first)]
            options += [(row[d + 2][0] - 1, *row[d + 2][1:]), (new[d][0] - 1, *new[d][1:])]
            top = max(options, key=lambda o: (o[0], o[1]))
            if top[0] > 0:
                new[d + 1] = top
                if (top[0], top[1]) > best[:2]:
                    best = (top[0], top[1], top[2], j + 1)
        row = new
    return (best[1], best[2], best[3]) if best[0] else None


class Index:
    """The inverted index of a set of templates' fingerprints."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.lexer, self.least = Lexer(), least
        self.names = list(templates)
        self.words = [self.lexer.read(t)[1] for t in templates.values()]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, (w, text) in enumerate(zip(self.words, templates.values())):
            if len(w):
                k, prints = fingerprints(w, [len(raw) for raw in self.lexer.read(text)[0]], least)
                for g, places in prints.items():
                    self.places.setdefault(k, {}).setdefault(g, []).extend((t, p) for p in places)
        self.keys = {k: np.array(sorted(of), dtype=np.uint64) for k, of in self.places.items()}

    def candidates(self, words: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """Per template the (diagonal, document place) of every gram that is one of its fingerprints."""
        out: dict[int, set[tuple[int, int]]] = {}
        for k, keys in self.keys.items():
            grams = windows(words, k)
            if not len(grams):
                continue
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for j in np.flatnonzero(keys[place] == grams).tolist():
                for t, p in self.places[k][int(grams[j])]:
                    out.setdefault(t, set()).add((j - p, j))
        return out

    def regions(self, t: int, hits: set[tuple[int, int]], words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(matched words, template, first word, end) of a template's matches."""
        template, found = self.words[t], []
        known, needed = template.tolist(), self.least * len(template)
        left, tried = words.copy(), set()
        for shift, j in sorted(hits):
            if shift in tried or not left[j]:
                continue
            tried.add(shift)
            near = set(left[max(0, shift - REACH):shift + len(known) + REACH].tolist())
            if sum(w in near for w in known) < needed:
                continue
            hit = align(template, left, shift, REACH)
            if hit and hit[0] >= needed:
                found.append((hit[0], t, hit[1], hit[2]))
                left[hit[1]:hit[2]] = 0
        return found

    def scan(self, text: str | None) -> list[dict]:
        raw, words, *_ = self.lexer.read(text or "")
        found = [r for t, hits in self.candidates(words).items() for r in self.regions(t, hits, words)]
        kept: list[tuple[int, int, int, int]] = []
        for matched, t, a, b in sorted(found, key=lambda f: (-f[0] , -f[0] / len(self.words[f[1]]), f[1], f[2])):
            if all(b <= x[2] or a >= x[3] for x in kept):
                kept.append((matched, t, a, b))
        if not kept:
            return []
        spans = _places(text, raw)
        return [{"license": self.names[t], "coverage": round(matched / len(self.words[t]), 6), "matched_words": matched,
                 "start": spans[a][0], "end": spans[b - 1][1]} for matched, t, a, b in sorted(kept, key=lambda x: x[2])]


def _places(text: str, raw: list[str]) -> list[tuple[int, int]]:
    """Where each of the kept words stands in the text (code points)."""
    out, at = [], 0
    for w in raw:
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, coverage, matched_words, start, end."""
    fields = {"license": pa.string(), "coverage": pa.float64(), "matched_words": pa.int32(), "start": pa.int32(), "end": pa.int32()}

    def run(batches):
        index = Index(templates, least)
        for batch in batches:
            rows = [(i, m) for i, text in enumerate(batch.column("text").to_pylist()) for m in index.scan(text)]
            if rows:
                ids = batch.column("doc_id").take(pa.array([i for i, _ in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array([m[f] for _, m in rows], kind) for f, kind in fields.items()]], names=["doc_id", *fields])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, matched_words int, start int, end int")
