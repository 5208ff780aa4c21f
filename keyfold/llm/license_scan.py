"""License scan by patience alignment.

A text and a license template are aligned as word sequences: words that stand once in both are anchors, the longest
increasing run of anchors is kept, and the gaps between are aligned in the same way, after equal words at
their ends are matched. Coverage is the share of the template's words that are matched.

Only stretches that can reach the coverage asked for are aligned. If ``need`` of a template's n words must be
matched, one of any n - need + 1 of its words is; the longest, which are rare, are looked for, and around each
place of one the stretch of n words to either side is aligned if it holds enough of the template's words.
This leaves out no stretch that reaches the coverage. Documents are independent: there is no shuffle.

Defined results: null and empty texts have no findings; a document has a row for each license and place found (finds of one
license do not overlap; the leftmost is taken first); repeated rows give their findings each; null ids are
kept; an empty table gives an empty result; other columns are ignored. Words are runs of a-z and 0-9 after
lower-casing; offsets are code points of the lower-cased text's words in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame

WORD = re.compile(r"[A-Za-z0-9]+")

#: Notices and opening paragraphs of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _longest_run(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        pile = bisect_left(tops, place)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [place]
        top_at[pile : pile + 1] = [i]
    run, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word sequences, increasing in both."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        al, ah, bl, bh = gaps.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            pairs.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            pairs.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a, in_b = Counter(a[al:ah]), Counter(b[bl:bh])
        place = {w: j for j, w in enumerate(b[bl:bh], bl)}
        anchors = [(i, place[w]) for i, w in enumerate(a[al:ah], al) if in_a[w] == 1 and in_b[w] == 1]
        run = [anchors[i] for i in _longest_run([j for _, j in anchors])]
        if not run:
            continue
        pairs += run
        ends = [(al - 1, bl - 1), *run, (ah, bh)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, words_of(text)
        self.need = max(1, ceil(least * len(self.words) - 1e-9))
        rare = sorted(self.words, key=lambda w: (-len(w), w))
        self.marks = frozenset(rare[: len(self.words) - self.need + 1])
        self.counts = Counter(self.words)

    def find(self, words: list[str], places: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, words matched) of each find; places of marks are ascending."""
        n, after = len(self.words), 0
        for at in places:
            if at < after:
                continue
            low = max(after, at - n)
            stretch = words[low : at + n + 1]
            if sum((Counter(stretch) & self.counts).values()) < self.need:
                continue
            matched = align(stretch, self.words)
            if len(matched) >= self.need:
                after = low + matched[-1][0] + 1
                yield low + matched[0][0], after, len(matched)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.templates = [Template(name, text, least) for name, text in templates.items()]

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, begin, end, coverage) of each find, in the order of templates and places."""
        low = text.lower()
        chosen = [t for t in self.templates if any(m in low for m in t.marks)]
        if not chosen:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        at: dict[str, list[int]] = {}
        wanted = frozenset().union(*(t.marks for t in chosen))
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        out = []
        for t in chosen:
            places = sorted(i for m in t.marks for i in at.get(m, ()))
            out += [(t.name, spans[a][0], spans[b - 1][1], round(n / len(t.words), 4)) for a, b, n in t.find(words, places)]
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, span_begin, span_end, coverage) of each find with at least that coverage."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) if t for f in scanner(t)]
            yield pd.DataFrame(rows, columns=[id_col, "license", "span_begin", "span_end", "coverage"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, license string, span_begin long, span_end long, coverage double")
