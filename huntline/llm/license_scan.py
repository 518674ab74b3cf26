"""License notices in texts, by conditional compression.

A stretch of words that come from the vocabulary of the templates, with one of
their rare words (`marks`), is a candidate block. It is compressed alone and
with each template as a raw zstandard dictionary: the template that makes it
smallest in proportion is the likeliest. Templates are tried in that order, and
one is confirmed by aligning the words around the longest run they share: most
of its words must be there, none with a digit may be missing (versions matter),
and what differs is told. Where that fails, the parts beside the run are tried. The
rest of the block is scanned again, so neighbouring notices are all found.

The filter on the rare words runs in the scan; only texts that pass it reach
Python.

Defined results: null, empty and blank texts have no notice; repeated rows and
rows with a null key are scanned like any other; a notice at the edge of a very
long text is found like one in a short text; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces

# Wordings of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0",
    "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0",
)
# Wordings too short to be reworded: all words, nothing between them.
TAGS = (
    *[(name, f"SPDX-License-Identifier: {name}") for name in SPDX],
    *[(name, name) for name in SPDX if name.startswith("CC")],
    ("ISC", "under the ISC License"), ("Unlicense", "under the Unlicense"),
    ("Public-Domain", "released into the public domain"), ("Public-Domain", "dedicated to the public domain"), ("Public-Domain", "is in the public domain"),
)
RESERVED = (("All-Rights-Reserved", "All rights reserved."),)
TELLING = frozenset("lesser affero nc nd sa".split())  # words that make it another license: neither missing nor added
NAMES = frozenset("apache bsd eclipse gnu isc mit mozilla unencumbered".split())  # never missing
SHARE = 0.8
GAP = 2
WORD = re.compile(r"[^\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+")  # letters, digits, full stops, characters beyond ASCII

RESULT = "key long, license string, begin int, end int, plain_size int, conditional_size int, reduction double, share double, missing array<string>, added array<string>"


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, begin, end) with A-Z lowered and full stops at the ends cut off."""
    out = []
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if not text.isascii() else text.lower()
    for m in WORD.finditer(lowered):
        word = m[0].strip(".")
        if word:
            begin = m.start() + (len(m[0]) - len(m[0].lstrip(".")))
            out.append((word, begin, begin + len(word)))
    return out


def marks(templates: tuple[tuple[str, str], ...] = TEMPLATES, tags: tuple[tuple[str, str], ...] = TAGS, share: float = SHARE) -> set[str]:
    """Words of the templates of which every notice has one: of each template the longest words, one more than may be missing."""
    out: set[str] = set()
    for wording, lost in [*[(t, 1 - share) for _, t in templates], *[(t, 0) for _, t in tags]]:
        ws = {w for w, _, _ in tokens(wording)}
        need = int(lost * len(tokens(wording)) + 1e-9) + 1
        out |= set(sorted(ws, key=lambda w: (-len(w), w))[:need])
    return out


def speaks(words: set[str]) -> str:
    return r"(?i)(?<![a-z0-9])(" + "|".join(re.escape(w) for w in sorted(words)) + r")(?![a-z0-9])"


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, tags: tuple[tuple[str, str], ...] = TAGS, share: float = SHARE, gap: int = GAP):
        self.share, self.gap, self.marks = share, gap, marks(templates, tags, share)
        self.plain = zstandard.ZstdCompressor(level=19)
        self.templates = []
        for name, text in templates:
            raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, [w for w, _, _ in tokens(text)], zstandard.ZstdCompressor(level=19, dict_data=raw)))
        self.tags = sorted(((name, [w for w, _, _ in tokens(text)], text.lower().encode()) for name, text in tags), key=lambda t: -len(t[1]))
        self.vocabulary = {w for _, ws, _ in [*self.templates, *self.tags] for w in ws}

    def blocks(self, words: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
        """Stretches of words from the vocabulary, at most `gap` others between two of them, that speak of licensing."""
        known = [i for i, (w, _, _) in enumerate(words) if w in self.vocabulary]
        begin = 0
        for at in range(1, len(known) + 1):
            if at == len(known) or known[at] - known[at - 1] > self.gap + 1:
                a, b = known[begin], known[at - 1] + 1
                if any(w in self.marks for w, _, _ in words[a:b]):
                    yield a, b
                begin = at

    def scan(self, text: str) -> Iterator[tuple]:
        words = tokens(text)
        todo = list(self.blocks(words))
        while todo:
            a, b = todo.pop()
            found = self.best(words[a:b], text)
            if found:
                x, y, row = found
                yield row
                todo += [(p, q) for p, q in ((a, a + x), (a + y, b)) if q - p > 1 and any(w in self.marks for w, _, _ in words[p:q])]

    def best(self, words: list[tuple[str, int, int]], text: str) -> tuple[int, int, tuple] | None:
        """The first template, by how much it helps to compress the block, whose wording is there."""
        block = text[words[0][1] : words[-1][2]].lower().encode()
        plain = len(self.plain.compress(block))
        ranked = sorted((len(c.compress(block)), -len(ws), name, ws) for name, ws, c in self.templates)
        mine = [w for w, _, _ in words]
        for size, _, name, ws in ranked:
            found = self.align(ws, mine)
            if found:
                x, y, same, missing, added = found
                return x, y, (name, words[x][1], words[y - 1][2], plain, size, 1 - size / plain, same / len(ws), missing, added)
        for name, ws, text_ in self.tags:
            x = next((i for i in range(len(mine) - len(ws) + 1) if mine[i : i + len(ws)] == ws), None)
            if x is not None:
                raw = zstandard.ZstdCompressionDict(text_, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = len(zstandard.ZstdCompressor(level=19, dict_data=raw).compress(block))
                y = x + len(ws)
                return x, y, (name, words[x][1], words[y - 1][2], plain, size, 1 - size / plain, 1.0, [], [])
        return None

    def align(self, ws: list[str], mine: list[str]) -> tuple[int, int, int, list[str], list[str]] | None:
        """Where the template is in a block: around the longest matching run, or else around one before or after it."""
        lost, more = (1 - self.share) * len(ws), (1 - self.share) * len(ws) + self.gap
        least = (len(ws) - lost) / (lost + more + 1)  # so few missing and added words leave a run of this length
        whole, todo = SequenceMatcher(None, ws, mine, autojunk=False), [(0, len(mine))]
        while todo:
            lo, hi = todo.pop()
            m = whole.find_longest_match(0, len(ws), lo, hi)
            if m.size < max(1, least):
                continue
            begin = m.b - m.a - int(more)
            found = self.tight(ws, mine, max(0, begin), min(len(mine), begin + len(ws) + 2 * int(more)))
            _, _, same, missing, added = found
            if same >= self.share * len(ws) and len(added) <= more and not self.another(missing, added):
                return found
            todo += [(m.b + m.size, hi), (lo, m.b)]
        return None

    @staticmethod
    def another(missing: list[str], added: list[str]) -> bool:
        """Whether what differs makes it another license or version."""
        return any(w in TELLING or w in NAMES or any(c.isdigit() for c in w) for w in missing) or any(w in TELLING for w in added)

    @staticmethod
    def tight(ws: list[str], mine: list[str], x: int, y: int) -> tuple[int, int, int, list[str], list[str]]:
        """The alignment within mine[x:y], its ends moved inwards while that drops more added words than it loses."""

        def within(x: int, y: int) -> tuple[int, int, int, list[str], list[str]]:
            match = [m for m in SequenceMatcher(None, ws, mine[x:y], autojunk=False).get_matching_blocks() if m.size]
            if not match:
                return x, x, 0, ws, []
            here = {i for m in match for i in range(m.a, m.a + m.size)}
            there = {x + i for m in match for i in range(m.b, m.b + m.size)}
            begin, end = min(there), max(there) + 1
            return begin, end, len(here), [w for i, w in enumerate(ws) if i not in here], [mine[i] for i in range(begin, end) if i not in there]

        worth = lambda r: r[2] - len(r[4])
        best = within(x, y)
        while best[2]:
            inner = max(within(best[0] + 1, best[1]), within(best[0], best[1] - 1), key=worth)
            if worth(inner) <= worth(best):
                break
            best = inner
        return best


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...], tags: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, tags)
    types = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["key", "license", "begin", "end", "plain_size", "conditional_size", "reduction", "share", "missing", "added"]
    for batch in pieces(batches, "text"):
        rows = [(k, *hit) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in scanner.scan(t)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, tags: tuple[tuple[str, str], ...] = TAGS) -> DataFrame:
    """One row per notice: license, characters [begin, end), sizes, share of the template found, words missing and added."""
    some = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(speaks(marks(templates, tags))))
    return some.mapInArrow(lambda b: _scan(b, templates, tags), RESULT).withColumnRenamed("key", key)
