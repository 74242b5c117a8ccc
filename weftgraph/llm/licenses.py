"""License notices in documents, by MinHash bands over overlapping windows.

Templates are sorted by their number of word shingles into classes; for each class a text is cut into windows that
overlap, so that a notice of the class lies within one wherever it starts. A window's signature holds the
minimum of each of BANDS hash functions over its shingles; each minimum is a band of its own. A window that has
four fifths of a template's shingles has Jaccard similarity at least 1/4 with it, in every class, so they meet in some band with
probability at least 1 - (3/4)^32 = 0.9999. The retrieved pairs are verified by exact containment of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat, slices
from .tables import texts
from .words import PLAIN, SHINGLE, Shingled

#: Share of a template's shingles that a notice has; hash functions; words of a cell, the unit of windows.
CONTAINED, BANDS, CELL = 0.8, 32, 4
_FUNCTIONS = np.random.default_rng(23).integers(1, 1 << 62, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are scanned at once.
BLOCK = 2 << 20

#: The wording of public license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
    "License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _minima(shingle: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """BANDS x cells: the least value of each function over the shingles from each cut to the next."""
    out = np.empty((BANDS, len(cuts)), np.uint32)
    none = shingle == 0
    for k in range(BANDS):
        h = ((shingle * _FUNCTIONS[k]) >> np.uint64(32)).astype(np.uint32)
        h[none] = 0xFFFFFFFF
        out[k] = np.minimum.reduceat(h, cuts)
    return out


@dataclass
class Library:
    """Templates by window class, and the bands of each.

    A class is the most shingles that its templates have: one, or CELL and its doubles.
    """

    names: list[str]
    shingles: list[np.ndarray]  # distinct, in order
    places: list[np.ndarray]  # of every shingle in the template
    classes: dict[int, list[int]]
    bands: np.ndarray  # BANDS x template

    @staticmethod
    def of(templates: dict[str, str]) -> Library:
        names, shingles, places, classes = [], [], [], {}
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            words = Shingled.of(data, np.array([0, len(data)]))
            if len(words.start) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            inside = words.shingle[words.shingle > 0]
            size = 1 if len(inside) == 1 else CELL
            while size < len(inside):
                size *= 2
            classes.setdefault(size, []).append(len(names))
            names.append(name)
            shingles.append(np.unique(inside))
            places.append(inside)
        bands = np.stack([_minima(s, np.array([0]))[:, 0] for s in shingles], axis=1)
        return Library(names, shingles, places, classes, bands)

    @staticmethod
    def window(size: int) -> tuple[int, int]:
        """(step, width) in cells of the windows of a class: the shortest that hold a notice of the class wherever it starts."""
        if size == 1:
            return 1, 1
        step = max(1, size // 2 // CELL)
        return step, (size - 1) // CELL + 1 + step

    def reach(self) -> int:
        """Words of the longest window."""
        return CELL * max(self.window(s)[1] for s in self.classes) + SHINGLE


def hits(library: Library, words: Shingled) -> Iterator[tuple[int, int, int, int]]:
    """(template, row, first word, end word) of the windows that meet a template in some band."""
    count = np.diff(words.borders)
    cells = -(-count // CELL)
    base = np.cumsum(cells) - cells  # first cell of each row
    row = np.repeat(np.arange(len(count)), cells)
    cuts = words.borders[:-1][row] + CELL * (np.arange(len(row)) - base[row])
    least = _minima(words.shingle, cuts)
    last = (base + cells)[row]
    for size, members in sorted(library.classes.items()):
        step, wide = library.window(size)
        begin = np.flatnonzero((np.arange(len(row)) - base[row]) % step == 0)
        hit = np.zeros((len(members), len(begin)), bool)
        for k in range(BANDS):
            window = least[k][begin].copy()
            for j in range(1, wide):
                at = begin + j
                inside = at < last[begin]
                window = np.where(inside, np.minimum(window, least[k][np.minimum(at, len(row) - 1)]), window)
            for i, t in enumerate(members):
                hit[i] |= window == library.bands[k, t]
        for i, t in enumerate(members):
            for w in np.flatnonzero(hit[i]).tolist():
                r, first = int(row[begin[w]]), int(cuts[begin[w]])
                yield t, r, first, min(first + wide * CELL, int(words.borders[r + 1]))


def notices(want: np.ndarray, order: np.ndarray, part: np.ndarray, contained: float) -> list[tuple[float, int, int]]:
    """(containment, first, end) of the notices in a stretch of shingles: runs in which the template goes on, each of which has enough of it.

    A place before the last one starts a new run. If no run has enough, though all together have, they are one.
    """
    at = np.flatnonzero(np.isin(part, want))
    places: dict[int, list[int]] = {}
    for k, x in enumerate(order.tolist()):
        places.setdefault(x, []).append(k)
    runs: list[list[int]] = []
    before = len(order)
    for i in at.tolist():
        later = [k for k in places[int(part[i])] if k > before]
        if not later:
            runs.append([])
        runs[-1].append(i)
        before = later[0] if later else places[int(part[i])][0]
    share = lambda run: len({int(part[i]) for i in run}) / len(want)
    found = [(share(run), run[0], run[-1] + 1) for run in runs if share(run) >= contained]
    if not found and share(at.tolist()) >= contained:
        found = [(share(at.tolist()), int(at[0]), int(at[-1]) + 1)]
    return found


def scan(library: Library, data: np.ndarray, borders: np.ndarray, contained: float = CONTAINED) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first byte, end byte) of every notice, bytes within the row."""
    return outermost(_long(library, data, contained) if len(borders) == 2 and len(data) > BLOCK else _block(library, data, borders, contained))


def _block(library: Library, data: np.ndarray, borders: np.ndarray, contained: float) -> list[tuple[int, int, float, int, int]]:
    words = Shingled.of(data, borders)
    if not len(words.start):
        return []
    stretches: dict[tuple[int, int], list[list[int]]] = {}
    for t, r, a, b in hits(library, words):
        part = words.shingle[a:b]
        if len(np.unique(part[np.isin(part, library.shingles[t])])) < contained * len(library.shingles[t]):
            continue
        held = stretches.setdefault((r, t), [])
        if held and a < held[-1][1]:  # windows that overlap
            held[-1][1] = max(b, held[-1][1])
        else:
            held.append([a, b])
    out = []
    for (r, t), held in stretches.items():
        for a, b in held:
            for share, first, end in notices(library.shingles[t], library.places[t], words.shingle[a:b], contained):
                stop = min(a + end - 1 + SHINGLE, int(words.borders[r + 1]))
                out.append((r, t, share, int(words.start[a + first]) - int(borders[r]), int(words.end[stop - 1]) - int(borders[r])))
    return out


def _long(library: Library, data: np.ndarray, contained: float) -> list[tuple[int, int, float, int, int]]:
    """Finds of one long text, block by block: each goes on into the next by the longest window, and of overlapping finds of a template the fuller stays."""
    parts, found, reach = list(slices(data, PLAIN, BLOCK // 2)), [], library.reach()
    for (a, b), (_, more) in zip(parts, [*parts[1:], parts[-1]], strict=True):
        ahead = Shingled.of(data[b:more], np.array([0, more - b])).end[: 2 * reach]
        end = b + (int(ahead[-1]) if len(ahead) else 0)
        found += [(0, t, share, first + a, stop + a) for _, t, share, first, stop in _block(library, data[a:end], np.array([0, end - a]), contained)]
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[1], x[3], -x[2])):
        if out and out[-1][1] == x[1] and x[3] < out[-1][4]:
            if x[2] > out[-1][2]:
                out[-1] = x
        else:
            out.append(x)
    return out


def outermost(found: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, int, int]]:
    """Without finds within a fuller find of another template, which they are the shadow of, as one version's notice is of another's."""
    gone, over = set(), []
    for x in sorted(found, key=lambda x: (x[0], x[3], -x[4])):
        over = [y for y in over if y[0] == x[0] and y[4] > x[3]]  # those that reach into x, no more than overlap at one place
        if any(y[4] >= x[4] and y[2] > x[2] for y in over):
            gone.add(x)
        over.append(x)
    return sorted(x for x in found if x not in gone)


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment, start, end (code points of the text): a row for each notice found.

    A notice holds at least `contained` of a template's distinct five-word shingles, letters folded,
    punctuation aside. Notices of one template that follow each other are a row each; a find within the span of another template's
    fuller find goes, else templates may share a span. Null and empty texts have none. Repeated rows repeat their finds. A very long text is
    scanned block by block. Other columns are not read. The templates travel with the tasks; they are the caller's fixed list.
    """
    library = Library.of(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, 1, BLOCK):
                data, borders = flat(b.column(1))
                found = scan(library, data, borders, contained)
                if found:
                    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
                    r = [x[0] for x in found]
                    at = [[int(points[borders[x[0]] + x[k]] - points[borders[x[0]]]) for x in found] for k in (3, 4)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(r)), pa.array([library.names[x[1]] for x in found]), pa.array([x[2] for x in found]), pa.array(at[0], pa.int64()), pa.array(at[1], pa.int64())],
                        ["doc_id", "license_id", "containment", "start", "end"],
                    )

    return texts(docs, F.col(id_col).cast("long").alias("doc_id"), text_col=text_col).mapInArrow(run, "doc_id long, license_id string, containment double, start long, end long")
