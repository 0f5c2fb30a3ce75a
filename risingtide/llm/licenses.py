"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies them.

Words are runs of letters and digits (and bytes beyond ASCII), A-Z in lower case; a
template and a text are their sequences of five-word shingles. A document carries a
template if some window of 1.25 times the template's shingles holds at least 75 in 100
of the template's distinct shingles.

Windows lie an eighth of a template apart and are as much longer, so one of them covers
such a place, and its Jaccard similarity with the template is at least 0.75 / 1.625 =
0.46. With 40 bands of 2 minhashes one band agrees with a probability above 0.9999. A
band can only agree in a window that holds the template's own minimal shingles, so
windows without any of them are skipped; this loses no collision. Every document and
template found is then verified on the whole text, at every place.

Templates are a list given by the caller and travel with the code, a few KB each.
Null and empty texts match nothing. Repeated rows give repeated matches; null ids stay
null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from risingtide.llm import words as W
from risingtide.llm.tables import Scratch

WIDTH = 5
PERCENT = 75
BANDS = 40
ROWS = 2

# Notices that name a license, and the openings of common license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
}

_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = False
for _first, _last in ("09", "AZ", "az"):
    _BREAK[ord(_first): ord(_last) + 1] = False

_MATCH = ("doc_id long, license string, n_template long, n_matched long, containment double, "
          "first_word long, last_word long")


def shingle_runs(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each text and the hashes of its shingles, in order, repeats and all."""
    data, offsets = W.buffers(texts)
    for first, last in W.chunks(offsets):
        part, at = data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        starts, stops, before = W.spans(part, at, _BREAK)
        found = W.span_hashes(part, starts, stops, fold=True)
        for i in range(last - first):
            yield first + i, W.shingles(found[before[i]: before[i + 1]], width)


class Template:
    def __init__(self, name: str, run: np.ndarray, factors: np.ndarray, shifts: np.ndarray):
        self.name, self.shingles = name, np.unique(run)
        n = len(run)
        self.length = n + -(-n // 4)
        self.step = max(1, n // 8)
        with np.errstate(over="ignore"):
            hashed = self.shingles[:, None] * factors + shifts
        self.mins = hashed.min(axis=0)
        self.minimal = np.unique(self.shingles[hashed.argmin(axis=0)])

    def windows_at(self, places: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows of a text of ``n`` shingles that hold one of ``places``."""
        long = self.length + self.step - 1
        low = np.maximum(0, -(-(places - long + 1) // self.step))
        high = places // self.step
        return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])) * self.step

    def retrieved(self, run: np.ndarray, places: np.ndarray, factors, shifts, rows: int) -> bool:
        """Whether a band of some window agrees with the template's."""
        long = self.length + self.step - 1
        for start in self.windows_at(places, len(run)):
            window = run[start: start + long]
            if len(window):
                with np.errstate(over="ignore"):
                    same = (window[:, None] * factors + shifts).min(axis=0) == self.mins
                if same.reshape(-1, rows).all(axis=1).any():
                    return True
        return False

    def best(self, run: np.ndarray) -> tuple[int, int, int]:
        """Most distinct template shingles in any window, and first and last place of the first such window."""
        places = np.flatnonzero(np.isin(run, self.shingles))
        kinds = np.searchsorted(self.shingles, run[places])
        most, where, counts, inside, low = 0, (0, 0), np.zeros(len(self.shingles), dtype=np.int64), 0, 0
        for high, (place, kind) in enumerate(zip(places, kinds)):
            counts[kind] += 1
            inside += counts[kind] == 1
            while places[low] <= place - self.length:
                counts[kinds[low]] -= 1
                inside -= counts[kinds[low]] == 0
                low += 1
            if inside > most:
                most, where = int(inside), (int(places[low]), int(place))
        return most, *where


def _scanner(templates: Mapping[str, str], width: int, percent: int, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = W.stream(11, bands * rows) | np.uint64(1), W.stream(12, bands * rows)
        names = list(templates)
        known = [Template(names[i], run, factors, shifts)
                 for i, run in shingle_runs(pa.array([templates[n] for n in names]), width)]
        minimal = np.unique(np.concatenate([t.minimal for t in known]))
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[minimal >> np.uint64(48)] = True
        for batch in batches:
            ids, out = batch.column(0), []
            for i, run in shingle_runs(batch.column(1), width):
                near = np.flatnonzero(maybe[run >> np.uint64(48)])
                near = near[np.isin(run[near], minimal)]
                for t in known if len(near) else ():
                    own = near[np.isin(run[near], t.minimal)]
                    if len(own) and t.retrieved(run, own, factors, shifts, rows):
                        found, first, last = t.best(run)
                        if 100 * found >= percent * len(t.shingles):
                            out.append((ids[i].as_py(), t.name, len(t.shingles), found, found / len(t.shingles), first, last + width - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                names=[part.split(" ")[0] for part in _MATCH.split(", ")])

    return scan


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
    width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document and template it carries: how many of its shingles, and from which word to which."""
    pairs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = pairs.mapInArrow(_scanner(dict(templates), width, percent, bands, rows), _MATCH)
    return Scratch(docs.sparkSession, "licenses").keep(found, "matches")
