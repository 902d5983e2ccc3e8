"""License scans: MinHash bands retrieve notices, exact shingle containment verifies them.

Texts are read as words of letters and digits in lower case and hashed to shingles of
five words. For notices of up to 4 s shingles (s a power of two) the windows are 5 s
shingles long and begin every s shingles, so every occurrence of a notice lies within a
window. If four fifths of a notice's shingles are there, the Jaccard similarity of window
and notice is at least 0.8 (2 s) / (5 s + 0.2 x 4 s); with single-row bands, ``BANDS`` of
them miss such a window with a probability below one in a million. A window that shares
a band with a notice is compared by the exact set of shingles.

A notice of under five words is found by its exact sequence of words, in texts of any
length. A notice without words is refused.

Nulls: a null text has no matches. Rows without doc_id are scanned too. Repeated rows
give repeated results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Least similarity of a window that holds a match, and the bands that this asks for.
LEAST = CONTAINMENT * 2 / (5 + (1 - CONTAINMENT) * 4)
BANDS = math.ceil(math.log(MISS) / math.log(1 - LEAST))
#: Shingles hashed together, so that a very long text needs no more memory than this.
STRETCH = 1 << 15

# Notices as their authors word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
}
#: Notices of under five words.
SHORT_NOTICES = {
    "All-rights-reserved": "All rights reserved",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
}


def shingles_of(text: str | None, memory: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the text's five-word shingles, in order."""
    return _rolled(_word_hashes(text, memory), SHINGLE)


def _word_hashes(text: str | None, memory: dict[str, int]) -> np.ndarray:
    words = _words(text)
    get = memory.get
    hashes = [get(w) for w in words]
    if None in hashes:
        if len(memory) > 500_000:
            memory.clear()
        memory.update((w, xxhash.xxh64_intdigest(w)) for w in set(words))
        hashes = [memory[w] for w in words]
    return np.array(hashes, np.uint64)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(h) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def _band_constants() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"band {i}") | 1 for i in range(BANDS)], np.uint64)


class Scanner:
    def __init__(self, notices: Mapping[str, str], containment: float):
        self.memory: dict[str, int] = {}
        self.odd, self.containment = _band_constants(), containment
        self.classes: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        self.short: dict[int, list[tuple[str, np.uint64]]] = {}
        for name, text in notices.items():
            hashes = _word_hashes(text, {})
            if not len(hashes):
                raise ValueError(f"the notice {name!r} has no words")
            if len(hashes) < SHINGLE:
                self.short.setdefault(len(hashes), []).append((name, _rolled(hashes, len(hashes))[0]))
                continue
            own = np.unique(shingles_of(text, {}))
            step = 1 << max(0, math.ceil(math.log2(len(own) / 4)))
            self.classes.setdefault(step, []).append((name, own, self._hashed(own).min(axis=1)))

    def _hashed(self, shingles: np.ndarray) -> np.ndarray:
        x = shingles[None, :] * self.odd[:, None]
        return x ^ (x >> np.uint64(32))

    def scan(self, text: str | None) -> dict[str, tuple[float, int]]:
        """Best containment and the first word of the window that has it, by notice."""
        hashes = _word_hashes(text, self.memory)
        every = _rolled(hashes, SHINGLE)
        best: dict[str, tuple[float, int]] = {}
        for width, notices in self.short.items():
            runs = _rolled(hashes, width)
            for name, wanted in notices:
                if len(at := np.flatnonzero(runs == wanted)):
                    best[name] = (1.0, int(at[0]))
        longest = 5 * max(self.classes, default=1)
        for first in range(0, max(1, len(every) - longest + 1) if len(every) else 0, STRETCH):
            own = every[first : first + STRETCH + longest]
            hashed = self._hashed(own)
            least, wide = hashed, 1
            for step in sorted(self.classes):
                while wide < step:  # minima of pairs of neighbouring steps
                    if least.shape[1] % 2:
                        least = np.concatenate([least, least[:, -1:]], axis=1)
                    least, wide = np.minimum(least[:, ::2], least[:, 1::2]), 2 * wide
                low = least
                if low.shape[1] > 1:
                    padded = np.concatenate([least] + [least[:, -1:]] * 4, axis=1)
                    low = least.copy()
                    for shift in range(1, 5):
                        np.minimum(low, padded[:, shift : shift + low.shape[1]], out=low)
                for name, notice, signature in self.classes[step]:
                    for at in np.flatnonzero((low == signature[:, None]).any(axis=0)).tolist():
                        window = own[at * step : (at + 5) * step]
                        share = float(np.isin(notice, window).mean())
                        if share >= self.containment and share > best.get(name, (0.0, 0))[0]:
                            best[name] = (share, first + at * step)
        return best


def scan_licenses(docs: DataFrame, notices: Mapping[str, str] = {**NOTICES, **SHORT_NOTICES}, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word: a row for each notice found in a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = dict(notices)
    Scanner(chosen, containment)  # refuses notices without words before any task runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, containment)
        for batch in batches:
            rows, names, shares, places = [], [], [], []
            for row in range(batch.num_rows):
                for name, (share, place) in sorted(scanner.scan(batch.column(1)[row].as_py()).items()):
                    rows.append(row)
                    names.append(name)
                    shares.append(share)
                    places.append(place)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(places, pa.int64())],
                ["doc_id", "license", "containment", "first_word"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, containment double, first_word bigint")
