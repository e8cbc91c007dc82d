"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table
from .shingles import WIDTH, shingled

#: Share of a template's shingles that a window must contain, and chance that retrieval may miss such a window.
CONTAINMENT, MISS = 0.8, 1e-6

# Public license notices, by SPDX identifier. A template is found where its words stand,
# whatever their case and punctuation.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_rng = np.random.default_rng(19450)
_A = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


@dataclass
class Level:
    """Templates of up to reach shingles: windows of 2 * reach at every reach-th place, or of 1 at each."""

    reach: int
    bands: int
    members: list[int]
    keys: list[np.ndarray]


class Templates:
    """Templates by size, and the bands of one minhash each that find them.

    A run of t <= reach shingles lies in one of the overlapping windows of 2 * reach. With containment c
    of the template in that window their similarity is c * t / (2 * reach + (1 - c) * t) at least, so that
    bands = log(miss) / log(1 - similarity) leave a chance of miss that none of the bands collides.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> None:
        self.names = [n for n, _ in templates]
        self.containment = containment
        parts = list(shingled(pa.array([t for _, t in templates], pa.large_string()), alnum=True))
        self.sets = [np.unique(p.shingles[p.shingle_starts[r] : p.shingle_starts[r + 1]]) for p in parts for r in range(p.n)]
        self.spans = [int(p.shingle_starts[r + 1] - p.shingle_starts[r]) for p in parts for r in range(p.n)]
        words = [int(p.word_starts[r + 1] - p.word_starts[r]) for p in parts for r in range(p.n)]
        if any(w < WIDTH for w in words):
            raise ValueError(f"a template needs {WIDTH} words")
        self.levels, least = [], []
        for power in sorted({math.ceil(math.log2(s)) for s in self.spans}):
            members = [k for k, s in enumerate(self.spans) if math.ceil(math.log2(s)) == power]
            reach = 1 << power
            worst = min(self.spans[k] for k in members)
            likeness = 1.0 if reach == 1 else containment * worst / (2 * reach + (1 - containment) * worst)
            bands = 1 if likeness >= 1 else math.ceil(math.log(miss) / math.log1p(-likeness))
            hashed = [[self.sets[k] * _A[b] + _B[b] for k in members] for b in range(bands)]
            minima = [np.array([h.min() for h in row]) for row in hashed]
            least += [self.sets[k][h.argmin()] for row in hashed for k, h in zip(members, row, strict=True)]
            self.levels.append(Level(reach, bands, members, minima))
        self.least = np.unique(np.array(least, np.uint64))

    def find(self, shingles: np.ndarray) -> dict[int, tuple[float, int]]:
        """template number: (containment, number of disjoint places) for one text's shingles in order."""
        out = {}
        for level in self.levels:
            for k, windows in self._retrieved(shingles, level).items():
                wanted, best, places, end = self.sets[k], 0.0, 0, -1
                for w in windows:
                    at = w if level.reach == 1 else w * level.reach
                    part = shingles[at : at + (1 if level.reach == 1 else 2 * level.reach)]
                    share = float(np.isin(wanted, part).mean())
                    if share >= self.containment and at >= end:
                        places, end = places + 1, at + len(part)
                    best = max(best, share)
                if best >= self.containment:
                    out[k] = (best, places)
        return out

    def _retrieved(self, shingles: np.ndarray, level: Level) -> dict[int, list[int]]:
        found: dict[int, set[int]] = {}
        n = len(shingles)
        starts = np.arange(0, n, level.reach)
        for b in range(level.bands):
            minima = np.minimum.reduceat(shingles * _A[b] + _B[b], starts) if level.reach > 1 else shingles * _A[b] + _B[b]
            if level.reach > 1 and len(minima) > 1:
                minima = np.minimum(minima, np.append(minima[1:], minima[-1]))
            for k, key in zip(level.members, level.keys[b].tolist(), strict=True):
                hit = np.flatnonzero(minima == np.uint64(key))
                if len(hit):
                    found.setdefault(k, set()).update(hit.tolist())
        return {k: sorted(v) for k, v in found.items()}


def licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_licenses, licenses, n_places, containment.

    licenses: the names found, sorted, distinct, comma-joined ('' if none); n_licenses: how many;
    n_places: windows that hold a template, of all templates; containment: the greatest share of a
    template's distinct 5-word shingles in one window, 0 if none reaches the threshold. Words are runs
    of letters, digits and non-ASCII characters. Null text is empty. Whole texts stream through; the
    templates, a parameter of bounded size, go with the code.
    """
    known = Templates(templates, containment)
    names = ["doc_id", "n_licenses", "licenses", "n_places", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for part in shingled(batch.column(1), alnum=True):
                near = _rows_near(known, part)
                for r in range(part.n):
                    if r not in near:
                        rows.append((0, "", 0, 0.0))
                        continue
                    found = known.find(part.shingles[part.shingle_starts[r] : part.shingle_starts[r + 1]])
                    of = sorted({known.names[k] for k in found})
                    rows.append((len(of), ",".join(of), sum(p for _, p in found.values()), max((c for c, _ in found.values()), default=0.0)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds))], names)

    schema = "doc_id long, n_licenses long, licenses string, n_places long, containment double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _rows_near(known: Templates, part) -> set[int]:
    """Rows with a shingle that is some template's minimum in some band: no other row's windows can collide."""
    at = np.flatnonzero(np.isin(part.shingles, known.least))
    return set((np.searchsorted(part.shingle_starts, at, "right") - 1).tolist())


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
