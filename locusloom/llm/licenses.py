"""License scans: MinHash bands over overlapping windows of a text retrieve license templates, exact containment verifies.

Texts are lower-cased and cut into ``\\w+`` words; shingles have 5 words (a shorter template is one shingle). For a
template of n words the windows have n + n // 4 + 1 words and begin every n // 4 + 2 words, so any n words in a row lie
whole in one of them. Window and template are compared by ``BANDS`` bands of one MinHash row each: they collide with
probability 1 - (1 - J)^BANDS. A window that holds 80 % of a template's shingles has J >= 1/3 even for the shortest
templates, so it is retrieved with probability above 1 - 4e-9.

Bands are looked up the other way round: a window can only collide in a band if it holds the template's minimal
shingle of that band. Those few shingles are found in all texts by their words' numbers, and only windows around them
have their MinHashes computed, over all their shingles. A retrieved window is a match if it holds at least
``containment`` of the template's distinct shingles, compared word by word.

Result: one row for each document and license found in it, with the best containment, the word at which the best
window begins (the first of equal ones), and the number of matching windows.

Edge cases: null and wordless texts and templates match nothing; several templates may stand for one license; rows
with equal or null ids are reported together under their id; empty tables give empty results; other columns are ignored.
Templates are broadcast and must have at most ``max_words`` words together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, received, shipped
from .decontam import Codes, words

K, BANDS = 5, 48

#: Notices by which texts state their license, with SPDX identifiers.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def shingles(w: list[str], k: int) -> list[tuple[str, ...]]:
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def row_hashes(s: tuple[str, ...]) -> np.ndarray:
    """One hash of a shingle for each band."""
    h = np.uint64(xxhash.xxh3_64_intdigest(" ".join(s).encode("utf-8", "surrogatepass")))
    x = h ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(s: set[tuple[str, ...]]) -> np.ndarray:
    return np.min(np.stack([row_hashes(x) for x in s]), axis=0)


class Index:
    """Templates with their bands."""

    def __init__(self, templates: list[tuple[str, str]], containment: float):
        self.containment = containment
        self.rows = [(i, w) for i, t in templates if (w := words(t))]
        self.vocab: dict[str, int] = {}
        for _, w in self.rows:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        self.sets, self.bands, self.shape = [], [], []
        #: shingle size -> first two numbers -> templates' minimal shingles
        self.keys: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for t, (_, w) in enumerate(self.rows):
            k = min(K, len(w))
            s = set(shingles(w, k))
            self.sets.append(s)
            self.bands.append(signature(s))
            n = len(w)
            self.shape.append((k, n + n // 4 + 1, n // 4 + 2))
            hashed = {x: row_hashes(x) for x in s}
            for x, h in hashed.items():
                if (h == self.bands[-1]).any():
                    self.keys.setdefault(k, {}).setdefault(tuple(self.vocab[v] for v in x), set()).add(t)
        self.codes: Codes | None = None  # each worker's own

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first word) of each matching window."""
        if not self.rows:
            return []
        if self.codes is None:
            self.codes = Codes(self.vocab)
        ids, sizes = self.codes.read(texts)
        base = np.concatenate(([0], np.cumsum(sizes)))
        known = ids >= 0
        todo: dict[tuple[int, int], set[int]] = {}
        for k, keys in self.keys.items():
            if ids.size < k:
                continue
            run = known[: ids.size - k + 1].copy()
            for j in range(1, k):
                run &= known[j : ids.size - k + 1 + j]
            at = np.flatnonzero(run)
            first = np.zeros(len(self.vocab), bool)
            first[[x[0] for x in keys]] = True
            at = at[first[ids[at]]]
            owner = np.searchsorted(base, at, side="right") - 1
            for p, text in zip(at.tolist(), owner.tolist(), strict=True):
                if p + k > base[text + 1]:
                    continue
                for t in keys.get(tuple(ids[p : p + k].tolist()), ()):
                    _, length, stride = self.shape[t]
                    q = p - int(base[text])
                    low = max(0, q + k - length)
                    todo.setdefault((text, t), set()).update(range(-(-low // stride) * stride, q + 1, stride))
        found, seen, w = [], -1, []
        for (text, t), starts in sorted(todo.items()):
            if text != seen:
                seen, w = text, words(texts[text])
            k, length, _ = self.shape[t]
            for a in sorted(starts):
                s = set(shingles(w[a : a + length], k))
                if not s or not (signature(s) == self.bands[t]).any():
                    continue
                share = len(s & self.sets[t]) / len(self.sets[t])
                if share >= self.containment - 1e-9:
                    found.append((text, t, share, a))
        return found


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = 0.8, max_words: int = 1_000_000) -> DataFrame:
    """doc_id, license_id, containment, position, n_windows; ``templates``: (license_id, text), by default :data:`NOTICES`."""
    rows = NOTICES
    if templates is not None:
        given = templates.where("license_id is not null and text is not null").select("license_id", "text").distinct()
        if (given.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0) > max_words:
            raise ValueError(f"templates of more than {max_words} words")
        rows = sorted((r["license_id"], r["text"]) for r in given.toLocalIterator())
    shared = shipped(docs.sparkSession, Index(rows, containment))

    def run(batches):
        index = received(shared)
        for batch in bounded(batches, "text"):
            hits = index.scan(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.rows[h[1]][0] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int64())],
                ["doc_id", "license_id", "containment", "position"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, f"doc_id {kind}, license_id string, containment double, position long")
    best = F.max(F.struct("containment", (-F.col("position")).alias("p"))).alias("b")
    return found.groupBy("doc_id", "license_id").agg(best, F.count("*").alias("n_windows")).select("doc_id", "license_id", "b.containment", (-F.col("b.p")).alias("position"), "n_windows")
