"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are op2's (ASCII letters lower-cased, digits, everything from U+0080); shingles have five words. For a
template of S shingles, windows of S shingles start every ceil(S / 4): any occurrence lies in a window
that shares with it at least 0.8 of their union, or 0.55 where only 0.8 of the template is there. 64
permutations in 32 bands of 2 rows collide with a probability of at least 1 - (1 - 0.55**2)**32 > 0.99998.
A band can only collide in a window that holds a shingle of the template, so signatures are made for those
windows alone. Retrieved templates are verified on the words themselves: the share of the template's
distinct shingles inside the window and one step around it must reach `least`.

Templates are the fixed list below, or a table of any size. Null, empty and
shorter texts match nothing; repeated rows are scanned as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytelens.llm import decontaminate, textcore as tc
from bytelens.llm.blocks import merged, with_keys
from bytelens.runtime import KEY, ship

K, BANDS, ROWS = 5, 32, 2
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Public license notices: id, text. Fixed values.
TEMPLATES = [
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def signature(shingles: np.ndarray) -> np.ndarray:
    return tc.mix(shingles[:, None] * _SEEDS[0] + _SEEDS[1]).min(0)


def band_keys(sig: np.ndarray) -> list[tuple[int, bytes]]:
    return [(b, sig[b * ROWS : (b + 1) * ROWS].tobytes()) for b in range(BANDS)]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.names, self.sets, self.sizes = [], [], []
        self.short: list[tuple[str, np.ndarray]] = []
        self.bands: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        known = []
        for name, text in templates:
            words = decontaminate.words_of(text)
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = tc.Words(data, np.array([0, len(data)]), 0, 1, tc.ALNUM).hash
            if len(words) < K:
                if words:
                    self.short.append((name, hashes))
                continue
            sh = tc.shingles(hashes, K)
            k = len(self.names)
            self.names.append(name)
            self.sets.append({tuple(words[i : i + K]) for i in range(len(words) - K + 1)})
            self.sizes.append(len(sh))
            known.append(np.unique(sh))
            for key in band_keys(signature(np.unique(sh))):
                self.bands.setdefault(len(sh), {}).setdefault(key, []).append(k)
        self.known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, str, int, int, float]]:
        """row, template, first word, end word, containment, for every place that holds a template; of places that overlap
        the best."""
        w = tc.Words(data, offs, lo, hi, tc.ALNUM)
        for name, hashes in self.short:  # shorter than a shingle: the whole sequence is one
            m = len(hashes)
            at = np.arange(max(0, len(w.hash) - m + 1))
            for j, h in enumerate(hashes):
                at = at[w.hash[at + j] == h]
            row = np.searchsorted(w.bounds, at, "right") - 1
            inside = at + m <= w.bounds[row + 1]
            for i, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                yield lo + r, name, i - int(w.bounds[r]), i - int(w.bounds[r]) + m, 1.0
        sh = tc.shingles(w.hash, K)
        hit = np.flatnonzero(self.maybe[(sh >> np.uint64(48)).astype(np.int64)])
        hit = hit[np.isin(sh[hit], self.known)]
        if not len(hit):
            return
        row = np.searchsorted(w.bounds, hit, "right") - 1
        for r in np.unique(row).tolist():
            a, z = int(w.bounds[r]), int(w.bounds[r + 1])
            own = hit[row == r] - a
            n = z - a - K + 1
            if n <= 0:
                continue
            own = own[own < n]
            sets = sh[a : a + n]
            places: dict[int, list[tuple[float, int, int]]] = {}
            said: list[bytes] = []  # the row's words, cut once, when a place is first looked at
            for size, bands in self.bands.items():
                step = -(-size // 4)
                lo_w = np.unique(np.concatenate([np.maximum(0, own - j) // step * step for j in range(0, size + step, step)]))
                for s in lo_w.tolist():
                    part = sets[s : s + size]
                    if not len(part):
                        continue
                    keys = band_keys(signature(part))
                    for k in {k for key in keys for k in bands.get(key, ())}:
                        p, q = max(0, s - step), min(n, s + size + step)
                        if not said:
                            said = [w.buf[x:y].tobytes().lower() for x, y in zip(w.start[a:z].tolist(), w.end[a:z].tolist(), strict=True)]
                        found_at = [(i, g) for i in range(p, q) if (g := tuple(said[i : i + K])) in self.sets[k]]
                        share = len({g for _, g in found_at}) / len(self.sets[k])
                        if share >= self.least:
                            places.setdefault(k, []).append((share, found_at[0][0], found_at[-1][0] + K))
            for k, found in sorted(places.items()):
                taken: list[tuple[int, int]] = []
                for share, x, y in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
                    if all(y <= u or x >= v for u, v in taken):
                        taken.append((x, y))
                        yield lo + r, self.names[k], x, y, share


_MATCHES = "array<struct<template:string,from:long,to:long,containment:double>>"


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, *, least: float = 0.8, block_templates: int = 5000) -> DataFrame:
    """doc_id, matches: array of template, from, to (words, exclusive), containment, one for each place that holds a template;
    a row for each row of docs. templates: template_id, text; those without words are left out, those of fewer than five words
    match as a whole. Null and empty texts have no matches; repeated rows, and null or repeated doc_ids, are scanned one by
    one; an empty table gives no rows; texts are scanned whole.

    About block_templates templates are sent to tasks at a time; with more, each block's matches are written by row key and joined to the rows once, in
    the order of their places."""
    spark = ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("template", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("containment", pa.float64())]))

    def scanner(rows: list[tuple[str, str]], cols: list[str], hits_only: bool = False):
        sent = spark.sparkContext.broadcast(Scanner(rows, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            for batch in batches:
                data, offs = tc.text_bytes(batch.column("text"))
                out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for lo, hi in tc.chunks(offs):
                    for r, k, a, b, share in s.scan(data, offs, lo, hi):
                        out[r].append({"template": k, "from": a, "to": b, "containment": share})
                got = pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out, kind)], names=[*cols, "matches"])
                yield got.filter(pa.array([bool(x) for x in out], pa.bool_())) if hits_only else got

        return run

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    known = None if templates is None else templates.select(F.col("template_id").cast("string").alias("template_id"), "text").where("text is not null")
    n_blocks = 1 if known is None else max(1, -(-known.count() // block_templates))
    if n_blocks == 1:
        rows = TEMPLATES if known is None else [(r[0], r[1]) for r in known.orderBy("template_id").collect()]
        return docs.select("doc_id", "text").mapInArrow(scanner(rows, ["doc_id"]), f"doc_id {id_kind}, matches {_MATCHES}")
    docs = with_keys(docs)
    block = F.pmod(F.xxhash64("template_id", "text"), F.lit(n_blocks))
    parts = ([(r[0], r[1]) for r in known.where(block == b).orderBy("template_id").collect()] for b in range(n_blocks))
    hits = (docs.select(*KEY, "text").mapInArrow(scanner(rows, list(KEY), True), f"__file long, __at long, matches {_MATCHES}") for rows in parts)
    placed = lambda m: F.transform(F.array_sort(F.transform(m, lambda x: F.struct(x["from"].alias("a"), x["to"].alias("b"), x["template"].alias("t"), x["containment"].alias("c")))), lambda x: F.struct(x["t"].alias("template"), x["a"].alias("from"), x["b"].alias("to"), x["c"].alias("containment")))
    return merged(docs.select(*KEY, "doc_id"), hits, matches=placed).select("doc_id", "matches")
