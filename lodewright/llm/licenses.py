"""License scan: MinHash over overlapping windows finds templates, exact shingle containment verifies them.

Texts are cut into words (letters and digits, A-Z in lower case) and five-word shingles. A template of m shingles is filed under
the MinHashes of all its windows of L shingles, L the largest power of two for which a window grid of step max(1, L / 4) must
put a whole window inside the template (L + step - 1 <= m). A document's windows of that length lie on such a grid. Eight bands
of one MinHash each collide with probability 1 - (1 - J)**8 for windows of Jaccard similarity J: 1 for a verbatim notice, 0.9999987
at 0.8, 0.996 at one half. Every candidate is then verified: the share of the template's shingles in the stretch around the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import lean, ship
from ._words import hashes, lower, mix, pieces, row_of, split

SHINGLE, BANDS, LEAST = 5, 8, 0.8
#: Public notices of common licenses, sentences that are usual in their headers and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "MIT-license": "distributed under the MIT License",
    "MIT-licensed": "is licensed under the MIT License",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-name": "the terms of the Apache License, Version 2.0",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "AGPL-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL": "licensed under the GNU Affero General Public License",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "Artistic-2.0": "licensed under the Artistic License 2.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY": "licensed under the Creative Commons Attribution License",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
_EDGE = np.ones(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every five-word shingle, in order."""
    starts, ends, woff = split(raw, off, _EDGE)
    h, row = hashes(lower(raw), starts, ends), row_of(woff)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    inside = row[:n] == row[SHINGLE - 1 :]
    return row[:n][inside], mix(out[inside])


def step(length: int) -> int:
    return max(1, length // 4)


def window_length(m: int) -> int:
    """Shingles of a window for a template of ``m``."""
    best = length = 1
    while length + step(length) - 1 <= m:
        best, length = length, 2 * length
    return best


def _minima(h: np.ndarray, length: int) -> np.ndarray:
    """Minimum over every ``length`` (a power of two) consecutive values."""
    width = 1
    while width < length and len(h) > width:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == length else h[:0]


class Templates:
    """Templates filed by window length, band and MinHash. Texts of under five words cannot be templates."""

    def __init__(self, texts: dict[str, str]):
        self.names, self.sets, files = sorted(texts), [], {}
        for t, name in enumerate(self.names):
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            h = shingles(raw, np.array([0, len(raw)]))[1]
            if not len(h):
                raise ValueError(f"template {name} has under {SHINGLE} words")
            self.sets.append(np.unique(h))
            length = window_length(len(h))
            for k in range(BANDS):
                for v in np.unique(_minima(mix(h ^ _SEEDS[k]), length)).tolist():
                    files.setdefault(length, [{} for _ in range(BANDS)])[k].setdefault(v, []).append(t)
        self.files = files
        self.sieve = {length: [self._sieve(band) for band in bands] for length, bands in files.items()}
        self.size = [len(s) for s in self.sets]

    @staticmethod
    def _sieve(band: dict) -> np.ndarray:
        s = np.zeros(1 << 16, bool)
        s[[v & 0xFFFF for v in band]] = True
        return s

    def find(self, row: np.ndarray, h: np.ndarray) -> dict[tuple[int, int], float]:
        """Containment of each (row, template) found, for the shingles of consecutive rows."""
        found: dict[tuple[int, int], float] = {}
        tried = set()
        for k in range(BANDS):
            hk = mix(h ^ _SEEDS[k])
            for length, sieve in self.sieve.items():
                low = _minima(hk, length)[:: step(length)]
                for i in np.flatnonzero(sieve[k][(low & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    for t in self.files[length][k].get(int(low[i]), ()):
                        at = i * step(length)
                        r = row[at + int(np.argmin(hk[at : at + length]))]
                        if (at, t, r) in tried:
                            continue
                        tried.add((at, t, r))
                        a, b = max(0, at - self.size[t]), at + length + self.size[t]
                        near = h[a:b][row[a:b] == r]
                        c = float(np.isin(self.sets[t], near).mean())
                        if c >= LEAST:
                            found[int(r), t] = max(c, found.get((int(r), t), 0.0))
        return found


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment) of every license notice found, over whole texts and without a shuffle.

    Null and empty texts, and those of under five words, give no row; a row with a null id that matches is returned with it; repeated rows
    give repeated results; extra columns are not read. The templates are part of the program, a few kilobytes, and go with the tasks.
    """
    ship(docs.sparkSession)
    filed = Templates(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, shares = [], [], []
            for a, _, raw, off in pieces(b.column(1)):
                for (r, t), c in sorted(filed.find(*shingles(raw, off)).items()):
                    rows.append(a + r)
                    names.append(filed.names[t])
                    shares.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "license", "containment"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
