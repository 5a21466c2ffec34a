"""Licence notices in documents, on a line or wrapped over several.

A notice is a stretch of words that holds a share CONFIRM of the neighbouring word pairs of a template (a paragraph of the
licence or a usual notice), or all pairs of a name or tag, as a name with another word in it is another licence's: on one
line, or over consecutive lines (a line without words ends them) within twice the template's words. A logistic regression
over hashed word n-grams gives the words of overlapping stretches, or of their line if it holds no others, a probability for
every licence family and for `unknown`. It learns from the templates, names and tags below, varied at random (names and tags
only in what stands around them), and from paragraphs of the corpus as examples of the unknown class (a random sample of
documents, bounded in documents and in bytes: NEGATIVES, NEGATIVE_BYTES). A temperature fitted on held-out variations and
paragraphs calibrates the probabilities. A prediction stands only for a family of these stretches. Other families of theirs
stand beside it if they also hold the needed share of the pairs that the first one's templates lack, and if the words
without those that only the first one's templates have give them the probability.
A licence of several paragraphs gives a row for each of them that is a template.

Words without pairs of the templates can't be confirmed, so only the others are scored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_TABLE, WORD_TABLE, chosen, run_hashes, sample_share, text_slices, words

UNKNOWN = "unknown"
CONFIRM, PROBABLE = 0.6, 0.5
BITS = 16
BUCKETS = 1 << BITS
#: At most about so many documents, and bytes of text, give examples of the unknown class.
NEGATIVES, NEGATIVE_BYTES = 1000, 32 << 20
VARIATIONS, EPOCHS, RATE = 60, 6, 2.0

# Usual wordings of licence notices, and paragraphs of licences.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "Released under the Apache 2.0 license",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "BSD": [
        "Released under the BSD license",
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["Dedicated to the public domain under CC0 1.0 Universal", "Released under CC0 1.0"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License 2.0",
    ],
    "GFDL-1.3": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
        "Licensed under the GNU Free Documentation License, version 1.3",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "either version 2 of the License, or (at your option) any later version",
        "Released under the GPL version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or (at your option) any later version",
        "Released under the GPL version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License",
        "Released under the LGPL",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Released under the zlib License",
    ],
}

# Names of licences, all of whose words must stand together.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU AGPL v3", "GNU AGPLv3"],
    "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License Version 1.0"],
    "CC-BY": ["Creative Commons Attribution 4.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0"],
    "CC0": ["CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License Version 2.0"],
    "GFDL-1.3": ["GNU Free Documentation License version 1.3"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL v2", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL v3", "GNU GPLv3"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}

# Short identifiers, as they stand in tags and after "licensed under"; "-or-later" and the like may follow.
IDENTIFIERS = {
    "AGPL-3.0": ["AGPL-3.0"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "BSL-1.0": ["BSL-1.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC0": ["CC0-1.0"],
    "EPL-2.0": ["EPL-2.0"],
    "GFDL-1.3": ["GFDL-1.3"],
    "GPL-2.0": ["GPL-2.0"],
    "GPL-3.0": ["GPL-3.0"],
    "ISC": ["ISC"],
    "LGPL": ["LGPL-2.1", "LGPL-3.0"],
    "MIT": ["MIT"],
    "MPL-2.0": ["MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["Zlib"],
}
TAGS = ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}")


def _hashes(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    data = LOWER_TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    starts, ends, places = words(data, offsets, WORD_TABLE[data])
    own = run_hashes(data, starts, ends)
    return [own[a:b] for a, b in zip(places[:-1], places[1:])]


def _pairs(h: np.ndarray) -> set[int]:
    return set(_pair(h).tolist())


def _pair(h: np.ndarray) -> np.ndarray:
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]


FAMILIES = sorted(TEMPLATES)
#: Names and tags follow the templates.
_short = [(FAMILIES.index(f), h) for f in FAMILIES for h in _hashes([*NAMES[f], *(tag.format(x) for x in IDENTIFIERS[f] for tag in TAGS)])]
_forms = [(FAMILIES.index(f), h) for f in FAMILIES for h in _hashes(TEMPLATES[f])]
#: The share of its pairs that each form needs.
_needed = [CONFIRM] * len(_forms) + [1.0] * len(_short)
_forms += _short
_form_pairs = [(f, _pairs(h)) for f, h in _forms]
_templates_of: dict[int, list[int]] = defaultdict(list)
for _k, (_, _own) in enumerate(_form_pairs):
    for _x in _own:
        _templates_of[_x].append(_k)
PAIRS = np.array(sorted(_templates_of), np.uint64)
#: All pairs and words of each family's templates.
_family_pairs = [set().union(*(x for f, x in _form_pairs if f == k)) for k in range(len(FAMILIES))]
_family_words = [set().union(*(h.tolist() for f, h in _forms if f == k)) for k in range(len(FAMILIES))]


def confirms(h: np.ndarray) -> bool:
    """Whether the words hold the needed share of any form's pairs."""
    own = _pairs(h)
    return any(len(own & pairs) >= needed * len(pairs) for (_, pairs), needed in zip(_form_pairs, _needed))


def buckets(h: np.ndarray) -> np.ndarray:
    """Distinct buckets of the words, word pairs and word triples."""
    m = np.uint64(0x9E3779B97F4A7C15)
    parts = [h * m] + [x for x in (h[:-1] * m + h[1:], (h[:-2] * m + h[1:-1]) * m + h[2:]) if len(x)]
    return np.unique((np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(negatives: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x classes, the last class is unknown) and biases, divided by the calibrating temperature."""
    rng, rows = np.random.default_rng(seed), []
    corpus = np.concatenate([*negatives, np.arange(1, 50, dtype=np.uint64)])
    for (family, h), needed in zip(_forms, _needed):
        for k in range(VARIATIONS):
            own = h.copy()
            if k and needed < 1:
                edits = rng.random(len(own)) < 0.08
                own[edits] = rng.choice(corpus, int(edits.sum()))
                own = own[: max(3, int(len(own) * rng.uniform(0.8, 1.3)))]
            if k:
                own = np.concatenate([rng.choice(corpus, rng.integers(0, 5)), own, rng.choice(corpus, rng.integers(0, 5))])
            rows.append((buckets(own), family))
    unknown = len(FAMILIES)
    rows += [(buckets(h), unknown) for h in negatives if len(h) and not confirms(h)]
    # Near misses: words of the templates out of order.
    for _, h in _forms:
        rows += [(buckets(rng.permutation(np.concatenate([h, rng.choice(corpus, 6)]))), unknown) for _ in range(VARIATIONS // 4)]
    weights, bias = np.zeros((BUCKETS, unknown + 1), np.float32), np.zeros(unknown + 1, np.float32)
    order = rng.permutation(len(rows))
    held, learned = order[: len(order) // 5], order[len(order) // 5 :]

    def logits(i: int) -> np.ndarray:
        index = rows[i][0]
        return weights[index].sum(axis=0) / np.sqrt(len(index)) + bias

    for epoch in range(EPOCHS):
        for i in rng.permutation(learned):
            index, y = rows[i]
            z = logits(i)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE / (1 + epoch)
            weights[index] -= np.float32(rate / np.sqrt(len(index))) * p.astype(np.float32)
            bias -= np.float32(rate * 0.01) * p.astype(np.float32)
    z, y = np.stack([logits(i) for i in held]), np.array([rows[i][1] for i in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    t = min(np.geomspace(0.2, 5, 33), key=loss)
    return weights / np.float32(t), bias / np.float32(t)


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines of all texts in the data, and each text's place among them."""
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([breaks, offsets]))
    return bounds, np.searchsorted(bounds, offsets)


def _stretches(k: int, at: list[int], pairs: list[int], lines: list[int]) -> Iterator[tuple[int, int, float]]:
    """(first word, end, share) of the stretches that hold enough pairs of template k. at, pairs and lines: the first word
    of each of its pairs in a paragraph, the pair, and the line on which the pair ends."""
    total, reach, i = len(_form_pairs[k][1]), 2 * len(_forms[k][1]), 0
    places: dict[int, list[int]] = defaultdict(list)
    again = [len(at)] * len(at)  # where each pair stands next
    for j, pair in enumerate(pairs):
        if places[pair]:
            again[places[pair][-1]] = j
        places[pair].append(j)
    if len(places) / total < _needed[k]:
        return
    while i < len(at):
        firsts = [own[bisect_left(own, i)] for own in places.values() if own[-1] >= i]
        for end in (bisect_right(lines, lines[i]), bisect_right(at, at[i] + reach - 2)):  # on the line, or wrapped
            held = [j for j in firsts if j < end]
            if len(held) / total >= _needed[k]:
                last = max(held)
                while again[i] <= last:
                    i += 1
                yield at[i], at[last] + 2, len(held) / total
                i = last
                break
        i += 1


def notices(h: np.ndarray, line: np.ndarray, hits: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
    """(line, family, probability, share) of the notices in a paragraph. h and line: the words and their lines, of more
    text too; hits: the first words of the paragraph's pairs that templates hold."""
    held: dict[int, list[int]] = defaultdict(list)
    values = dict(zip(hits.tolist(), (h[hits] * np.uint64(0x9E3779B97F4A7C15) + h[hits + 1]).tolist()))
    for at, pair in values.items():
        for k in _templates_of[pair]:
            held[k].append(at)
    found = []
    for k, at in held.items():
        if len(at) / len(_form_pairs[k][1]) >= _needed[k]:
            found += [(a, b, k, share) for a, b, share in _stretches(k, at, [values[x] for x in at], line[np.array(at) + 1].tolist())]
    groups: list[list[tuple[int, int, int, float]]] = []
    end = 0
    for one in sorted(found):  # those that overlap compete
        if not groups or one[0] >= end:
            groups.append([])
        groups[-1].append(one)
        end = max(end if len(groups[-1]) > 1 else 0, one[1])
    bounds = [(g[0][0], max(x[1] for x in g)) for g in groups]
    shared = Counter(x for a, b in bounds for x in range(int(line[a]), int(line[b - 1]) + 1))
    for group, (a, b) in zip(groups, bounds):
        if line[a] == line[b - 1] and shared[int(line[a])] == 1:
            a, b = np.searchsorted(line, line[a]), np.searchsorted(line, line[a], "right")
        yield from _families(h[a:b], group, line, model)


def _families(own: np.ndarray, group: list[tuple[int, int, int, float]], line: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
    """The families of stretches that overlap, the likeliest first."""
    weights, bias = model
    best: dict[int, tuple[float, int, int]] = {}
    for a, _, k, share in group:
        family = _form_pairs[k][0]
        best[family] = max(best.get(family, (0.0, 0, 0)), (share, -a, k))
    pairs, taken, told = _pairs(own), set(), set()
    while best and len(own):
        index = buckets(own)
        z = weights[index].sum(axis=0) / np.sqrt(len(index)) + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        family = int(p[:-1].argmax())
        if family not in best or p[family] < PROBABLE:
            return
        share, a, _ = best.pop(family)
        yield int(line[-a]), family, float(p[family]), share
        taken |= _family_pairs[family]
        told |= _family_words[family]
        left = {}
        for f, x in best.items():
            lacking = _form_pairs[x[2]][1] - taken
            if lacking and len(lacking & pairs) / len(lacking) >= _needed[x[2]]:
                left[f] = x
        best = left
        others = set().union(*(_family_words[f] for f in best))
        own = own[[w not in told or w in others for w in own.tolist()]]


def train(df: DataFrame, seed: int = 23, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the classifier. Rows with a null id or text give no examples; of an empty table the templates
    alone, and words out of order, are learned."""
    rows = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("__id").isNotNull() & F.col("text").isNotNull())
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sample = rows.where(chosen(F.col("__id"), min(sample_share(n, NEGATIVES), sample_share(size, NEGATIVE_BYTES)), seed))

    def learn(table: pa.Table) -> pa.Table:
        lines = [line for t in table.sort_by("__id").column("text").to_pylist() for line in t.split("\n")]
        weights, bias = fit(_hashes(lines) if lines else [], seed)
        used = np.flatnonzero(np.abs(weights).max(axis=1) > 1e-3).astype(np.int32)
        return pa.table({"used": pa.array([used.tobytes()], pa.binary()), "weights": pa.array([weights[used].tobytes()], pa.binary()), "bias": pa.array([bias.tobytes()], pa.binary())})

    one = sample.unionByName(df.sparkSession.sql("select null as __id, '' as text").select(F.col("__id").cast(rows.schema["__id"].dataType).alias("__id"), "text"))
    r = one.withColumn("__all", F.lit(0)).groupBy("__all").applyInArrow(learn, "used binary, weights binary, bias binary").first()
    weights = np.zeros((BUCKETS, len(FAMILIES) + 1), np.float32)
    weights[np.frombuffer(r["used"], np.int32)] = np.frombuffer(r["weights"], np.float32).reshape(-1, len(FAMILIES) + 1)
    return weights, np.frombuffer(r["bias"], np.float32)


def scan(df: DataFrame, model: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each licence notice: doc_id, paragraph (the line of the text, from 0, on which it begins), family, score (the
    calibrated probability of the family) and similarity (the share of a template's word pairs that it holds).

    Null or empty texts have none; repeated rows each give theirs."""
    held = df.sparkSession.sparkContext.broadcast(model)
    first = np.zeros(1 << 16, bool)
    first[(PAIRS >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            data = LOWER_TABLE[data]
            bounds, place = _paragraphs(data, offsets)
            starts, ends, texts = words(data, offsets, WORD_TABLE[data])
            own = run_hashes(data, starts, ends)
            pairs = _pair(own)
            maybe = np.flatnonzero(first[(pairs >> np.uint64(48)).astype(np.int64)])
            hits = maybe[np.isin(pairs[maybe], PAIRS)]
            if not len(hits):
                continue
            line = np.searchsorted(bounds, starts, side="right") - 1
            cut = np.diff(line) > 1  # a line without words, or another text
            heads = texts[(texts > 0) & (texts < len(own))]
            cut[heads - 1] = True
            hits = hits[~cut[hits]]
            part = np.cumsum(cut)[hits]
            found = []
            for group in np.split(hits, np.flatnonzero(np.diff(part)) + 1) if len(hits) else ():
                for at, family, p, share in notices(own, line, group, held.value):
                    doc = int(np.searchsorted(place, at, side="right")) - 1
                    found.append((doc, at - int(place[doc]), FAMILIES[family], p, share))
            if found:
                doc, at, family, p, share = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(at, pa.int64()), pa.array(family), pa.array(p, pa.float64()), pa.array(share, pa.float64())], names=["doc_id", "paragraph", "family", "score", "similarity"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, paragraph long, family string, score double, similarity double")
