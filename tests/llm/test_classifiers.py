"""Held-out accuracy of the learned classifiers, and their edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.llm import langid, licenses, quality, toxicity

EN = "the of and to in is that for it with as was on be by this are from or an".split()
DE = "der die und das ist nicht ein zu den mit auf für von dem sich des im als auch".split()
EDGE = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "123 ... !!"), (9005, "the " * 30000), (None, "the of and")]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        lang = "de" if i % 4 == 0 else "en"
        text, good, toxic = sentence(rng, DE if lang == "de" else EN, rng.randrange(20, 80)), 1, 0
        if i % 5 == 0:
            text, good = " ".join(w.upper() + "$$$" for w in text.split()), 0
        if i % 3 == 0:
            text, toxic = text + " you utter nitwit " + sentence(rng, EN, 5), 1
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, good, toxic))
    schema = "doc_id long, text string, lang string, score string, n_chars int"
    edge = [(i, t, None, "s0", 0) for i, t in EDGE]
    docs = spark.createDataFrame(rows + edge + rows[:1], schema).repartition(3)
    return docs, spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module,label,folds,held,column", [(quality, "quality", 4, 2, 1), (toxicity, "toxic", 3, 1, 2)])
def test_binary_classifiers(spark, corpus, module, label, folds, held, column):
    docs, table, labels = corpus
    got = module.score(docs, module.train(docs, table, label, folds, held)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    apart = [(scores[x[0]] >= 0.7) == (x[column] == 1) for x in labels if fold(x[0], folds) == held]
    assert len(apart) > 50 and sum(apart) / len(apart) > 0.95
    empty = module.score(docs, module.train(docs, table.where("doc_id < 0"), label, folds, held)).first()
    assert empty.score == 0.5
    assert module.score(docs.where("doc_id < 0"), module.train(docs, table, label, folds, held)).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, corpus):
    docs, table, _ = corpus
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = table.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (dict((r.doc_id, r.score) for r in quality.score(docs, quality.train(docs, t, "quality")).collect()) for t in (table, other))
    assert one == two


def test_language(spark, corpus):
    docs, _, _ = corpus
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = langid.predict(docs, model, ["doc_id", "lang", "score"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"]
    rows = got.collect()
    held = [r for r in rows if r.lang and fold(r.doc_id, 4) == 2]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(found[i] == ("und", 0.0) for i in (9001, 9002, 9003, 9004)) and found[9005][0] == "en" and found[None][0] == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    none = langid.predict(docs, langid.train(docs, F.lit(False))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    """Lower case by code points: a final sigma, and letters whose lower case is several, are alike everywhere."""
    texts = ["ΟΔΟΣ", "οδος οδοσ", "İSTANBUL", "ΟΔΟΣ ΑΒ", "aΣ", "Straße", ""]
    alone = [b"".join(langid.stream(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[:1]).hex() for t in texts]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    codes, places, _ = langid.stream(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [codes[a:b].tobytes().hex() for a, b in zip(places[:-1], places[1:])] == alone


def test_licences(spark, corpus):
    docs, _, _ = corpus
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the APACHE license, version 2.0", "This work is licensed under the GNU General Public License, version 3.", "You need a driving license to work for the public.", "version 2 of the and the license under"]
    texts = [(i, f"some words\n\n{line}\nmore words") for i, line in enumerate(lines)] + EDGE
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), licenses.train(docs)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [(0, 2, "MIT"), (1, 2, "CC-BY-NC"), (2, 2, "Apache-2.0"), (3, 2, "GPL-3.0")]
    assert all(r.score > 0.5 and r.similarity >= licenses.CONFIRM for r in found)
    assert licenses.scan(docs.where("doc_id < 0"), licenses.train(docs.where("doc_id < 0"))).count() == 0


def test_wrapped_licences(spark, corpus):
    docs, _, _ = corpus
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:"
    texts = [
        header.format("", 3),
        "one\n\n" + header.format("", 2),
        header.format("Affero ", 3),
        header.format("Lesser ", 3),
        bsd,
        "Released\nunder\nthe\nMIT\nLicense",
        "Released under the MIT License.\n" + bsd + "\nLicensed under the Apache License, Version 2.0",
        "Released under the MIT License or the Apache License, Version 2.0",
        "Licensed under the MIT license, Apache License Version 2.0",
        bsd.replace("\n", "\n\n"),
        bsd.split("\n")[0],
        bsd.split("\n")[1],
        "Redistribution and use are permitted by\nthe following forms\nof the License",
    ]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), licenses.train(docs)).collect()
    want = [(0, 0, "GPL-3.0"), (1, 2, "GPL-2.0"), (2, 0, "AGPL-3.0"), (3, 0, "LGPL"), (4, 0, "BSD"), (5, 0, "MIT"), (6, 0, "MIT"), (6, 1, "BSD"), (6, 4, "Apache-2.0"), (7, 0, "Apache-2.0"), (7, 0, "MIT"), (8, 0, "Apache-2.0"), (8, 0, "MIT")]
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == want


def test_licence_names_tags_and_paragraphs(spark, corpus):
    """Wordings that are no template as they stand, and near misses: another licence's name, words apart, a version that is another."""
    docs, _, _ = corpus
    mit = """MIT License

Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    texts = [
        "// SPDX-License-Identifier: MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later",
        "x = 1  # SPDX-License-Identifier: Apache-2.0\ny = 2",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
        "Licensed under GPL-3.0-or-later.",
        "This code is under the BSD 3-Clause License.",
        "see the GNU Lesser General Public License for details",
        "SPDX-License-Identifier: LicenseRef-Own",
        "MIT is a school; a license to drive is something else",
        "the Apache License 1.1",
        mit,
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
        "Neither the name of Some Company nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.",
        "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at",
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    ]
    rows = [(i, t, t, f"{i}") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, paragraph string, __id string")
    found = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(frame, licenses.train(docs)).collect())
    want = [(0, 0, "MIT"), (0, 0, "MIT"), (1, 0, "GPL-2.0"), (2, 0, "Apache-2.0"), (4, 0, "GPL-3.0"), (5, 0, "BSD"), (6, 0, "LGPL")]
    want += [(10, 0, "MIT"), (10, 4, "MIT"), (10, 8, "MIT"), (10, 11, "MIT"), (11, 0, "BSL-1.0"), (12, 0, "BSD"), (13, 0, "EPL-2.0")]
    assert found == sorted(want)


def test_notices_in_a_very_long_text(spark, corpus):
    """A text of a million words gives the notice at its end, and a line of nothing but words of the licences gives none."""
    docs, _, _ = corpus
    long = "lorem ipsum " * 500_000 + "\nReleased under the MIT License.\n" + "the license of " * 20_000
    frame = spark.createDataFrame([(1, long), (2, "the " * 100_000)], "doc_id long, text string")
    found = [(r.doc_id, r.paragraph, r.family) for r in licenses.scan(frame, licenses.train(docs)).collect()]
    assert found == [(1, 1, "MIT")]


def test_stretches_are_those_of_a_walk_over_all_words():
    """Held against a walk from each pair to the end of its line, or as far as a wrapped notice reaches."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        k = int(rng.integers(len(licenses._forms)))
        own, n = sorted(licenses._form_pairs[k][1]), int(rng.integers(1, 40))
        at = np.cumsum(rng.integers(1, 4, n)).tolist()
        pairs = [own[int(x)] for x in rng.integers(0, min(len(own), int(rng.integers(1, 9))), n)]
        lines = np.sort(rng.integers(0, 4, n)).tolist()
        total, reach, i, want = len(own), 2 * len(licenses._forms[k][1]), 0, []
        while i < n:
            for ends in (lambda j: lines[j] != lines[i], lambda j: at[j] + 2 - at[i] > reach):
                stop = next((j for j in range(i, n) if ends(j)), n)
                last = max(pairs.index(x, i) for x in set(pairs[i:stop]))
                share = len(set(pairs[i:stop])) / total
                if share >= licenses._needed[k]:
                    while pairs[i] in pairs[i + 1 : last + 1]:
                        i += 1
                    want.append((at[i], at[last] + 2, share))
                    i = last
                    break
            i += 1
        assert list(licenses._stretches(k, at, pairs, lines)) == want
