"""Near copies against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.llm import near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(docs):
    sets, parent = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("small", [3, 16])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for size in (6, 12, 60, 120, 200):
        base = [rng.choice(words) for _ in range(size)]
        for k in range(24):
            w = list(base)
            for _ in range(rng.randrange(1 + size // 40)):
                w[rng.randrange(len(w))] = "other"
            docs.append((len(docs) * 3, " ".join([*w, "more"] if k % 3 else w)))
    docs += [(1001, None), (1002, " "), (1003, "one two"), (1004, "One\ttwo"), (1005, "one two three")]
    rows = spark.createDataFrame([*docs, docs[7], (None, docs[7][1])], "doc_id long, text string").repartition(3)
    got = near_copies.near_copies(rows).collect()
    want = components(docs)
    assert len(got) == len(docs) + 2 and sum(r.doc_id is None and r.component_id is None for r in got) == 1
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert near_copies.near_copies(rows.where(F.lit(False))).count() == 0


def test_recall_at_the_least_similarity(spark):
    """One changed stretch in each text, so that the similarity is just over 0.8."""
    rng = random.Random(6)
    docs = []
    for k in range(300):
        w = [f"{k}x{rng.randrange(10**6)}" for _ in range(104)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:50], *(f"n{i}" for i in range(7)), *w[57:]]))]
    assert 0.8 <= len(shingles(docs[0][1]) & shingles(docs[1][1])) / len(shingles(docs[0][1]) | shingles(docs[1][1])) < 0.81
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 298


def test_fingerprints_find_what_min_hashes_miss(spark):
    """Texts at a similarity of 0.81 that share no key of min-hashes, but a fingerprint: a phrase that is repeated decides its bits."""
    r = random.Random(6076)
    word = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    cycle, shared = " ".join(word(7) * 300), word(86)
    texts = [" ".join([cycle, *shared, *own]) for own in (word(11), word(11))]
    other = " ".join([cycle, *word(97)])  # the same fingerprint, but not similar
    for small in texts:
        assert 0.8 <= len(shingles(small) & shingles(texts[0])) / len(shingles(small) | shingles(texts[0]))
    found = simhash.fingerprints(spark.createDataFrame([*enumerate(texts), (2, other)], "doc_id long, text string")).collect()
    assert len({row.fp for row in found}) == 1
    raw = [t.encode() for t in texts]
    keys = near_copies.variants(*near_copies.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5))
    assert not set(keys[0]) & set(keys[1])
    got = near_copies.near_copies(spark.createDataFrame([(5, texts[0]), (9, texts[1]), (3, other)], "doc_id long, text string")).collect()
    assert {row.doc_id: row.component_id for row in got} == {5: 5, 9: 5, 3: 3}
