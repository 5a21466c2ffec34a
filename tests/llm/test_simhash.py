"""Near-duplicate fingerprints against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from hyperclause.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    """Each value's component over distances of two or fewer, by comparing all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("small", [1, 2, 8])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small)
    values = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        for _ in range(12):
            v = seed
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.choice([rng.randrange(64), 3, 40])
            values.add(v)
    values |= {0, 1 << 63, (1 << 64) - 1}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    want = roots(sorted(values))
    groups = {}
    for s, v in signed.items():
        groups.setdefault(want[v], set()).add(s)
    for members in groups.values():
        assert {got.get(s, s) for s in members} == {min(members)}


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(300)]
    near = [*base]
    near[17] = "changed"
    texts = [" ".join(base), "\t".join(base).upper(), " ".join(near), "", None, " \n", "one two", "One  TWO", "é È x y z", "x " * 5000, "x " * 5000, " ".join(reversed(base))]
    rows = [(i * 3, t, "extra") for i, t in enumerate(texts)] + [(0, texts[0], "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i * 3: fingerprint(t) for i, t in enumerate(texts)}
    want = roots(sorted(set(fps.values())))
    for r in got:
        assert r.fp % (1 << 64) == fps[r.doc_id]
        assert r.component_id == min(d for d, f in fps.items() if want[f] == want[fps[r.doc_id]])


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(0, None), (2, 2), (5, 2)]
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_rows_are_dealt_out_once(spark, monkeypatch):
    """The sums of keys and the rows that are joined with them read one shuffle."""
    plans = []

    def noted(df):
        out = df.checkpoint()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(simhash, "fixed", noted)
    fps = spark.range(300).select((F.xxhash64("id")).alias("fp"))
    simhash.links(fps.repartition(3)).count()
    assert "ReusedExchange" in plans[0].split("Initial Plan")[0]
