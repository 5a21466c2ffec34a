"""Exact shard sizes, gapless slots and a uniform law."""

import math
import random
from collections import Counter

import pytest

from hyperclause.llm import sharding


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 6), (100, 300, 50), (2, 1, 2), (1, 9, 5), (1000, 10, 500), (0, 3, 2), (3, 0, 2), (4, 4, 8)])
def test_draws_follow_the_law(good, bad, draws):
    rng, n = random.Random(1), 20_000
    found = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for x in range(max(0, draws - bad), min(good, draws) + 1):
        p = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)
        assert abs(found.pop(x, 0) / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert not found


def test_matrix_has_the_sums():
    sizes, shards = [10, 0, 1, 5_000_000_000, 77], sharding.shard_sizes(5_000_000_088, 16)
    matrix = sharding.communication_matrix(sizes, shards, 5)
    assert [sum(line) for line in matrix] == sizes
    assert [sum(c) for c in zip(*matrix)] == shards


@pytest.mark.parametrize("block", [3, 50_000])
def test_every_row_has_one_place(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    rows = [(i % 40 if i % 3 else 1, None if i % 7 == 0 else "", i, "x") for i in range(203)] + [(None, None, 9, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string").repartition(5)
    got = sharding.shuffle_into_shards(df, shards=4).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r[0], r[1]) for r in rows), key=repr)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == {0, 1, 2, 3}
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(df, shards=16).collect()) == [(0, 0), (1, 0)]
    assert sharding.shuffle_into_shards(df.where("doc_id > 5"), shards=16).count() == 0


def test_each_row_reaches_each_shard(spark):
    df = spark.range(0, 64, 1, 4)
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffle_into_shards(df, shards=4, seed=seed).collect():
            seen[r.id // 16, r.shard] += 1
    assert all(25 <= seen[a, b] <= 75 for a in range(4) for b in range(4))  # 48 expected
