"""Exact search against sorting all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hyperclause.llm import topk


def expected(rows, k, every):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        kept[i] = min(kept.get(i, q), q)
    out = set()
    for q in kept:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(kept[q], kept[c])), c) for c in kept if c != q)[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block,merge", [(7, 2), (16384, 8)])
def test_matches_sorting(spark, monkeypatch, block, merge):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "MERGE", merge)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.9]) for _ in range(6)]) for i in range(-20, 80)]
    rows += [(i, rows[5][1]) for i in range(100, 130)]  # one vector many times: ties
    rows += [(3, rows[23][1]), (4, [9.0] * 6), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, ids string").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=4)
    assert {tuple(r) for r in got.collect()} == expected(rows, 4, 5)


def test_lengths_far_apart(spark, monkeypatch):
    """Vectors of any length; a very long one has a block of its own."""
    monkeypatch.setattr(topk, "WIDTH", 4)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 33]))]) for i in range(60)] + [(60, [0.5] * 20_000), (61, [0.25] * 30_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=3).collect()} == expected(exact, 3, 5)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.where("vec_id > 5"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**21 + i), float(-(2**20)) + i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=3).collect()} == expected(rows, 3, 5)
