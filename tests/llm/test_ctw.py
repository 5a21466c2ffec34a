"""Context-tree weighting against its definition, on small corpora."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyperclause.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def normal(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def model(texts):
    """The weighted probability of a bit, node by node, as the definition has it."""
    counts = Counter()
    for t in texts:
        s = b"\n" * ctw.DEPTH + normal(t)
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                node, bit = (1 << k) | s[i] >> (8 - k), s[i] >> (7 - k) & 1
                for d in range(ctw.DEPTH + 1):
                    counts[s[i - d : i], node, bit] += 1
    kids = {}
    for context, node, _ in counts:
        if context:
            kids.setdefault((context[1:], node), set()).add(context)
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(counts[context, node, 0], counts[context, node, 1])
            if len(context) < ctw.DEPTH:
                below = sum(weighted(c, node) for c in kids[context, node])
                high = max(own, below)
                total = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
                memo[context, node] = total, math.exp(own - math.log(2) - total)
            else:
                memo[context, node] = own, 1.0
        return memo[context, node][0]

    def one(history, node, d=0):
        context = history[len(history) - d :]
        a, b = counts[context, node, 0], counts[context, node, 1]
        if a + b == 0:
            return 0.5
        weighted(context, node)
        w = memo[context, node][1]
        return w * (b + 0.5) / (a + b + 1) + ((1 - w) * one(history, node, d + 1) if d < ctw.DEPTH else 0)

    def score(text):
        s, total = b"\n" * ctw.DEPTH + normal(text), 0.0
        for i in range(ctw.DEPTH, len(s)):
            for k in range(8):
                p = one(s[i - ctw.DEPTH : i], (1 << k) | s[i] >> (8 - k))
                total += math.log10(p if s[i] >> (7 - k) & 1 else 1 - p)
        return total

    return score


TEXTS = ["The cat sat on the mat.", "the cat\tate the  rat", "Ein Haus", "", None, "é à la carte", "the the the", "zzz qqq unseen words", "The cat sat on the mat.", "x" * 40, "so long " * 3000]


@pytest.mark.parametrize("broadcast", [0, 4_000_000])
@pytest.mark.parametrize("block", [16, 32 << 20])
def test_scores(spark, monkeypatch, tmp_path, broadcast, block):
    monkeypatch.setattr(ctw, "BROADCAST", broadcast)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", block)
    monkeypatch.setattr(ctw, "TASK_GRAMS", 20)
    spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, block int, key string").repartition(2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    learned = [t for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 10]
    score, words = model(learned), Counter(w for t in learned for w in normal(t).split())
    end, total = len(learned), sum(words.values()) + len(learned)
    distinct = len(words) + 1
    got = {r.doc_id: r for r in ctw.score(df, learn).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        own = [words[w] for w in normal(t).split()] + [end]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(c > 0 for c in own), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in own), rel=1e-5)
        assert got[i].score == pytest.approx(score(t), rel=1e-5)
        assert got[i].bits_per_byte == pytest.approx(-score(t) / math.log10(2) / len(normal(t)), rel=1e-5)


def test_no_rows_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert ctw.score(df.where("doc_id > 1"), F.lit(True)).count() == 0
    null = ctw.score(spark.createDataFrame([(None, "ab"), (1, "ab"), (1, "ab")], "doc_id long, text string"), F.col("doc_id").isNull()).collect()
    assert sorted(r.doc_id or 0 for r in null) == [0, 1, 1] and len({r.score for r in null}) == 1 and {r.train_tokens for r in null} == {2}
    r = ctw.score(df, F.lit(False)).first()
    assert (r.train_tokens, r.n_known) == (0, 0) and r.score == pytest.approx(24 * math.log10(0.5), rel=1e-6)
