"""The learned classifiers against their definitions, feature by feature in plain Python."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.llm import langid, quality, toxicity

WORD = 1 << 64
BASE = 0x9E3779B97F4A7C15


def mixed(h):
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        h ^= h >> 32
        h = h * factor % WORD
    return h ^ h >> 32


def run_hash(run):
    return mixed((sum((v + 1) * pow(BASE, i, WORD) for i, v in enumerate(run)) + len(run)) % WORD)


def gram_hash(codes):
    h = codes[0]
    for c in codes[1:]:
        h = (h * 0x100000001B3 + c) % WORD
    return (h + len(codes)) * BASE % WORD


def grams(codes, orders):
    return [gram_hash(codes[i : i + n]) for n in orders for i in range(len(codes) - n + 1)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = "the of and to in is that für schön über mañana 漢字 good fine nice well".split()
    rows, labels = [], []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        bad = i % 3 == 0
        t += ["vile", "Fool!"] * bad + [t[-1]] * bad
        rows.append((i, " ".join(t), "de" if i % 2 else "en"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(100, "", None), (101, None, None), (102, "\n 42 ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def learnable(spark, rows, folds, held):
    ids = spark.createDataFrame([(r[0],) for r in rows], "i long").where(F.crc32(F.col("i").cast("string")) % folds != held)
    return sorted(r.i for r in ids.collect())


def test_quality(spark, corpus):
    docs, table, rows, labels = corpus

    def features(text):
        own = [run_hash(w) >> (64 - quality.BITS) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
        out = own + [int(a == b) for a, b in zip([None, *own], own)]
        return out + [h >> (64 - quality.BITS) for h in grams([ord(c) for c in text or ""], quality.ORDERS)]

    texts, y = {r[0]: r[1] for r in rows}, {x[0]: x[1] for x in labels}
    ids = learnable(spark, labels, 4, 2)
    rng = np.random.default_rng(11)
    vectors = ((rng.random((quality.BUCKETS, quality.DIMENSIONS), np.float32) - 0.5) / quality.DIMENSIONS).astype(float).tolist()
    weights, bias = [[0.0, 0.0] for _ in range(quality.DIMENSIONS)], [0.0, 0.0]
    step, steps, dims = 0, quality.EPOCHS * len(ids), range(quality.DIMENSIONS)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(ids)):
            rate, step = quality.RATE * (1 - step / steps), step + 1
            own = features(texts[ids[i]])
            share = 1 / (len(own) + quality.PRIOR)
            mean = [sum(vectors[f][d] for f in own) * share for d in dims]
            z = [sum(mean[d] * weights[d][c] for d in dims) + bias[c] for c in (0, 1)]
            p = [1 / (1 + math.exp(z[1] - z[0])), 1 / (1 + math.exp(z[0] - z[1]))]
            p[y[ids[i]]] -= 1
            back = [weights[d][0] * p[0] + weights[d][1] * p[1] for d in dims]
            for d in dims:
                for c in (0, 1):
                    weights[d][c] -= rate * 0.05 * mean[d] * p[c]
            for c in (0, 1):
                bias[c] -= rate * 0.01 * p[c]
            for f in own:
                for d in dims:
                    vectors[f][d] -= rate * 20 * share * back[d]

    def score(text):
        own = features(text)
        mean = [sum(vectors[f][d] for f in own) / (len(own) + quality.PRIOR) for d in dims]
        return 1 / (1 + math.exp(-sum(mean[d] * (weights[d][1] - weights[d][0]) for d in dims) - bias[1] + bias[0]))

    for r in quality.score(docs, quality.train(docs, table, "quality")).collect():
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=2e-3)


def test_toxicity(spark, corpus):
    docs, table, rows, labels = corpus

    def features(text):
        own = [run_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
        found = set(own)
        for d in toxicity.SKIPS:
            found |= {(a * BASE + b) * (2 * d + 1) % WORD for a, b in zip(own, own[d:])}
        return {h * 0xD6E8FEB86659FD93 % WORD >> (64 - toxicity.BITS) for h in found}

    texts, y = {r[0]: r[1] for r in rows}, {x[0]: x[2] for x in labels}
    ids, z, n = learnable(spark, labels, 3, 1), {}, {}

    def weight(k):
        if k == "bias":
            return -z.get(k, 0.0) / ((1 + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA)
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= toxicity.L1 else (math.copysign(toxicity.L1, v) - v) / ((1 + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    def score(text):
        return 1 / (1 + math.exp(-max(-35, min(35, weight("bias") + sum(map(weight, features(text)))))))

    rng = np.random.default_rng(13)
    for _ in range(toxicity.EPOCHS):
        for i in rng.permutation(len(ids)):
            g = score(texts[ids[i]]) - y[ids[i]]
            for k in [*features(texts[ids[i]]), "bias"]:
                w, before = weight(k), n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / toxicity.ALPHA * w
    got = toxicity.score(docs, toxicity.train(docs, table, "toxic")).collect()
    assert {r.score > 0.7 for r in got} == {True, False}
    for r in got:
        assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-4)


def test_language(spark, corpus):
    docs, _, rows, _ = corpus
    texts = {r[0]: (r[1], r[2]) for r in rows}
    size = langid.BUCKETS

    def buckets(text):
        runs = re.findall(r"[^\W\d_]+", (text or "").lower())
        stream = " " + "".join(x + (" " if m.end() < len(text) else "") for x, m in zip(runs, re.finditer(r"[^\W\d_]+", text or "")))
        return [h >> (64 - langid.BITS) for h in grams([ord(c) for c in stream], langid.ORDERS)] if runs else []

    learned, counts = [i for i in learnable(spark, rows, 4, 2) if texts[i][0] is not None and texts[i][1]], {}
    for i in learned:
        for b in buckets(texts[i][0]) or [h >> (64 - langid.BITS) for h in grams([32], langid.ORDERS)]:
            own = counts.setdefault(texts[i][1], {})
            own[b] = own.get(b, 0) + 1
    share = {k: sum(texts[i][1] == k for i in learned) / len(learned) for k in counts}
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    for r in langid.predict(docs, model).collect():
        own = buckets(texts[r.doc_id][0])
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {k: math.log(share[k]) + sum(math.log((c.get(b, 0) + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * size)) for b in own) for k, c in sorted(counts.items())}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)
