"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Every coordinate has its own learning rate, and the L1 penalty leaves most weights at exactly zero. The model is learned
in one task on a bounded random sample of labelled documents (SAMPLE), reduced to their features where they are read; its weights that are not zero are collected and
broadcast, BUCKETS at most. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import LOWER_TABLE, WORD_TABLE, annotated, labelled_sample, learned, run_hashes, words

BITS = 20
BUCKETS = 1 << BITS
#: Pairs of words at these distances: neighbours, and with one or two words between.
SKIPS = (1, 2, 3)
#: At most about so many labelled documents are learned from.
SAMPLE = 12_000
#: Chosen on a validation fold of the learnable rows (tests/llm/choose_settings.py).
ALPHA, BETA, L1, L2, EPOCHS = 10.0, 1.0, 10.0, 1.0, 10


def features(data: np.ndarray, offsets: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and the text of each; only those that are active, if that is given."""
    data = LOWER_TABLE[data]
    starts, ends, places = words(data, offsets, WORD_TABLE[data])
    own = run_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))
    found: list[np.ndarray] = []

    def add(hashes: np.ndarray, owners: np.ndarray) -> None:
        bucket = (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
        if active is not None:
            kept = np.flatnonzero(active[bucket.astype(np.int64)])
            bucket, owners = bucket[kept], owners[kept]
        found.append((owners.astype(np.uint64) << np.uint64(BITS)) | bucket)

    add(own, text)
    for d in SKIPS:
        same = text[d:] == text[:-d]
        add(((own[:-d] * np.uint64(0x9E3779B97F4A7C15) + own[d:]) * np.uint64(2 * d + 1))[same], text[d:][same])
    keys = np.unique(np.concatenate(found))
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int64), (keys >> np.uint64(BITS)).astype(np.int64)


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int, alpha: float = ALPHA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """The weight of each bucket, and the bias (a coordinate without penalty)."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bz = bn = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            index = texts[i]
            zi, ni = z[index], n[index]
            w, b = weight(zi, ni), -bz / ((BETA + np.sqrt(bn)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y[i]
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    return weight(z, n).astype(np.float32), float(-bz / ((BETA + np.sqrt(bn)) / alpha))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, most: int = SAMPLE, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights, and the bias; from labelled documents whose crc32(doc_id) modulo folds is not held."""
    sample = labelled_sample(documents, labels, label, folds, held, most, seed)

    def prepare(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        index, owner = features(data, offsets)
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        found = [index[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return [pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())]

    def learn(y: list[int], parts: list[pa.Array]) -> list[pa.Array]:
        weights, bias = fit([np.frombuffer(x.as_py(), np.int32) for x in parts[0]], np.array(y), seed)
        kept = np.flatnonzero(weights).astype(np.int32)
        return [pa.array([kept.tobytes()], pa.binary()), pa.array([weights[kept].tobytes()], pa.binary()), pa.array([bias])]

    found = learned(sample, prepare, learn, "buckets binary, weights binary, bias double")
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(found["buckets"], np.int32), np.frombuffer(found["weights"], np.float32), found["bias"]


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], carry: list[str] | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """The columns `carry` of df (doc_id by default) and `name`, the probability of label 1, of every row. A null text, or
    one without words, has the bias's score (0.5 from a model without labelled documents). Repeated rows keep a row each."""
    held, ready = df.sparkSession.sparkContext.broadcast(model), []

    def compute(rows: int, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        buckets, weights, bias = held.value
        if not ready:  # once in a task
            dense = np.zeros(BUCKETS, np.float32)
            dense[buckets] = weights
            ready.extend((dense, dense != 0))
        index, owner = features(data, offsets, ready[1])
        sums = np.bincount(owner, ready[0][index], minlength=rows) if len(index) else np.zeros(rows)
        return [pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -500, 500))))]

    return annotated(df, carry or ["doc_id"], text, [T.StructField(name, T.DoubleType())], compute)
