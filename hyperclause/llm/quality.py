"""Text quality by supervised subword embeddings.

Words and character n-grams are hashed to vectors, and so is whether a word repeats the one before; a document is the
average of its vectors, drawn towards zero where it has few; a softmax over it gives the class. Vectors and output weights
are learned together by stochastic gradient descent in numpy, on a bounded random sample of labelled documents (SAMPLE),
which are reduced to their features where they are read. As the output is linear in the vectors, scoring needs each
bucket's projection alone: a table of BUCKETS numbers, which is broadcast. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import SPACE_TABLE, annotated, code_points, gram_hashes, labelled_sample, learned, run_hashes, segment_sums, words

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (2, 3)
DIMENSIONS = 8
#: At most about so many labelled documents are learned from.
SAMPLE = 6000
#: These and PRIOR were chosen on a validation fold of the learnable rows (tests/llm/choose_settings.py).
EPOCHS, RATE = 10, 8.0
#: A document's sum of vectors is divided by its number of features and so many more.
PRIOR = 30


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words, of their repeats (0: no, 1: yes) and of the n-grams of characters, with each text's place among them."""
    starts, ends, places = words(data, offsets, ~SPACE_TABLE[data])
    buckets = (run_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    yield buckets, places
    repeats = np.zeros(len(buckets), np.int64)
    repeats[1:] = buckets[1:] == buckets[:-1]
    repeats[places[:-1][np.diff(places) > 0]] = 0  # a text's first word has none before it
    yield repeats, places
    codes, bounds = code_points(data, offsets)
    for n in ORDERS:
        hashes, places = gram_hashes(codes, bounds, n)
        yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), places


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and how often it has them."""
    parts = list(features(data, offsets))
    for d in range(len(offsets) - 1):
        index, count = np.unique(np.concatenate([index[p[d] : p[d + 1]] for index, p in parts]), return_counts=True)
        yield index.astype(np.int32), count.astype(np.int32)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int, epochs: int = EPOCHS, start: float = RATE, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """The projection of each bucket on the difference of the two classes, and the bias. texts: distinct buckets and how
    often each text has them."""
    texts = [(index, (n / (n.sum() + prior)).astype(np.float32)) for index, n in texts]
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            rate = np.float32(start * (1 - step / steps))
            step += 1
            index, share = texts[i]
            if not len(index):
                continue
            own = vectors[index]
            mean = share @ own
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= rate * 0.05 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            vectors[index] = own - (rate * 20) * share[:, None] * back
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, most: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, float]:
    """Learned from labelled documents whose crc32(doc_id) modulo folds is not held; without any, every score is 0.5."""
    sample = labelled_sample(documents, labels, label, folds, held, most, seed)

    def prepare(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        index, count = zip(*counted(data, offsets))
        return [pa.array([x.tobytes() for x in part], pa.binary()) for part in (index, count)]

    def learn(y: list[int], parts: list[pa.Array]) -> list[pa.Array]:
        index, count = ([np.frombuffer(x.as_py(), np.int32) for x in part] for part in parts)
        projection, bias = fit(list(zip(index, count)), np.array(y), seed)
        return [pa.array([projection.tobytes()], pa.binary()), pa.array([bias])]

    found = learned(sample, prepare, learn, "projection binary, bias double")
    if not found:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found["projection"], np.float32), found["bias"]


def score(df: DataFrame, model: tuple[np.ndarray, float], carry: list[str] | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """The columns `carry` of df (doc_id by default) and `name`, the probability of label 1, of every row. A null or empty
    text has no features: its score is the bias's. Repeated rows keep a row each."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def compute(rows: int, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        projection, bias = held.value
        sums, counts = np.zeros(rows), np.zeros(rows)
        for index, places in features(data, offsets):
            sums += segment_sums(projection[index], places)
            counts += np.diff(places)
        logit = np.clip(sums / (counts + PRIOR) + bias, -500, 500)
        return [pa.array(1 / (1 + np.exp(-logit)))]

    return annotated(df, carry or ["doc_id"], text, [T.StructField(name, T.DoubleType())], compute)
