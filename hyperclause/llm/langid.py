"""Language identification: multinomial naive Bayes over hashed character n-grams.

Each language's n-gram counts come from a bounded random sample of its documents (DOCUMENTS of each language), one
language a task, which gets counts and no texts. The matrix of log-probabilities (languages x BUCKETS) is broadcast; its size depends on the number of
languages alone. Texts are scored whole, in batches, by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import annotated, chosen, code_points, gram_hashes, segment_sums, text_slices

BITS = 17
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: At most about so many documents of each language are learned from.
DOCUMENTS = 2000
SMOOTHING = 0.1
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case (the first code point of several), by itself."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
        lower = np.arange(0x110000, dtype=np.uint32)
        own = np.flatnonzero(_letters[0])
        lower[own] = [ord(chr(c).lower()[0]) for c in own.tolist()]
        _letters.append(lower)
    return _letters[0], _letters[1]


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with one space for each stretch of anything else, a space before each text; the texts' offsets
    in it; and how many letters each text has."""
    codes, bounds = code_points(data, offsets)
    is_letter, lower = letters()
    codes = lower[codes]
    # One place more for each text, for the space before it.
    shift = np.zeros(len(codes) + len(bounds) - 1, np.uint32)
    heads = bounds[:-1] + np.arange(len(bounds) - 1)
    inner = np.ones(len(shift), bool)
    inner[heads] = False
    shift[inner] = codes
    letter = is_letter[shift]
    letter &= inner
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first place after a letter stands for the stretch
    keep[heads] = True
    out = np.where(letter, shift, np.uint32(32))[keep]
    places = np.concatenate([[0], np.cumsum(keep)])
    ends = np.append(heads, len(shift))
    counts = np.concatenate([[0], np.cumsum(letter)])
    return out, places[ends], np.diff(counts[ends])


def grams(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in ORDERS:
        hashes, places = gram_hashes(codes, bounds, n)
        yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), places


def train(df: DataFrame, learn: Column, most: int = DOCUMENTS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their log-probabilities (languages x BUCKETS) and the logarithms of their shares. Rows that repeat
    an id count once in the sample."""
    rows = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), learn.alias("__learn"))
    rows = rows.where(F.col("__learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, most / n))]), F.col("lang"))
    sample = rows.where(chosen(F.col("__id"), share, seed)).groupBy("__id", "lang").agg(F.min("text").alias("text"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets of a language in a slice that are not empty, and their counts."""
        for batch in batches:
            for name in sorted(set(batch.column(0).to_pylist())):
                own = batch.filter(pc.equal(batch.column(0), name))
                for _, data, offsets in text_slices(iter([own])):
                    codes, bounds, _ = stream(data, offsets)
                    counts = sum(np.bincount(index, minlength=BUCKETS) for index, _ in grams(codes, bounds))
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([counts[used].tobytes()], pa.binary())], names=["lang", "used", "counts"])

    def count(table: pa.Table) -> pa.Table:
        counts = np.zeros(BUCKETS, np.float64)
        for used, own in zip(table.column("used"), table.column("counts")):
            counts[np.frombuffer(used.as_py(), np.int32)] += np.frombuffer(own.as_py(), np.int64)
        logs = np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS)).astype(np.float32)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "logs": pa.array([logs.tobytes()], pa.binary())})

    sample = sample.select("lang", "text").mapInArrow(prepare, "lang string, used binary, counts binary")
    learned = {r["lang"]: np.frombuffer(r["logs"], np.float32) for r in sample.groupBy("lang").applyInArrow(count, "lang string, logs binary").collect()}
    names = sorted(learned)
    total = sum(sizes[n] for n in names)
    return names, np.stack([learned[n] for n in names]), np.log(np.array([sizes[n] / total for n in names]))


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], carry: list[str] | None = None, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `carry` of df (doc_id by default), lang_pred and score (the posterior of lang_pred, 0 to 1; both under the names given) of every
    row; a null text, one without letters, or a model without languages gives `und` with score 0. Ties go to the language
    first in alphabetical order."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def compute(rows: int, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        names, logs, shares = held.value
        codes, bounds, known = stream(data, offsets)
        points = np.tile(shares, (rows, 1))
        for index, places in grams(codes, bounds):
            for k in range(len(names)):
                points[:, k] += segment_sums(logs[k][index], places)
        found, score = [UNDETERMINED] * rows, np.zeros(rows)
        if names:
            top, sure = points.argmax(axis=1), known > 0
            score[sure] = 1 / np.exp(points[sure] - points[sure].max(axis=1, keepdims=True)).sum(axis=1)
            found = [names[t] if s else UNDETERMINED for t, s in zip(top, sure)]
        return [pa.array(found, pa.string()), pa.array(score)]

    return annotated(df, carry or ["doc_id"], text, [T.StructField(to[0], T.StringType()), T.StructField(to[1], T.DoubleType())], compute)
