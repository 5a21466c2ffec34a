"""Helpers that the operators of this subpackage share: shared folders, Arrow text buffers and vectorised word splitting."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is worked on in slices of whole documents of about this many bytes; one longer document is a slice by itself.
SLICE_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte tables: A-Z to lower case, and the separators 0x20 and 0x09 to 0x0D.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words without their punctuation: digits, letters, and everything beyond ASCII.
WORD_TABLE = np.zeros(256, dtype=bool)
WORD_TABLE[48:58] = WORD_TABLE[65:91] = WORD_TABLE[97:123] = WORD_TABLE[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or else the one that the session was given by setCheckpointDir. Without
    either, a temporary folder where all runs in one process, and an error on a cluster, whose executors would not share it."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that its lineage ends and executors may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string")) % F.lit(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets, counted from 0; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices: its rows, the bytes of their texts, and the offsets of the texts in these bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which `inside` holds, which never span two documents, and each
    document's place among the runs (one more entry than documents)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    glued = np.unique(cut[inside[cut] & inside[cut - 1]])
    at = np.flatnonzero(edge)
    if len(glued):  # a run ends and another begins there
        at = np.sort(np.concatenate([at, glued, glued]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values, from prefix sums of a polynomial: equal runs get equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds (one more bound than sums); empty segments give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several ranges one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Unicode code points of the texts, and the offsets of the texts in them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return codes, heads[offsets]


def gram_hashes(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of code points that lie inside a text, and each text's place among them."""
    total = len(codes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = codes[:total].astype(np.uint64)
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + codes[k : k + total]
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if bounds[-1] != total:
        h = h[ragged(offsets[:-1], sizes)]
    return (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15), bounds


def sample_share(rows: int, most: int) -> float:
    """The share of rows that a sample of about `most` rows takes."""
    return min(1.0, most / rows) if rows else 1.0


def chosen(key: Column, share: Column | float, seed: int) -> Column:
    """Whether a row is in a random sample with this share: the same rows for the same key and seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(share) * 1_000_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, y (0 or 1) and text of about `most` labelled documents outside the held-out fold, chosen at random by id.

    Of several labels of a document the largest counts; null labels and ids take no part. The chosen ids are bounded by
    `most`, so they are broadcast. A document of several rows has as many here."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("__id").isNotNull())
    known = known.where(remainder(F.col("__id"), folds) != held)
    share = sample_share(known.count(), most)
    ids = known.where(chosen(F.col("__id"), share, seed)).groupBy("__id").agg(F.max("y").alias("y"))
    texts = documents.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "__id").select("__id", "y", "text")


def learned(sample: DataFrame, prepare: Callable[[np.ndarray, np.ndarray], list[pa.Array]], learn: Callable[[list[int], list[pa.Array]], list[pa.Array]], made: str) -> Row | None:
    """What `learn` makes of a labelled sample in one task; nothing of an empty one.

    `prepare` turns the texts of a slice into two binary columns (a text's features), where the texts are read; a document
    of several rows counts once (its least features). `learn` gets the labels and these columns in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *prepare(data, offsets)], names=["__id", "y", "a", "b"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("__id")  # the same order whatever the partitioning
        return pa.table(learn(table.column("y").to_pylist(), [table.column("a"), table.column("b")]), names=[x.split()[0] for x in made.split(", ")])

    kind = sample.schema["__id"].dataType.simpleString()
    rows = sample.select("__id", "y", "text").mapInArrow(run, f"__id {kind}, y int, a binary, b binary")
    once = rows.groupBy("__id").agg(F.min(F.struct("y", "a", "b")).alias("one")).select("__id", "one.*", F.lit(0).alias("__all"))
    return once.groupBy("__all").applyInArrow(fit, made).first()


def unused(columns: list[str], *names: str) -> list[str]:
    """These names, each with as many underscores behind it as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"{n}_" for n in names)
    return list(names)


def annotated(df: DataFrame, carry: list[str], text: str, fields: list[T.StructField], compute: Callable[[int, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """The columns `carry` of df, and `fields` computed from the bytes of the texts (rows, bytes, offsets) slice by slice.

    A carried column that is named like a field, in any case, gives way to it."""
    schema = df.schema
    fresh = {f.name.lower() for f in fields}
    kept = [c for c in carry if c.lower() not in fresh]
    sent = [column(c).alias(f"c{i}") for i, c in enumerate(kept)]
    place = kept.index(text) if text in kept and isinstance(schema[text].dataType, T.StringType) else len(kept)
    if place == len(kept):
        sent.append(column(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(place))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                made = compute(b - a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=names)

    names = [f"c{i}" for i in range(len(kept))] + [f"f{i}" for i in range(len(fields))]
    made = T.StructType([*[T.StructField(n, schema[c].dataType) for n, c in zip(names, kept)], *[T.StructField(n, f.dataType) for n, f in zip(names[len(kept) :], fields)]])
    return df.select(*sent).mapInArrow(run, made).toDF(*kept, *[f.name for f in fields])
