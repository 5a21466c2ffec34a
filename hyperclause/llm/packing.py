"""Cost-balanced packing of tokenised documents into sequences of fixed length.

Each input partition is packed by itself, in groups of about GROUP_TOKENS tokens, so nothing is shuffled and no source
or group of copies can crowd a task. In a group the number of sequences is the least that holds its tokens. The cost of
a piece of n tokens is n + n * n / 2048: the linear part of a layer and the quadratic part of attention within the
piece. Documents in descending length go to the cheapest sequence with room for all of them; one longer than a sequence,
or that finds no room, is cut at the room of the cheapest sequence that has any. So a group pads one sequence's rest at
most, and the costs of its sequences stay close.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import load
from ._common import text_slices

CAPACITY = 4096
#: The length at which the quadratic part of a piece's cost equals twice its linear part.
QUADRATIC = 2048
#: A group is packed as soon as it holds so many tokens.
GROUP_TOKENS = 2 << 20

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def cost(length: int) -> float:
    return length + length * length / QUADRATIC


def assign(lengths: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) that hold every token once, and the number of sequences."""
    total = int(lengths.sum())
    count = -(-total // capacity)
    room, load = np.full(count, capacity, np.int64), np.zeros(count, np.float64)
    pieces = []

    def put(doc: int, start: int, size: int, where: int) -> None:
        pieces.append((doc, start, size, where, int(capacity - room[where])))
        room[where] -= size
        load[where] += cost(size)

    # Whole sequences of documents that fill them come first; their rests are documents like the others.
    rests, fresh = [], 0
    for doc in np.argsort(-lengths, kind="stable"):
        start, size = 0, int(lengths[doc])
        while size >= capacity:
            put(int(doc), start, capacity, fresh)
            start, size, fresh = start + capacity, size - capacity, fresh + 1
        if size:
            rests.append((-size, int(doc), start))
    heapq.heapify(rests)
    while rests:
        size, doc, start = heapq.heappop(rests)
        size = -size
        fits = np.where(room >= size, load, np.inf)
        where = int(fits.argmin())
        if fits[where] < np.inf:
            put(doc, start, size, where)
        else:  # no room for all of it: cut it, and its rest takes its turn among the documents that are left
            where = int(np.where(room > 0, load, np.inf).argmin())
            part = int(room[where])
            put(doc, start, part, where)
            heapq.heappush(rests, (part - size, doc, start + part))
    return pieces, count


def pack(df: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit;
    with_ids=False: null) and ids_crc32.

    The ids of a document are those of the vocabulary file without special tokens, then end_id. A null or empty text is
    end_id alone. Repeated rows are packed like any others; a null doc_id stays null. An empty table gives no rows.
    vocabulary: a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, group = load(vocabulary), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal group
            flat, lengths = np.concatenate(ids), np.concatenate(sizes)
            heads = np.concatenate([[0], np.cumsum(lengths)])
            pieces, count = assign(lengths, capacity)
            doc, start, size, where, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            raw = [flat[heads[d] + s : heads[d] + s + n].tobytes() for d, s, n in zip(doc, start, size)]
            key = pa.chunked_array(keys).take(pa.array(doc)).combine_chunks()
            base = (part << 40) + group
            group += count
            return pa.RecordBatch.from_arrays(
                [key, *map(pa.array, (start, size, lengths[doc], base + where, offset)), pa.array(raw if with_ids else [None] * len(raw), pa.binary()), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                names=[*PIECES.names, "ids_crc32"],
            )

        for batch, _, _ in text_slices(batches, "text"):
            column = batch.column(1)
            found, offsets = bpe.encode([x or "" for x in column.to_pylist()], end_id)
            keys.append(batch.column(0))
            ids.append(found)
            sizes.append(np.diff(offsets))
            held += len(found)
            if held >= GROUP_TOKENS:
                yield packed()
                keys, ids, sizes, held = [], [], [], 0
        if held:
            yield packed()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*PIECES.fields, T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(run, schema)
