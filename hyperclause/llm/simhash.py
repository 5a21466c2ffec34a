"""Near duplicates by 64-bit similarity fingerprints, joined exactly through deletion variants.

Two fingerprints that differ in two bits at most differ in one bit at most in one of their two 32-bit segments. Each
segment is indexed whole and with every single bit deleted, so that such a pair meets in an equality join, and the full
fingerprints are then compared. Only distinct fingerprints are indexed: copies cost one row. In a key that more than
SMALL fingerprints share (near copies of one text), they are indexed again by the halves of the other segment, in the
same way; and where that is crowded too, by all deletions in the other segment that the rest of the distance allows. At
that depth all that share a key are linked by definition and a star of links joins them. So a fingerprint has a bounded
number of keys and of partners in each, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_TABLE, SPACE_TABLE, fixed, text_slices, words

SEED = 42
WORDS = 3
#: Up to so many fingerprints in a key are compared pairwise; more are indexed further.
SMALL = 16


def fingerprint_bits(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints of the texts of a slice."""
    data = LOWER_TABLE[data]
    starts, ends, first = words(data, offsets, ~SPACE_TABLE[data])
    # The words of the slice with one space between: shingles are ranges of it.
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    keep = ~SPACE_TABLE[data]
    spaced = np.zeros(len(joined), bool)
    spaced[(begin + lengths)] = True
    joined[~spaced] = data[keep]
    raw, end = joined.tobytes(), begin + lengths
    count = np.diff(first)
    shingles = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    heads = np.concatenate([[0], np.cumsum(shingles)])
    order = np.arange(heads[-1]) + np.repeat(first[:-1] - heads[:-1], shingles)
    last = order + np.repeat(np.minimum(np.maximum(count, 1), WORDS) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin[order].tolist(), end[last].tolist())], np.uint64)
    out = np.zeros(len(count), np.uint64)
    for d in np.flatnonzero(shingles):
        own = hashes[heads[d] : heads[d + 1]]
        votes = np.zeros(64, np.int64)
        for k in range(0, len(own), 1 << 16):  # whole texts, in bounded pieces
            votes += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(votes * 2 > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long: the 64 bits) of every row; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_bits(data, offsets).view(np.int64))], names=["doc_id", "fp"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]))


def _half(fp: Column, segment: Column | int) -> Column:
    """The 32 bits of a segment: 0 is the upper one."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return F.when(F.lit(segment) == 0, high).otherwise(low) if isinstance(segment, int) else F.when(segment == 0, high).otherwise(low)


#: Masks of a segment: whole, and with each single bit deleted; of its halves, likewise; with each pair of bits deleted.
_ONE = [0xFFFFFFFF] + [0xFFFFFFFF & ~(1 << i) for i in range(32)]
_HALVES = [half & mask for half in (0xFFFF0000, 0x0000FFFF) for mask in [half, *(half & ~(1 << i) for i in range(32) if half >> i & 1)]]
_PAIRS = [0xFFFFFFFF & ~(1 << i) & ~(1 << j) for i in range(32) for j in range(i)]


def variants(fps: DataFrame) -> DataFrame:
    """fp, segment, place (0: whole; else the deleted bit, from 1) and part (the segment's bits that are left)."""
    masks = F.array(*[F.lit(m) for m in _ONE])
    rows = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment")).select("fp", "segment", F.posexplode(masks).alias("place", "mask"))
    return rows.select("fp", "segment", "place", _half(F.col("fp"), F.col("segment")).bitwiseAND(F.col("mask")).alias("part"))


def _met(rows: DataFrame, key: list[str], bit: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """From rows of a fingerprint fp and a key, and the value of its deleted bit (null: none) by these: the linked pairs in keys that
    up to SMALL of them share, and the rows of keys that more share. Nearly all keys have one fingerprint, and only the others
    are gathered; nor are those whose members all agree in the deleted bit, for they also share the whole segment.

    Rows are dealt out once: both the sums and the rows that are joined with them read fp and key, nothing else, from one shuffle."""
    dealt = rows.select("fp", *key).repartition(*key)
    bit = F.lit(None).cast("long") if bit is None else bit
    # The least fingerprint is asked for so that this reads the same columns where no bit is deleted.
    sums = dealt.groupBy(*key).agg(F.sum(F.lit(1) + F.coalesce(bit, F.lit(0)) * F.lit(1 << 32)).alias("s"), F.max(bit.isNotNull()).alias("deleted"), F.min("fp").alias("least"))
    n, ones = F.col("s").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("s", 32)
    shared = sums.where((n > 1) & (~F.col("deleted") | ((ones > 0) & (ones < n)))).select(*key, n.alias("n"), "least")
    met = fixed(dealt.join(shared, key).where(F.col("fp") >= F.col("least")).drop("least"))
    few = met.where(F.col("n") <= SMALL).groupBy(*key).agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    place = few.select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = place.select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2), met.where(F.col("n") > SMALL).drop("n")


def _of_key(rows: DataFrame) -> DataFrame:
    """rows with the segment and the place that their key holds."""
    return rows.withColumn("segment", F.shiftright("key", 40).cast("int")).withColumn("place", F.shiftright("key", 33).bitwiseAND(F.lit(63)).cast("int"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at two differing bits or fewer that connect exactly the fingerprints that all
    such pairs connect. fps: one column, fp, of distinct values."""
    keyed = variants(fps).select("fp", (F.col("segment") * F.lit(1 << 40) + F.col("place") * F.lit(1 << 33) + F.col("part")).alias("key"))
    segment, place = F.shiftright("key", 40), F.shiftright("key", 33).bitwiseAND(F.lit(63)).cast("int")
    value = F.when(place > 0, F.getbit(_half(F.col("fp"), segment), F.greatest(place - 1, F.lit(0))).cast("long"))
    close, many = _met(keyed, ["key"], value)
    many = _of_key(many)

    # A whole segment leaves a distance of two for the other segment, of which one half differs by one bit at most; a
    # deleted bit leaves one, and one half is equal.
    def finer(whole: list[int], deleted: list[int], frame: DataFrame) -> DataFrame:
        masks = F.when(F.col("place") == 0, F.array(*[F.lit(m) for m in whole])).otherwise(F.array(*[F.lit(m) for m in deleted]))
        frame = frame.select("fp", "key", "segment", "place", F.posexplode(masks).alias("finer", "mask"))
        return frame.withColumn("other", _half(F.col("fp"), 1 - F.col("segment")).bitwiseAND(F.col("mask"))).drop("mask")

    halves_close, crowded = _met(finer(_HALVES, [0xFFFF0000, 0x0000FFFF], many), ["key", "finer", "other"])
    # Where even these are crowded: all deletions. Those that share one are linked by definition, eight at most.
    cells = finer(_PAIRS, _ONE[1:], _of_key(crowded.select("fp", "key").distinct()))
    stars = cells.groupBy("key", "finer", "other").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    stars = stars.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a <> b")
    return close.unionByName(halves_close).unionByName(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node of the pairs (a, b), by alternating large and small stars.

    Each round hooks every node's neighbours to the least of them; the number of rounds grows with the logarithm of the
    longest chain. Edges stay distributed; the driver sees one count and one checksum a round.
    """
    edges = fixed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = fixed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(fps: DataFrame) -> DataFrame:
    """node and root of every fingerprint that is linked with another. fps: one column, fp, of distinct values."""
    # Few bytes, but each row is multiplied: spread over all tasks rather than by size.
    return components(links(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id (the least doc_id reachable over links of two differing bits or fewer) of every row.

    Texts without words, null ones included, have fingerprint 0 and are linked like others. Repeated rows each keep
    their row. Rows with a null doc_id take part in no link: component_id is null. An empty table gives no rows.
    """
    marked = fixed(fingerprints(df, doc_id, text))
    known = marked.where(F.col("doc_id").isNotNull())
    groups = fixed(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = linked(groups.select("fp"))
    placed = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(named, "root").select("fp", "component_id")
    return marked.join(ids, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
