"""Near copies by deletion-variant signatures at a Jaccard similarity: the near-duplicate operator for long shingles.

A text is the set of its shingles of WORDS words (lower-cased, split at white space; a shorter text is one shingle). Texts
of equal sets are one node. Candidates come from two kinds of keys, and all are verified by their exact similarity:

* The groups of `simhash`: 64-bit fingerprints of three-word shingles, segments whole or with one bit deleted, equality
  join, links at two differing bits. A group is a key of the sets of its texts.
* At a similarity of 0.8 some ten of 64 bits differ, where unrelated texts meet too (a bit agrees with about
  1 - acos(2s / (1 + s)) / pi), so no segment of a useful length would find those. For them each segment of a second
  signature is indexed with every single place deleted, in the same way; its places hold min-hashes, of which two sets of
  similarity s agree in a share of s. Of SEGMENTS segments of PLACES min-hashes one has a difference at most with
  probability 1 - (1 - s^PLACES - PLACES s^(PLACES - 1) (1 - s))^SEGMENTS: 0.9996 at 0.8, more above.

In a key that up to SMALL sets share all pairs are candidates. In a crowded one the candidates are the pairs with its
centre, the set that shares the most crowded keys with others. All candidates are verified by their exact similarity. Then
the sets of a crowded key that these links don't connect to most of the others there (few, in a group of near copies) are
compared with all of them: so the groups are those that all pairs of sets with a common key give. Of these pairs only
those are made whose similarity can reach the threshold: in a bit map of the parity of a set's shingles in each of 1024
classes, two sets differ in no more bits than shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_TABLE, SPACE_TABLE, annotated, fixed, mixed, ragged, run_hashes, text_slices, words
from .simhash import components, fingerprint_bits, linked

WORDS, SIMILARITY = 5, 0.8
SEGMENTS, PLACES = 9, 7
#: Longs in a map of parities.
PARITIES = 16
#: Up to so many sets in a key are compared pairwise.
SMALL = 16
SEED = 29

_rng = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_rng.integers(0, 1 << 63, SEGMENTS * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the texts as 64-bit hashes, ascending in each text, and each text's place among them."""
    data = LOWER_TABLE[data]
    starts, ends, first = words(data, offsets, ~SPACE_TABLE[data])
    own, count = run_hashes(data, starts, ends), np.diff(first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), shingles)
    at, size = ragged(first[:-1], shingles), np.minimum(count, width)[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < size
        h = np.where(inside, mixed(h + own[np.minimum(at + k, max(len(own) - 1, 0))]) if len(own) else h, h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[fresh], np.searchsorted(text[fresh], np.arange(len(count) + 1))


def set_ids(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each set; the empty set has 0."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed(h), out=sums[1:])
    n = np.diff(places).astype(np.uint64)
    return np.where(n > 0, mixed(sums[places[1:]] - sums[places[:-1]] + n), np.uint64(0))


def variants(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The keys of each set that is not empty: a row of its segments, each with every single place deleted."""
    starts = places[:-1][np.diff(places) > 0]
    out = np.zeros((len(starts), SEGMENTS * PLACES), np.uint64)
    if len(starts):
        for k in range(0, SEGMENTS * PLACES, PLACES):
            for i in range(k, k + PLACES):
                out[:, i] = mixed(np.minimum.reduceat(h * _FACTORS[i] + _TERMS[i], starts) + _TERMS[i])
            whole = out[:, k : k + PLACES].sum(axis=1, dtype=np.uint64)
            for i in range(k, k + PLACES):
                out[:, i] = mixed(whole - out[:, i] + _FACTORS[i])
    return out


def parities(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each set, the parity of the number of its shingles in each class: a row of PARITIES longs."""
    bits, out = 64 * PARITIES, []
    for a in range(0, len(places) - 1, 512):
        cuts = places[a : a + 513]
        owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        own = mixed(h[cuts[0] : cuts[-1]]) % np.uint64(bits)
        odd = np.bincount(owner * bits + own.astype(np.int64), minlength=(len(cuts) - 1) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, PARITIES), np.int64)


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _marked(df: DataFrame, width: int) -> DataFrame:
    """doc_id, set, n (its shingles), keys, odd (its parities) and fp (its fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            h, places = shingle_sets(data, offsets, width)
            n = np.diff(places)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, SEGMENTS * PLACES, 0))])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(variants(h, places).reshape(-1).view(np.int64)))
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARITIES, pa.int32()), pa.array(parities(h, places).reshape(-1)))
            fp = pa.array(fingerprint_bits(data, offsets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_ids(h, places).view(np.int64)), pa.array(n, pa.int64()), keys, odd, fp], names=["doc_id", "set", "n", "keys", "odd", "fp"])

    return df.mapInArrow(run, "doc_id long, set long, n long, keys array<long>, odd array<long>, fp long")


def _alike(marked: DataFrame) -> DataFrame:
    """set, n and key: a key for each group of fingerprints, linked as `simhash` links them, of the texts of a set."""
    told = fixed(marked.where("doc_id is not null and n > 0").select("set", "n", "fp").distinct())
    groups = linked(told.select("fp").distinct()).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint"))
    return fixed(told.join(groups, "fp", "left").select("set", "n", key.alias("key")).distinct())


def _shingles(df: DataFrame, width: int) -> DataFrame:
    """set and shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            h, places = shingle_sets(data, offsets, width)
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(h, places).view(np.int64)), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(h.view(np.int64)))], names=["set", "shingles"])

    return df.mapInArrow(run, "set long, shingles array<long>")


def _close(a: Column, b: Column, similarity: float) -> Column:
    """Whether two structs of set and n are different sets whose sizes allow the similarity."""
    return (a["set"] != b["set"]) & (F.least(a["n"], b["n"]) >= F.lit(similarity) * F.greatest(a["n"], b["n"]))


def _ordered(frame: DataFrame) -> DataFrame:
    """Pairs of sets (a, b), the lesser first, from structs."""
    return frame.select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b"))


def _met(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows of key, set and n: candidate pairs of keys that up to SMALL sets share, those of each set with the centre
    of a key that more share, and the rows of these. Sizes too far apart for the similarity are no candidates."""
    shared = fixed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = fixed(rows.join(shared, "key"))
    few = met.where(F.col("c") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("set", "n"))).alias("sets"))
    place = few.select("sets", F.posexplode("sets").alias("i", "a"))
    pairs = place.select("a", F.explode(F.slice("sets", F.col("i") + 2, F.lit(SMALL))).alias("b"))
    many = met.where(F.col("c") > SMALL)
    ranked = many.join(many.groupBy("set").agg(F.sum("c").alias("shares")), "set")
    centres = ranked.groupBy("key").agg(F.max(F.struct("shares", "set", "n")).alias("a"))
    stars = many.join(centres, "key").select(F.struct("a.set", "a.n").alias("a"), F.struct("set", "n").alias("b"))
    near = _close(F.col("a"), F.col("b"), similarity)
    return _ordered(pairs.where(near)), _ordered(stars.where(near)), many.select("key", "set", "n")


def _verified(candidates: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The candidates that are links. known: set and shingles."""
    both = candidates.join(known.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").join(known.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return fixed(both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _left_over(crowded: DataFrame, roots: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Candidates of the sets of a crowded key outside the group of most sets there, with all sets of other groups there."""
    placed = fixed(crowded.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    most = placed.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("m"), F.count(F.lit(1)).alias("groups"))
    mixed_keys = most.where("groups > 1").select("key", F.col("m.root").alias("most"))
    rows = fixed(placed.join(mixed_keys, "key").join(groups.select("set", "odd"), "set").select("key", "most", "root", F.struct("set", "n", "odd").alias("one")))
    outside = rows.where("root <> most").select("key", F.col("root").alias("own"), F.col("one").alias("a"))
    a, b = F.col("a"), F.col("b")
    differ = sum((F.bit_count(a["odd"][k].bitwiseXOR(b["odd"][k])) for k in range(PARITIES)), F.lit(0))
    both = outside.join(rows.select(F.col("key").alias("same"), "root", F.col("one").alias("b")), (F.col("key") == F.col("same")) & (F.col("own") != F.col("root")) & _close(a, b, similarity) & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (a["n"] + b["n"])))
    return fixed(_ordered(both).distinct())


def with_set(df: DataFrame, name: str, text: str = "text", width: int = WORDS) -> DataFrame:
    """df with `name`, the number of each row's set of shingles."""

    def compute(rows: int, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(set_ids(*shingle_sets(data, offsets, width)).view(np.int64))]

    return annotated(df, df.columns, text, [T.StructField(name, T.LongType())], compute)


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, similarity: float = SIMILARITY, rows: bool = False) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable over links of at least this similarity) of every row. rows: also the set
    of its text, and root, which all rows of a group share and no others (groups may share a doc_id that has several rows).

    Texts without words, null ones included, are copies of each other. Repeated rows each keep their row. Rows with a null
    doc_id take part in no link: component_id is null. An empty table gives no rows.
    """
    texts = _rows(df, doc_id, text)
    marked = fixed(_marked(texts, width))
    groups = fixed(marked.where("doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("least"), *[F.first(x).alias(x) for x in ("n", "keys", "odd")]))
    pairs, stars, crowded = _met(groups.select("set", "n", F.explode("keys").alias("key")).unionByName(_alike(marked)), similarity)
    candidates = fixed(pairs.unionByName(stars).distinct())
    crowded = fixed(crowded)
    nodes = candidates.select(F.col("a").alias("set")).unionByName(candidates.select(F.col("b").alias("set"))).unionByName(crowded.select("set")).distinct()
    wanted = groups.join(nodes, "set", "left_semi").select(F.col("least").alias("doc_id"))
    known = fixed(_shingles(texts.join(wanted.distinct(), "doc_id", "left_semi"), width).dropDuplicates(["set"]))
    links = _verified(candidates, known, similarity)
    roots = components(links)
    more = _verified(_left_over(crowded, roots, groups, similarity), known, similarity)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    placed = groups.select("set", "least").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(named, "root").select("set", "root", "component_id")
    known_id = F.col("doc_id").isNotNull()
    found = marked.select("doc_id", "set").join(ids, "set", "left").select("doc_id", F.when(known_id, F.col("component_id")).alias("component_id"), "set", F.when(known_id, F.col("root")).alias("root"))
    return found if rows else found.drop("set", "root")
