"""Exact top-k search by inner product: tiled matrix products and a tree of merges.

Vectors of like length are packed into blocks of bounded size, in the least integers that hold them; so one very long
vector widens its own block alone. A tile is one block of queries against one block of candidates: one
matrix product, of which each query keeps its best k. The lists of a block of queries are then merged in rounds of
MERGE lists each, so that no task ever holds more than MERGE lists for a block. The queries are a stated set, taken in
blocks; no pair of rows is ever materialised outside a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fixed

#: Rows of a block of vectors of up to WIDTH components; blocks of longer ones have fewer.
QUERY_BLOCK, CANDIDATE_BLOCK, WIDTH = 16384, 16384, 512
MERGE = 8


def quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for vectors without null or non-finite components.

    Of rows that share a vec_id the least vector stays. Null ids take no part."""
    x = F.col(f"`{embedding}`")
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull()).where(whole)
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(blob: bytes, kind: str, ids: bytes) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(len(ids) // 8, -1)


def _least_kind(m: np.ndarray) -> str:
    """The least integer type that holds all of m."""
    low, high = m.min(initial=0), m.max(initial=0)
    return next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """The places of the k highest scores, in order, ties to smaller ids; the id `own` is left out. ids ascend."""
    n = len(scores)
    m = min(n, k + 1)  # the own row may be among the best
    kept = np.arange(n)
    if m < n:
        edge = np.partition(scores, n - m)[n - m]
        above, level = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        kept = np.concatenate([above, level[: m - len(above)]])
    kept = kept[ids[kept] != own]
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def largest(m: np.ndarray) -> float:
    """The largest absolute value."""
    return max(-float(m.min(initial=0)), float(m.max(initial=0)))


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can leave its exact range."""
    width = min(q.shape[1], c.shape[1])  # what one lacks counts as zero
    q, c = q[:, :width], c[:, :width]
    most = max(1, width) * largest(q) * largest(c)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


PACKED = "block int, ids binary, kind string, vectors binary"
#: Lists of a block of queries against some candidates: k places a query, of which `used` hold something.
LISTS = "q int, c int, ids binary, used binary, best binary, scores binary"


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best candidates among all other vectors, exactly.

    is_query: a condition on the column vec_id. Components are floor(scale * x); the score is their inner product; ties go
    to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part. Repeated rows count
    once. Missing components of shorter vectors count as zero. Fewer candidates than k: all. Empty table: no rows.
    """
    rows = fixed(quantised(df, vec_id, embedding, scale))
    # Lengths by powers of two, each with its own blocks: a row for each of some 30 classes.
    rows = rows.withColumn("class", F.greatest(F.ceil(F.log2(F.greatest(F.size("v"), F.lit(1)).cast("double"))).cast("int"), F.lit(int(np.log2(WIDTH)))))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries")).orderBy("class").collect()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = np.zeros((len(pdf), pdf["v"].map(len).max()), np.int64)
        for i, v in enumerate(pdf["v"]):
            m[i, : len(v)] = v
        kind = _least_kind(m)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "kind": [kind], "vectors": [m.astype(kind).tobytes()]})

    def packed(frame: DataFrame, found: list[tuple[int, int]], most: int) -> tuple[DataFrame, int]:
        """The frame's blocks and their number."""
        block, before = F.lit(None).cast("int"), 0
        for power, n in found:
            count = -(-n // max(1, most * WIDTH >> power))
            if count:
                block = F.when(F.col("class") == power, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int") + before).otherwise(block)
                before += count
        return frame.withColumn("block", block).groupBy("block").applyInPandas(pack, PACKED), max(1, before)

    asked, blocks = packed(rows.where(is_query), [(r["class"], r["queries"]) for r in sizes], QUERY_BLOCK)
    held, shards = packed(rows, [(r["class"], r["n"]) for r in sizes], CANDIDATE_BLOCK)

    def sent(frame: DataFrame, own: str, other: str, count: int) -> DataFrame:
        """Each block to the tiles of its line."""
        return frame.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumnRenamed("block", own)

    def multiply(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({name.split()[0]: [] for name in LISTS.split(", ")})
        a, b = asked.iloc[0], held.iloc[0]
        own, ids = np.frombuffer(a["ids"], np.int64), np.frombuffer(b["ids"], np.int64)
        q, c = (_matrix(x["vectors"], x["kind"], x["ids"]) for x in (a, b))
        used, found, scores = np.zeros(len(own), np.int64), np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64)
        for strip in range(0, len(own), 256):  # a tile's product is held in strips
            for i, line in enumerate(product(q[strip : strip + 256], c), strip):
                kept = best(line, ids, own[i], k)
                used[i], found[i, : len(kept)], scores[i, : len(kept)] = len(kept), ids[kept], line[kept]
        return _lists(a["q"], b["c"], a["ids"], used, found, scores)

    def merged(pdf: pd.DataFrame) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        used = np.stack([np.frombuffer(x, np.int64) for x in pdf["used"]])
        found, scores = (np.stack([np.frombuffer(x, np.int64).reshape(-1, k) for x in pdf[name]]) for name in ("best", "scores"))
        unused = np.concatenate(list(np.arange(k) >= used[:, :, None]), axis=1)
        found, scores = np.concatenate(list(found), axis=1), np.concatenate(list(scores), axis=1)
        order = np.lexsort((found, -scores, unused), axis=1)[:, :k]
        return pdf["ids"].iloc[0], np.minimum(k, used.sum(axis=0)), np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _lists(pdf["q"].iloc[0], pdf["c"].iloc[0] // MERGE, *merged(pdf))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, used, found, scores = merged(pdf)
        line, place = np.nonzero(np.arange(k) < used[:, None])
        return pd.DataFrame({"query_id": np.frombuffer(ids, np.int64)[line], "rank": (place + 1).astype(np.int32), "vec_id": found[line, place], "score": scores[line, place]})

    asked, held = sent(asked, "q", "c", shards), sent(held, "c", "q", blocks)
    lists = asked.groupBy("q", "c").cogroup(held.groupBy("q", "c")).applyInPandas(multiply, LISTS)
    left = shards
    while left > MERGE:
        lists = lists.groupBy("q", F.floor(F.col("c") / MERGE)).applyInPandas(merge, LISTS)
        left = -(-left // MERGE)
    return lists.groupBy("q").applyInPandas(finish, "query_id long, rank int, vec_id long, score long")


def _lists(q: int, c: int, ids: bytes, used: np.ndarray, found: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q": [int(q)], "c": [int(c)], "ids": [ids], "used": [used.tobytes()], "best": [found.tobytes()], "scores": [scores.tobytes()]})
