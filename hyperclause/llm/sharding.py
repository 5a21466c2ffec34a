"""A uniform shuffle into shards of exact size, by a communication matrix of hypergeometric counts.

Every row lies in a source group (the input partition that it is read from). A uniform random permutation of all rows
would send a certain number of each group's rows to each shard; those numbers follow the multivariate hypergeometric
law. They are drawn first, exactly, as a matrix of groups by shards. Then each group permutes its rows locally and deals
them out by its line of the matrix, the rows are exchanged, and each shard permutes what it got. The result is a uniform
permutation, and no step needs more than one group or one block of a shard in a task.

All work on rows is in DataFrame functions. The driver draws the matrix, whose size is bounded by SOURCE_GROUPS x shards
whatever the input.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fixed

#: At most so many source groups; beyond, several input partitions share one.
SOURCE_GROUPS = 16384
#: A shard is permuted in blocks of about so many rows.
BLOCK_ROWS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones `draws` draws without replacement give.

    Ratio-of-uniforms rejection against the density, which is exact up to the rounding of the logarithms of the gamma
    function (some 1e-16 of their values: 3e-5 in the logarithm of the density at 10^10 rows).
    """
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if draws == total:
        return good
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / total
    spread = math.sqrt(mean * (bad / total) * (total - draws) / max(1, total - 1))
    lg = math.lgamma

    def density(x: int) -> float:
        return -(lg(x + 1) + lg(good - x + 1) + lg(draws - x + 1) + lg(bad - draws + x + 1))

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    peak = density(mode)
    # A box for the ratio of uniforms that contains the whole region of a log-concave law with this spread.
    width = 2.0 * math.sqrt(2.0 / math.e) * math.sqrt(spread * spread + 0.5) + (3.0 - 2.0 * math.sqrt(3.0 / math.e))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2.0 * math.log(u) <= density(x) - peak:
            return x


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows: source groups; columns: shards; row sums and column sums as given; drawn as a uniform permutation would."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for n in sizes:
        line, rest = [], sum(left)
        for k in range(len(left)):
            rest -= left[k]
            got = hypergeometric(rng, left[k], rest, n)
            line.append(got)
            n -= got
        left = [a - b for a, b in zip(left, line)]
        matrix.append(line)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of df (all by default) with `shard` (int, from 0) and `slot` (long, gapless from 0 in its shard).

    Every row is kept, nulls, empty texts and repeated rows included; shard sizes differ by one at most. An empty table
    gives an empty result. Columns of df named shard or slot are replaced; the working columns have names that start
    with two underscores. The result is a uniform permutation of the rows, the same for the same input partitions and seed.
    """
    carry = [c for c in (carry or df.columns) if c not in ("shard", "slot")]
    # Written once: what follows reads the same rows and random keys however often it is run.
    base = fixed(
        df.select(
            *[F.col(f"`{c}`") for c in carry],
            (F.spark_partition_id() % SOURCE_GROUPS).alias("__group"),
            F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("__key"),
        )
    )
    counts = {r[0]: r[1] for r in base.groupBy("__group").count().collect()}  # one row for each source group: bounded
    groups, rows = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[g] for g in groups], shard_sizes(rows, shards), seed)
    ends = [[g, *_running(line)] for g, line in zip(groups, matrix)]
    spark = df.sparkSession
    plan = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("__line"))
        .select(F.col("__line")[0].cast("int").alias("__group"), F.slice("__line", 2, shards).alias("__ends"))
    )
    local = Window.partitionBy("__group").orderBy("__key")
    dealt = base.withColumn("__rank", F.row_number().over(local)).join(F.broadcast(plan), "__group")
    shard = F.size(F.filter("__ends", lambda end: end < F.col("__rank")))
    # Each shard's own permutation: a fresh key; its leading digits choose a block, the rest order the block.
    blocks = max(1, -(-rows // (shards * BLOCK_ROWS)))
    fresh = F.xxhash64("__key", F.lit(seed + 1))
    dealt = dealt.select(
        *[F.col(f"`{c}`") for c in carry], shard.cast("int").alias("shard"), fresh.alias("__fresh"), F.pmod(F.xxhash64("__key", F.lit(seed + 2)), F.lit(blocks)).alias("__block")
    )
    in_block = Window.partitionBy("shard", "__block").orderBy("__fresh")
    ranked = dealt.withColumn("__rank", F.row_number().over(in_block))
    # One row for each block of each shard: the blocks before it, summed.
    sizes = dealt.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = ranked.join(starts, ["shard", "__block"])
    return placed.select(*[F.col(f"`{c}`") for c in carry], "shard", (F.col("__start") + F.col("__rank") - 1).cast("long").alias("slot"))


def _running(line: list[int]) -> list[int]:
    out, at = [], 0
    for x in line:
        at += x
        out.append(at)
    return out
