"""Splits, ranking statistics and other aggregates of labelled, scored rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix
from .prefix import prefix_sums, ranges


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    """accuracy: the share of rows whose prediction is the label; NaN without rows."""
    return df.agg(F.coalesce(F.avg((F.col(y) == F.col(pred)).cast("int")), F.lit(float("nan"))).alias("accuracy"))


def _counted_below(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts with below: the sum of n over the lesser values of the same keys. counts: keys, value, n, a row for each value."""
    return prefix_sums(counts, keys, value, "n", ranges(F.col(value)), "below")


def rank_sums(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """keys, positives, negatives and rank_sum: twice the sum of the positives' ranks by score, ties at their average.

    Scores are counted first, so equal ones cost one row and the ordered pass runs over distinct scores, in ranges of their size: a
    running count of what lies below is all that is needed, and it is an integer."""
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("p"))
    twice = F.col("p") * (2 * F.col("below") + F.col("n") + 1)
    return _counted_below(counts, keys, score).groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"), F.sum(twice).alias("rank_sum"))


def auroc(df: DataFrame, keys: list[str], y: str, score: str, degenerate: float = 0.5) -> DataFrame:
    """keys and auroc: how likely a positive scores above a negative, ties half; `degenerate` where a class is missing."""
    p, n = F.col("positives"), F.col("negatives")
    value = (F.col("rank_sum") - p * (p + 1)) / (2 * p * n)
    return rank_sums(df, keys, y, score).select(*keys, F.when((p > 0) & (n > 0), value).otherwise(F.lit(degenerate)).alias("auroc"))


def margins(scores: DataFrame, target: int) -> DataFrame:
    """graph_id and margin: the target class's score less the best of the others."""
    own = F.max(F.when(F.col("class_id") == target, F.col("score")))
    other = F.max(F.when(F.col("class_id") != target, F.col("score")))
    return scores.groupBy("graph_id").agg((own - other).alias("margin"))


def ensemble(members: DataFrame) -> DataFrame:
    """graph_id, soft (the sum of the members' margins), soft_pred, votes and hard_pred (more than half of the members).
    members: seed, graph_id, margin."""
    votes = F.count_if(F.col("margin") > 0)
    grouped = members.groupBy("graph_id").agg(F.sum("margin").alias("soft"), votes.alias("votes"), F.count(F.lit(1)).alias("members"))
    return grouped.select("graph_id", "soft", (F.col("soft") > 0).cast("int").alias("soft_pred"), "votes", (2 * F.col("votes") > F.col("members")).cast("int").alias("hard_pred"))


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p90, p95, p99 by linear interpolation, mean and max; nulls take no part.

    Exact: values are counted, and of each key only those at the two places around a percentile are kept."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = _counted_below(counts, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__all"), (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"), F.max(value).alias("max"))
    v, at = F.col(value).cast("double"), {}
    rows = ranked.join(totals.select(*keys, "__all"), keys) if keys else ranked.join(F.broadcast(totals.select("__all")), F.lit(True))
    for q in (50, 90, 95, 99):
        place = F.lit(q / 100) * (F.col("__all") - 1)
        for name, k in ((f"l{q}", F.floor(place)), (f"h{q}", F.ceil(place))):
            at[name] = F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), v)).alias(name)
    found = rows.groupBy(*keys).agg(*at.values())
    both = found.join(totals, keys) if keys else found.join(F.broadcast(totals), F.lit(True))
    part = lambda q: F.lit(q / 100) * (F.col("__all") - 1) - F.floor(F.lit(q / 100) * (F.col("__all") - 1))
    return both.select(*keys, *[(F.col(f"l{q}") + part(q) * (F.col(f"h{q}") - F.col(f"l{q}"))).alias(f"p{q}") for q in (50, 90, 95, 99)], "mean", "max")


def rate(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """successes, total and rate; null without rows."""
    grouped = df.groupBy(*keys).agg(F.count_if(condition).alias("successes"), F.count(F.lit(1)).alias("total"))
    return grouped.withColumn("rate", F.col("successes") / F.nullif(F.col("total"), F.lit(0)))


def top_counts(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys with their counts, ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, sample and population standard deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd_sample"), F.stddev_pop(value).alias("sd_population"))


def merged(artefacts: DataFrame) -> DataFrame:
    """key and value of the last phase that has the key. artefacts: phase, key, value."""
    return artefacts.groupBy("key").agg(F.max_by("value", "phase").alias("value"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """total, positives and negatives in one row."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inverse_frequency(df: DataFrame, y: str, rows: str | None = None) -> DataFrame:
    """df with weight, one over the number of rows of its label: counted once and broadcast, one row for each label. rows: a column
    that says how many rows a row stands for."""
    counts = df.groupBy(y).agg((1.0 / (F.sum(rows) if rows else F.count(F.lit(1)))).alias("weight"))
    return df.join(F.broadcast(counts), y)


def best_epoch(history: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest epoch with the highest value, and that value. history: keys, epoch, value."""
    best = F.max_by(F.struct("epoch", "value"), F.struct("value", -F.col("epoch"))).alias("best")
    return history.groupBy(*keys).agg(best).select(*keys, "best.epoch", "best.value")


# Splits

def random_split(df: DataFrame, key: str, seed: int, train: float, valid: float) -> DataFrame:
    """df with split: the first floor(train * n) rows in hash order train, the next floor(valid * n) validate, the rest test.

    Ranks are taken in ranges of the hash, so that no task orders all rows: the rows of a range are ranked by themselves and
    start after all rows of lower ranges."""
    ranked = hash_rank(df, key, seed)
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("n")))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * valid)
    rank = F.col("rank")
    return ranked.join(n, F.lit(True)).withColumn("split", F.when(rank <= a, "train").when(rank <= a + b, "valid").otherwise("test")).drop("n", "rank")


def hash_rank(df: DataFrame, key: str, seed: int, ranges: int = 1024, by: list[str] | None = None) -> DataFrame:
    """df with rank, from 1, in the order of a hash of the key (ties by key); for each value of the columns `by` apart."""
    by = by or []
    hashed = df.withColumn("__h", mix(F.col(key), F.lit(1), seed))
    hashed = hashed.withColumn("__r", F.floor(F.col("__h") * ranges / 2147483647).cast("int"))
    counts = hashed.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row for each range
    own = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__h", key))
    placed = hashed.withColumn("__own", own)
    same = [placed[c].eqNullSafe(starts[c]) for c in by] + [placed["__r"] == starts["__r"]]
    joined = placed.join(F.broadcast(starts) if not by else starts, same)
    return joined.select(*[placed[c] for c in df.columns], (F.col("__start") + F.col("__own")).alias("rank"))


def subsample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement: those with the least hashes."""
    return df.withColumn("__h", mix(F.col(key), F.lit(1), seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified_holdout(df: DataFrame, key: str, y: str, share: float, seed: int) -> DataFrame:
    """df with held: of each class about `share` of its rows, max(1, round(share * n)) in all; what rounding leaves over comes
    from the negatives. Rounding is half to even."""
    sizes = df.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share))).cast("long").alias("want"), F.bround(F.count_if(F.col(y) == 1) * F.lit(share)).cast("long").alias("positives"))
    ranked = hash_rank(df, key, seed, by=[y])
    quota = F.when(F.col(y) == 1, F.least("positives", "want")).otherwise(F.greatest(F.lit(0), F.col("want") - F.col("positives")))
    return ranked.join(F.broadcast(sizes), F.lit(True)).withColumn("held", (F.col("rank") <= quota).cast("int")).drop("rank", "want", "positives")


def group_split(df: DataFrame, group: str, seed: int, train: float, valid: float, rows: str | None = None) -> DataFrame:
    """group and split: whole groups by descending size (ties by hash, then name) go to train while they fit, else to
    valid while they fit, else to test. rows: a column that says how many rows a row stands for.

    Groups of one size are alike: of each size a number goes to train, then a number to valid. These numbers come from one
    pass over the distinct sizes on the driver (fewer than the root of twice the rows), and a group's place among those of
    its size says where it goes."""
    sizes = df.groupBy(group).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    # The hash of a name must be alike in any engine: its first and last characters and its length.
    name = F.col(group).cast("string")
    tie = mix(F.ascii(name) * 256 + F.ascii(F.substring(name, -1, 1)), F.length(name), seed)
    runs = [(r["n"], r["m"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()]
    total = sum(n * m for n, m in runs)
    room, plan = [math.floor(total * train), math.floor(total * valid)], []
    for n, m in runs:
        taken = []
        for k in (0, 1):
            taken.append(min(m - sum(taken), room[k] // n))
            room[k] -= taken[k] * n
        plan.append((n, *taken))
    quotas = df.sparkSession.createDataFrame(plan, "n long, first long, second long")
    # Places in ranges of the tie, so that no task orders all groups of a size.
    tied = sizes.withColumn("__t", tie)
    counts = tied.groupBy("n", "__t").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy("n").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("n", "__t", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("n", "__t").orderBy(group))
    placed = tied.withColumn("__own", own).join(starts, ["n", "__t"]).join(quotas, "n")
    at = F.col("__start") + F.col("__own")
    return placed.select(group, F.when(at <= F.col("first"), "train").when(at <= F.col("first") + F.col("second"), "valid").otherwise("test").alias("split"))
