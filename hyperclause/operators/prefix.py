"""Running sums in a global order without a task that sees all rows, and without a pass beforehand to find ranges.

Rows fall into nested ranges of the ordering value, which follow from the value alone. Sums of ranges are summed upwards, running sums
come downwards: a window orders the ranges within one larger range only, and last the rows within one small range. So a window's
partition is bounded by how many parts a range has, and by how many different values lie in the smallest range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a range, for whole numbers and for the logarithm of others.
PARTS = 4096
#: Small ranges of numbers differ by about one part in so many.
FINE = 1024


def whole_ranges(value: Column) -> list[Column]:
    """Nested ranges of whole numbers: three levels, so that 10^12 numbers make some 15 of the largest."""
    return [F.floor(value / PARTS**k) for k in (3, 2, 1)]


def ranges(value: Column) -> list[Column]:
    """Nested ranges of any numbers by the logarithm of their size; what is not a number comes last."""
    v = value.cast("double")
    size = F.least(F.log1p(F.abs(v) * 1e6) * FINE, F.lit(1e15))
    fine = F.when(F.isnan(v), F.lit(1 << 60)).otherwise(F.floor(F.when(v < 0, -size).otherwise(size)))
    return [F.floor(fine / FINE), fine]


def prefix_sums(rows: DataFrame, keys: list[str], value: str, n: str, nested: list[Column], name: str) -> DataFrame:
    """rows with `name`: the sum of n over the rows of the same keys (null is a key) with a lesser value. Values of a key differ from
    row to row. nested: ranges of the value, each a part of the one before."""
    levels = [f"__range{i}" for i in range(len(nested))]
    own = rows.select("*", *[c.cast("long").alias(level) for c, level in zip(nested, levels)])
    sums = [own.groupBy(*keys, *levels).agg(F.sum(n).alias("__sum"))]
    for k in range(len(levels) - 1, 0, -1):
        sums.append(sums[-1].groupBy(*keys, *levels[:k]).agg(F.sum("__sum").alias("__sum")))
    starts = None
    for k, total in enumerate(reversed(sums)):
        before = _before("__sum", [*keys, *levels[:k]], levels[k])
        ranged = total.withColumn("__start", before).drop("__sum")
        starts = ranged if starts is None else _with_start(ranged, starts, [*keys, *levels[:k]], "__start")
    placed = own.withColumn("__start", _before(n, [*keys, *levels], value))
    return _with_start(placed, starts, [*keys, *levels], name).drop(*levels)


def _before(n: str, by: list[str], order: str) -> Column:
    # A constant beside the keys: a window without a partition would have Spark warn, and keys may be none.
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(window), F.lit(0))


def _with_start(rows: DataFrame, starts: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with their own running sum added to that of their range."""
    other = starts.select(*[F.col(c).alias(f"__same{i}") for i, c in enumerate(by)], F.col("__start").alias("__of_range"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(other[f"__same{i}"])
    joined = rows.join(other, on)
    kept = [c for c in rows.columns if c != "__start"]
    return joined.select(*[rows[c] for c in kept], (F.col("__of_range") + F.col("__start")).alias(name))
