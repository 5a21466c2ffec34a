"""Running sums by nested ranges, held against one sorted pass."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hyperclause.operators.prefix import prefix_sums, ranges, whole_ranges


def plain(rows):
    out = []
    for key, value, n in rows:
        order = lambda v: (math.isnan(v), v) if isinstance(v, float) else (False, v)
        out.append((key, value, sum(m for k, v, m in rows if k == key and order(v) < order(value))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_equals_a_sorted_pass(spark, kind):
    r = random.Random(3)
    if kind == "double":
        values = [0.0, -0.5, 1e-300, -1e300, math.inf, -math.inf, math.nan, 1e-7, -1e-7] + [r.gauss(0, 1) for _ in range(150)] + [0.5 + k * 1e-12 for k in range(50)]
    else:
        values = [0, -1, 2**62, -(2**62), 4096, 4095] + [r.randrange(-(10**9), 10**9) for _ in range(150)] + list(range(50))
    rows = [(key, v, r.randrange(1, 9)) for key in ("a", None, "b") for v in set(values)]
    df = spark.createDataFrame(rows, f"k string, v {kind}, n long").repartition(4)
    found = prefix_sums(df, ["k"], "v", "n", (ranges if kind == "double" else whole_ranges)(F.col("v")), "below")
    assert repr(sorted(((x.k, x.v, x.below) for x in found.collect()), key=repr)) == repr(plain(rows))


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(v, 2) for v in (5, 3, 9000)], "v long, n long")
    assert {(x.v, x.below) for x in prefix_sums(df, [], "v", "n", whole_ranges(F.col("v")), "below").collect()} == {(3, 0), (5, 2), (9000, 4)}
    assert prefix_sums(df.limit(0), [], "v", "n", ranges(F.col("v")), "below").count() == 0


def test_ranges_nest_and_keep_the_order():
    """Larger numbers never fall in lesser ranges, and a small range lies in one large one."""
    from hyperclause.operators import prefix

    r = random.Random(5)
    values = sorted([r.uniform(-3, 3) * 10 ** r.randrange(-8, 9) for _ in range(2000)])
    size = lambda v: min(math.log1p(abs(v) * 1e6) * prefix.FINE, 1e15)
    fine = [math.floor(-size(v) if v < 0 else size(v)) for v in values]
    assert fine == sorted(fine) and len(set(fine)) > 1000
