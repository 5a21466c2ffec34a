"""An arithmetic hash that any SQL engine computes alike: two rounds of a linear congruence modulo a prime.

The same text serves both: on columns, and as SQL. All values stay within 64-bit integers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, FACTOR, STEP = 2147483647, 1103515245, 12345


def mix(a: Column, b: Column, seed: int) -> Column:
    """A number from 0 to PRIME - 1 for a pair of non-negative integers below 2^32 each."""
    a, b = a.cast("long") % PRIME, b.cast("long") % PRIME
    first = (a * F.lit(FACTOR) + b * F.lit(STEP) + F.lit(seed)) % F.lit(PRIME)
    return (first * F.lit(FACTOR) + b) % F.lit(PRIME)


def mix_sql(a: str, b: str, seed: int | str) -> str:
    a, b = f"(CAST({a} AS BIGINT) % {PRIME})", f"(CAST({b} AS BIGINT) % {PRIME})"
    return f"(((({a} * {FACTOR} + {b} * {STEP} + {seed}) % {PRIME}) * {FACTOR} + {b}) % {PRIME})"


def mix_array(a: np.ndarray, b: int, seed: int) -> np.ndarray:
    """What `mix` gives for keys in an array."""
    b %= PRIME
    return np.fmod(np.fmod(np.fmod(a, PRIME) * FACTOR + (b * STEP + seed), PRIME) * FACTOR + b, PRIME)


def draw_array(a: int, b: np.ndarray, seed: int) -> np.ndarray:
    """Draws from 0 to PRIME - 1 for a counter and numbered places: `mix` made nonlinear, so that neither counters nor places in a
    row give a series. `draw_sql` gives the same."""
    a, b = a % PRIME, np.asarray(b, np.int64) % PRIME
    first = (a * FACTOR + b * STEP + seed) % PRIME
    v = (first * FACTOR + b) % PRIME
    return (v * v % PRIME * FACTOR + v) % PRIME


def draw_sql(a: str, b: str, seed: int | str) -> str:
    v = mix_sql(a, b, seed)
    return f"(({v} * {v} % {PRIME} * {FACTOR} + {v}) % {PRIME})"


def uniform(a: Column, b: Column, seed: int) -> Column:
    """mix scaled to [0, 1)."""
    return mix(a, b, seed) / F.lit(float(PRIME))
