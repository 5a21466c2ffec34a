"""Bit vectors as arrays of 32-bit words held in longs, bit i in word i // 32 at place i % 32.

All functions are built-in expressions on columns; shorter arrays are an error, as words are combined place by place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import mix

WORD = 32


def _same_size(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("bit vectors of different sizes")))


def power(i: Column) -> Column:
    """2 to the i, as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def pack(bits: Column) -> Column:
    """Words of an array of 0 and 1."""
    value = lambda part: F.aggregate(F.transform(part, lambda b, i: b.cast("long") * power(i)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / WORD).cast("int"))
    return F.when(F.size(bits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(words, lambda w: value(F.slice(bits, w * WORD + 1, F.lit(WORD)))))


def words_of(bits: list[Column]) -> Column:
    """Words of conditions known by place: one flat sum for each word."""
    flat = [F.when(b, F.lit(1 << (i % WORD))).otherwise(F.lit(0)).cast("long") for i, b in enumerate(bits)]
    groups = [flat[i : i + WORD] for i in range(0, len(flat), WORD)]
    out = []
    for group in groups:
        total = group[0]
        for x in group[1:]:
            total = total + x
        out.append(total)
    return F.array(*out)


def from_places(places: Column, dim: int) -> Column:
    """Words of `dim` bits of which those at the places are set; a place may come up several times."""
    own = lambda w: F.aggregate(F.filter(places, lambda p: F.floor(p / WORD) == w), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(power(p % WORD)))
    return F.array(*[own(w) for w in range(-(-dim // WORD))])


def unpack(words: Column, dim: int) -> Column:
    """The first `dim` bits as an array of 0 and 1."""
    if dim <= 64:
        return F.array(*[bit(words, F.lit(i)) for i in range(dim)])  # flat: compiled with what is around it
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: bit(words, i))


def bit(words: Column, i: Column) -> Column:
    """Bit i (0 or 1); 0 beyond the end."""
    word = F.coalesce(F.get(words, F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, i % WORD).cast("int")


def random_bits(key: Column, dim: int, seed: int) -> Column:
    """`dim` even coins of a key."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.floor(mix(key, i, seed) / 8) % 2).cast("int"))


def places_words(places: list[Column], dim: int) -> Column:
    """Words of `from_places` for places that are columns of their own, below dim each: flat. Null and negative ones set no bit."""
    out = []
    for w in range(-(-dim // WORD)):
        word = F.lit(0).cast("long")
        for p in places:
            own = F.when(F.shiftright(p, 5) == w, power(p.bitwiseAND(F.lit(WORD - 1)))).otherwise(F.lit(0).cast("long"))
            word = word.bitwiseOR(own)
        out.append(word)
    return F.array(*out)


def bind(a: Column, b: Column) -> Column:
    """Exclusive or; its own inverse."""
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def permute(bits: Column, k: Column | int) -> Column:
    """Cyclic shift of an array of bits by k places to the right."""
    k = F.pmod(F.lit(k) if isinstance(k, int) else k, F.size(bits))
    return F.concat(F.slice(bits, F.size(bits) - k + 1, k), F.slice(bits, F.lit(1), F.size(bits) - k))


def permute_words(words: Column, k: Column) -> Column:
    """The same on words, for vectors of whole words: no bit is unpacked."""
    n, whole, part = F.size(words), F.floor(k / WORD).cast("int"), F.pmod(k, F.lit(WORD)).cast("int")

    def word(w: Column) -> Column:
        own, before = F.get(words, F.pmod(w - whole, n)), F.get(words, F.pmod(w - whole - 1, n))
        high = F.call_function("shiftleft", own, part).bitwiseAND(F.lit((1 << WORD) - 1))
        return high.bitwiseOR(F.call_function("shiftright", before, F.lit(WORD) - part))

    return F.transform(F.sequence(F.lit(0), n - 1), word)


def similarity(a: Column, b: Column, dim: int) -> Column:
    """1 minus the share of bits that differ."""
    differ = F.aggregate(bind(a, b), F.lit(0), lambda acc, w: acc + F.bit_count(w).cast("int"))
    return F.lit(1.0) - differ / F.lit(float(dim))


def thermometer(value: Column, n: int, low: float, high: float) -> Column:
    """n bits: whether the value exceeds each of the n - 1 inner thresholds between low and high; the last threshold counts twice."""
    if high <= low:
        raise ValueError("high must exceed low")
    if n < 2:
        raise ValueError("at least two bits are needed")
    step = (high - low) / n
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (value > F.lit(low) + F.least(i, F.lit(n - 1)) * F.lit(step)).cast("int"))


def thermometer_int(value: Column, n: int) -> Column:
    """n bits: bit i is set if the value exceeds i."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (value > i).cast("int"))


def one_hot(index: Column, n: int) -> Column:
    """n bits, of which the one at the index is set, if there is such a place."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((index == i).cast("int"), F.lit(0)))


def holds(words: Column, code: Column) -> Column:
    """Whether all bits of the code are set."""
    return F.forall(F.zip_with(words, code, lambda w, c: w.bitwiseAND(c) == c), lambda x: x)


def hot_places(key: Column, count: int, dim: int, seed: int) -> list[Column]:
    """`count` places for a symbol by double hashing: a start and an odd step."""
    start, step = mix(key, F.lit(0), seed) % dim, (mix(key, F.lit(1), seed) % F.lit(dim // 2)) * 2 + 1
    return [((start + F.lit(i) * step) % dim).cast("int") for i in range(count)]


def hot_bits(key: Column, count: int, dim: int, seed: int) -> Column:
    """The same as an array."""
    return F.array(*hot_places(key, count, dim, seed))


def inverted(words: Column, dim: int) -> Column:
    """The negation of each of the first `dim` bits."""
    return F.array(*[F.get(words, F.lit(w)).bitwiseXOR(F.lit((1 << min(WORD, dim - w * WORD)) - 1).cast("long")) for w in range(-(-dim // WORD))])


def with_complement(bits: Column) -> Column:
    """The bits followed by their negations."""
    return F.concat(bits, F.transform(bits, lambda b: F.lit(1) - b))


def target(label: Column, positive: Column | int, threshold: int) -> Column:
    """The vote target of a label: threshold for the positive class, else its negative."""
    return F.when(label == positive, F.lit(threshold)).otherwise(F.lit(-threshold))


def one_hot_place(number: Column) -> Column:
    """The single place of a symbol in a one-hot code: its number."""
    return F.array(number.cast("int"))


def random_places(key: Column, count: int, dim: int, seed: int) -> Column:
    """`count` different places for a symbol: those with the least hashes, in order."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.struct(mix(key, i, seed).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, count), lambda s: s["i"].cast("int")))
