"""Language-model scores by context-tree weighting over bytes.

Texts are words (A-Z lower-cased) with one space between and an end mark. Each byte is eight binary decisions; every
decision has a tree of contexts, the DEPTH bytes before it and all their suffixes. A node's Krichevsky-Trofimov estimate
is mixed with the product of its children, half and half, from the deepest contexts up; so the model's probability of a
bit is a mixture over all depths whose weights the training texts decide. The base beside it is the unigram score of the
words.

The whole corpus is counted: blocks of text give their distinct (DEPTH + 1)-grams and words with counts, which are summed
by key. They are written once, compressed, for the sums and for the way back. A context's subtree lies in one task; what is
above depth SPLIT is bounded (256^2 contexts) and mixed on the driver. Every gram of every text thus gets its probability
once. The values go back to the blocks by a join on the keys; the grams' are broadcast instead where there are no more than
BROADCAST of them. Keys of words are negative and keys of grams are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_TABLE, fixed, run_hashes, slices, utf8, words

DEPTH, SPLIT = 5, 3
#: Text in a block; a block never spans two input partitions.
BLOCK_BYTES = 16 << 20
#: Text that is worked on at once: its grams take some twenty times its size.
SLICE = 512 << 10
#: Up to so many grams are broadcast (12 bytes each); more are joined.
BROADCAST = 4_000_000
#: About so many grams are in a task that builds subtrees.
TASK_GRAMS = 150_000
#: A block's partial counts are summed whenever they hold so many more keys.
COMPACT = 1_000_000
#: Keys are written in chunks of so many.
CHUNK = 1 << 16
END = -(1 << 63)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised texts, each after DEPTH end marks as its first context; offsets of the texts with these marks."""
    raw, pad = data.tobytes(), b"\n" * DEPTH
    texts = [pad + b" ".join(raw[a:b].lower().split()) + b"\n" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def tokens(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words (negative, never END), and each text's place among them."""
    starts, ends, places = words(text, bounds, ~SPACE_TABLE[text])
    return (run_hashes(text, starts, ends) | np.uint64(1 << 63 | 1)).view(np.int64), places


def grams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its DEPTH bytes of context, and each text's place among them."""
    codes = np.zeros(max(0, len(text) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        codes <<= 8
        codes |= text[k : len(text) - DEPTH + k]
    keep = np.ones(len(codes), bool)
    for k in range(DEPTH):  # what ends in the marks before a text
        keep[(bounds[1:-1] - DEPTH + k)] = False
    sizes = np.diff(bounds) - DEPTH
    return codes[keep], np.concatenate([[0], np.cumsum(sizes)])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, counts, minlength=len(distinct)).astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their block's number. It depends on the partition and the order of its rows alone."""
    before, part = 0, TaskContext.get().partitionId() << 24
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(offsets, SLICE):
            yield part + before // BLOCK_BYTES, batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            before += int(offsets[b] - offsets[a])


def shrunk(x: np.ndarray) -> bytes:
    """64-bit values in few bytes: each byte's place by itself, compressed. Small values and steps take little room."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def grown(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd"), np.uint8).reshape(8, n).T).reshape(-1).view(np.int64)


CHUNKS = "block long, words boolean, size int, keys binary, counts binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a block's distinct words and grams, ascending, and of how often its training texts have them."""
    at, held = None, ([], [])

    def flushed() -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(held):
            keys, n = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            for a in range(0, len(keys), CHUNK):
                own, times = keys[a : a + CHUNK], n[a : a + CHUNK]
                steps = np.diff(own, prepend=np.int64(0))  # modulo 2^64
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([kind == 0]), pa.array([len(own)], pa.int32()), pa.array([shrunk(steps)], pa.binary()), pa.array([shrunk(times)], pa.binary())], names=["block", "words", "size", "keys", "counts"])

    for block, batch, data, offsets in blocks(batches, "text"):
        if block != at:
            if at is not None:
                yield from flushed()
            at, held = block, ([], [])
        learn = batch.column(batch.schema.get_field_index("learn")).to_numpy(zero_copy_only=False).astype(bool)
        text, bounds = normal(data, offsets)
        for kind, (keys, places) in enumerate((tokens(text, bounds), grams(text, bounds))):
            counted = np.repeat(learn, np.diff(places))
            own, n = np.unique(keys[counted], return_counts=True)
            held[kind].extend([(own, n), (z := np.unique(keys[~counted]), np.zeros(len(z), np.int64))])
            if sum(len(k) for k, _ in held[kind][1:]) > COMPACT:
                held[kind][:] = [summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([c for _, c in held[kind]]))]
        held[0].append((np.array([END]), np.array([learn.sum()])))
    if at is not None:
        yield from flushed()


def _keys(name: str):
    """From chunks: a row for each key with its count (name: n) or its block (name: block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                keys = np.cumsum(grown(chunk["keys"], chunk["size"]))
                other = grown(chunk["counts"], chunk["size"]) if name == "n" else np.full(len(keys), chunk["block"])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(other)], names=["key", name])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2, by Stirling's series at x + 7."""
    shift = np.ones_like(x)
    for i in range(7):
        shift = shift * (x + i)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: keys (context * 256 + decision), counts, and the weight of a node's own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = estimate(zeros, ones)
        if below is None:  # the deepest contexts
            self.weighted, self.weight = own, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(own, below) - np.log(2)
            self.weight = np.exp(own - np.log(2) - self.weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1.0)

    def above(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the parents, whose contexts have so many bits, and each node's place among them."""
        mask = (1 << bits) - 1
        return np.unique(((self.keys >> 8) & mask) << 8 | (self.keys & 255), return_inverse=True)

    def parent(self, bits: int) -> Level:
        keys, at = self.above(bits)
        add = lambda x: np.bincount(at, x, minlength=len(keys))
        return Level(keys, add(self.zeros), add(self.ones), add(self.weighted))

    def mixed(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The probability of a one at these nodes, given what is below them; unseen nodes are even."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        w = self.weight[at]
        return np.where(self.keys[at] == keys, w * self.one[at] + (1 - w) * below, 0.5)


def decisions(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of the grams' last byte: the decision's number in the byte, and its value."""
    last = codes & 255
    for k in range(8):
        yield (1 << k) | (last >> (8 - k)), (last >> (7 - k)) & 1


def subtrees(codes: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH to SPLIT of the trees over these grams."""
    codes, n = codes[n > 0], n[n > 0]
    parts = [((codes >> 8) << 8 | node, bit) for node, bit in decisions(codes)]
    flat, bits, weight = np.concatenate([k for k, _ in parts]), np.concatenate([b for _, b in parts]), np.tile(n, 8)
    keys, at = np.unique(flat, return_inverse=True)
    ones = np.bincount(at, weight * bits, minlength=len(keys))
    levels = [Level(keys, np.bincount(at, weight, minlength=len(keys)) - ones, ones, None)]
    for depth in range(DEPTH - 1, SPLIT - 1, -1):
        levels.append(levels[-1].parent(8 * depth))
    return levels


def _roots(table: pa.Table) -> pa.Table:
    """What the levels above SPLIT need of the subtrees."""
    level = subtrees(table.column("key").to_numpy(), table.column("n").to_numpy())[-1]
    keys, at = level.above(8 * (SPLIT - 1))
    add = lambda x: pa.array(np.bincount(at, x, minlength=len(keys)).astype(np.float64))
    return pa.table({"node": pa.array(keys), "zeros": add(level.zeros), "ones": add(level.ones), "weighted": add(level.weighted)})


def _valued(top: list[Level]):
    def run(table: pa.Table) -> pa.Table:
        codes, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        levels, total = [*subtrees(codes, n), *top.value], np.zeros(len(codes))
        for node, bit in decisions(codes):
            one = np.full(len(codes), 0.5)
            for depth, level in zip(range(DEPTH, -1, -1), levels):
                one = level.mixed(((codes >> 8) & ((1 << (8 * depth)) - 1)) << 8 | node, one)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return pa.table({"key": pa.array(codes), "value": pa.array(total)})

    return run


class Lookup:
    """Values by 64-bit keys, all of which are known: two hash tables, then a search for what they have no room for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            bits = max(10, int(len(keys)).bit_length())  # the second table holds what is left, so it is smaller
            slot = self.slots(keys, factor, bits)
            # An empty slot must not look like a key that lies elsewhere.
            empty = np.int64(-2)  # grams are not negative, and words are odd but for END
            known, value = np.full(1 << bits, empty), np.zeros(1 << bits, np.float32)
            known[slot], value[slot] = keys, values
            self.tables.append((factor, bits, known, value))
            rest = known[slot] != keys
            keys, values = keys[rest], values[rest]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    @staticmethod
    def slots(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), np.float32), None
        for factor, bits, known, value in self.tables:
            own = keys if left is None else keys[left]
            slot = self.slots(own, factor, bits)
            hit = known[slot] == own
            if left is None:
                out, left = np.where(hit, value[slot], np.float32(0)), np.flatnonzero(~hit)
            else:
                out[left[hit]] = value[slot[hit]]
                left = left[~hit]
        if len(left):
            at = np.minimum(np.searchsorted(self.keys, keys[left]), max(0, len(self.keys) - 1))
            if not len(self.keys) or (self.keys[at] != keys[left]).any():
                raise ValueError("a block lacks keys of its own texts: the input changed between two readings of it")
            out[left] = self.values[at]
        return out


def score(df: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text) and bits_per_byte (the
    code length of the normalised text with its end mark) of every row.

    learn: which rows are learned from (null: not). A null text is empty: it has the end alone. Repeated rows count each
    time. Without rows to learn from, train_tokens and n_known are 0 and every bit is even. df is read twice and must
    give its rows in the same order both times, as a table in files does; the job fails otherwise. A null doc_id stays null.
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    spark = df.sparkSession
    chunks = fixed(rows.mapInArrow(_counts, CHUNKS))
    counts = fixed(chunks.mapInArrow(_keys("n"), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total, distinct, size = counts.agg(F.sum(F.when(F.col("key") < 0, F.col("n"))), F.count_if((F.col("key") < 0) & (F.col("n") > 0)), F.count_if(F.col("key") >= 0)).first()
    total = total or 0

    tasks = max(1, -(-size // TASK_GRAMS))
    subtree = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * SPLIT)) - 1))), F.lit(tasks)).alias("task")
    parts = counts.where(F.col("key") >= 0).select("key", "n", subtree).groupBy("task")
    sums = parts.applyInArrow(_roots, "node long, zeros double, ones double, weighted double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted"))
    roots = sums.toArrow()  # 256^(SPLIT - 1) * 255 nodes at most
    keys = roots.column(0).to_numpy()
    order = np.argsort(keys)
    zeros, ones, weighted = (roots.column(i).to_numpy()[order] for i in (1, 2, 3))
    top = [Level(keys[order], zeros, ones, weighted)]
    for depth in range(SPLIT - 2, -1, -1):
        top.append(top[-1].parent(8 * depth))
    values = parts.applyInArrow(_valued(spark.sparkContext.broadcast(top)), "key long, value double")

    table = counts.where(F.col("key") < 0).select("key", F.col("n").cast("double").alias("value"))
    known = None
    if size <= BROADCAST:
        got = values.toArrow()
        known = spark.sparkContext.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy().astype(np.float32)))
        chunks = chunks.where("words")
    else:
        table = table.unionByName(values)
    found = chunks.mapInArrow(_keys("block"), "key long, block long")
    sent = found.join(table, "key").select("block", "key", F.col("value").cast("float").alias("value"))
    in_blocks = rows.mapInArrow(_with_block, "block long, doc_id long, text string")
    each = 1 / (total + 0.1 * (distinct + 1))

    def scored(texts: pa.Table, values: pa.Table) -> pa.Table:
        key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
        of_word = Lookup(key[key < 0], value[key < 0])
        of_gram = Lookup(key[key >= 0], value[key >= 0]) if known is None else broadcast_lookup(*known.value)
        end, out = of_word(np.array([END]))[0] if len(key) else np.float32(0), []
        del key, value, values
        data, offsets = utf8(texts.column("text"))
        for a, b in slices(offsets, SLICE):
            text, bounds = normal(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys, places = tokens(text, bounds)
            c = of_word(keys).astype(np.float64)
            logs, seen = np.concatenate([[0], np.cumsum(np.log10((c + 0.1) * each))]), np.concatenate([[0], np.cumsum(c > 0)])
            codes, at = grams(text, bounds)
            bits = np.concatenate([[0], np.cumsum(of_gram(codes), dtype=np.float64)])
            model = np.diff(bits[at])
            out.append((np.diff(places) + 1, np.diff(seen[places]) + int(end > 0), np.diff(logs[places]) + np.log10((float(end) + 0.1) * each), model, -model * np.log2(10) / np.diff(at)))
        n, n_known, base, model, rate = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(n), total)), "base_score": pa.array(base), "score": pa.array(model), "bits_per_byte": pa.array(rate)})

    pairs = in_blocks.groupBy("block").cogroup(sent.groupBy("block"))
    return pairs.applyInArrow(scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


#: The last broadcast keys and their table, kept in this Python worker.
_kept: list[tuple[np.ndarray, Lookup]] = []


def broadcast_lookup(keys: np.ndarray, values: np.ndarray) -> Lookup:
    if not _kept or _kept[0][0] is not keys:
        _kept[:] = [(keys, Lookup(keys, values))]
    return _kept[0][1]


def _with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch, _, _ in blocks(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), batch.column(0), batch.column(1)], names=["block", "doc_id", "text"])
