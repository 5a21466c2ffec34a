"""Clause trees of large machines, evaluated through an index from literals to the leaves that they break.

For each literal the index has a bitmap of the leaves that include it: these break where the literal is false. A node ORs the bitmaps
of its false literals; what is left alive are the leaves that hold, and the tree above them folds whole words: OR over the leaves of
an AND's branch, AND over these, OR, AND. A node costs the same however its clauses are cut, and no tree is walked.

Leaves that read the same features (branch j, place l) form a group. In a group's bitmap there is a plane of one bit a clause for
each (k, m), so a fold is a word operation. Machines of any size (`held_clauses`, `graph_votes`) are cut into blocks of clauses, and there a
literal has a bitmap of the nodes of a chunk at which it is true, so that a leaf is the AND of its literals' bitmaps. The bitmaps of several neighbouring features are combined beforehand into a table by their
values, so one lookup stands for up to eight features. Index and tables have the size of the machine, not of the data: the index is
built by Spark from the automata and broadcast, and the tables are made once in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clauses import Spec, included

#: Tables of at most so many bytes; beyond, a lookup stands for fewer features.
TABLES = 64 << 20
#: Bytes of bitmaps that are worked on at once.
CHUNK = 4 << 20


@dataclass(frozen=True)
class WideSpec(Spec):
    """A machine that only the index evaluates: its clauses may read any number of features."""

    most_features: int | None = None


@dataclass(frozen=True)
class Index:
    """bitmaps: [literal (the features, then their negations), plane * words]."""

    spec: Spec
    bitmaps: np.ndarray


def index(ta: DataFrame, spec: Spec, threshold: int) -> Index:
    """The index of a machine. ta: clause, j, k, l, m, n, feature, state, of all automata or of those that include alone."""
    planes, words = spec.inner_or * spec.leaf_or, -(-spec.clauses // 64)
    place = (F.col("k") * spec.leaf_or + F.col("m")) * words + F.floor(F.col("clause") / 64)
    literal = F.col("feature") + F.when(F.col("n") >= spec.leaf_and, spec.features).otherwise(0)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("clause") % 64).cast("int"))
    rows = included(ta, threshold).select(literal.alias("literal"), place.cast("int").alias("place"), bit.alias("bit"))
    found = rows.groupBy("literal", "place").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each literal and word: the machine's size
    bitmaps = np.zeros((2 * spec.features, planes * words), np.int64)
    bitmaps[found["literal"].to_numpy(), found["place"].to_numpy()] = found["bits"].to_numpy()
    return Index(spec, bitmaps.view(np.uint64))


def _tables(zero: np.ndarray, one: np.ndarray, width: int) -> np.ndarray:
    """[step, value, words]: for `width` features at a time the OR of the bitmaps that each of their values calls for."""
    n, words = zero.shape
    steps = -(-n // width)
    out = np.zeros((steps, 1 << width, words), np.uint64)
    value = np.arange(1 << width)
    for f in range(n):
        set_ = (value >> (f % width)) & 1 == 1
        out[f // width, set_] |= one[f]
        out[f // width, ~set_] |= zero[f]
    return out


class _Evaluator:
    def __init__(self, built: Index, negation: str) -> None:
        s = self.spec = built.spec
        self.groups, size = s.root * s.inner_and, s.leaf_and
        pos, neg = (half.reshape(self.groups, size, -1) for half in np.split(built.bitmaps, 2))
        none = np.zeros_like(pos[0])
        # Pairs of the first bit that is read, and the bitmaps for a bit of 0 and of 1.
        reads = [(0, [(p, n) for p, n in zip(pos, neg)])] if negation == "complement" else [(0, [(p, none) for p in pos]), (s.features, [(n, none) for n in neg])]
        self.width = next(w for w in (8, 4, 2, 1) if w == 1 or len(reads) * self.groups * -(-size // w) * (1 << w) * pos.shape[2] * 8 <= TABLES)
        self.reads = [(start, [_tables(zero, one, self.width) for zero, one in each]) for start, each in reads]
        self.last = np.zeros(-(-s.clauses // 64) * 64, bool)
        self.last[: s.clauses] = True
        self.last = np.packbits(self.last, bitorder="little").view(np.uint64)

    def fired(self, x: np.ndarray) -> np.ndarray:
        """The clauses that hold, 64 in a word, from rows of bits."""
        s, n = self.spec, len(x)
        dead = np.zeros((n, self.groups, s.inner_or * s.leaf_or * len(self.last)), np.uint64)
        weight = 1 << np.arange(self.width)
        for start, each in self.reads:
            for g, table in enumerate(each):
                own = x[:, start + g * s.leaf_and : start + (g + 1) * s.leaf_and]
                own = np.pad(own, ((0, 0), (0, -s.leaf_and % self.width))).reshape(n, len(table), self.width) @ weight
                for step in range(len(table)):
                    dead[:, g] |= table[step, own[:, step]]
        alive = ~dead.reshape(n, s.root, s.inner_and, s.inner_or, s.leaf_or, -1)
        held = np.bitwise_or.reduce(alive, axis=4)
        held = np.bitwise_and.reduce(held, axis=2)
        held = np.bitwise_or.reduce(held, axis=2)
        return np.bitwise_and.reduce(held, axis=1) & self.last

    def rows(self, x: np.ndarray) -> np.ndarray:
        size = max(1, CHUNK // (self.groups * self.spec.inner_or * self.spec.leaf_or * len(self.last) * 8))
        return np.concatenate([self.fired(x[a : a + size]) for a in range(0, len(x), size)])


def fired_words(nodes: DataFrame, built: Index, negation: str = "complement") -> DataFrame:
    """What `clauses.fired_words` gives: graph_id, node_id, fired (32 clauses in a word) of every node. nodes: graph_id, node_id, hv
    (words of 32 bits; as many bits as the clauses read, or twice that with negation by offset). No shuffle; a null or short hv is
    an error."""
    if negation not in ("complement", "offset"):
        raise ValueError("negation is `complement` or `offset`")
    held = nodes.sparkSession.sparkContext.broadcast(built)
    need = built.spec.features * (1 if negation == "complement" else 2)
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema if f.name in ("graph_id", "node_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for batch in batches:
            if not batch.num_rows:
                continue
            engine = engine or _Evaluator(held.value, negation)
            hv = batch.column(2)
            words = hv.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            if hv.null_count or len(words) % len(hv) or len(words) // len(hv) * 32 < need:
                raise ValueError(f"a node has no vector of {need} bits")
            x = np.unpackbits(words.view(np.uint8).reshape(len(hv), -1), axis=1, bitorder="little")
            own = engine.rows(x).view(np.uint32)[:, : -(-engine.spec.clauses // 32)].astype(np.int64)
            fired = pa.ListArray.from_arrays(pa.array(np.arange(len(hv) + 1) * own.shape[1], pa.int32()), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fired], names=["graph_id", "node_id", "fired"])

    return nodes.select("graph_id", "node_id", F.col("hv").cast("array<long>").alias("hv")).mapInArrow(run, f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, fired array<long>")


#: Clauses of a block and nodes of a chunk: what a task holds at once. Clauses that are folded together; rows that are given at once, about.
BLOCK, NODES, TOGETHER, GIVEN = 8192, 4096, 64, 1 << 16
#: Rows that are packed together before they are shuffled, and chunks that a task reads of each block, about.
PACKED, BESIDE = 1 << 20, 64


def _packed(rows: DataFrame, key: str, schema: str, pack: Callable[[pa.Table], list]) -> DataFrame:
    """key and what `pack` makes of its rows: a row for each key of every PACKED rows of the input."""
    kinds = pa.schema([(key, pa.int64()), *[(c.split()[0], {"binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in schema.split(", ")]])

    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by(key)
        keys = table[key].to_numpy()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[int(keys[a])], *([x] for x in pack(table.slice(a, b - a)))], kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACKED:
                yield from pieces(held)
                held, n = [], 0
        if n:
            yield from pieces(held)

    return rows.mapInArrow(run, f"{key} long, {schema}")


class _Block:
    """The trees of a block of clauses: for `together` clauses at a time and the first, second and further literals of leaves, which leaves
    have one and which it is. spec: of these clauses alone. codes: (literal * planes + plane) * block + clause of each literal included."""

    def __init__(self, spec: Spec, codes: np.ndarray, block: int, together: int) -> None:
        self.spec, self.together, self.leaves = spec, together, spec.root * spec.inner_or * spec.inner_and * spec.leaf_or
        (literal, plane), clause = divmod(codes // block, spec.inner_or * spec.leaf_or), codes % block
        (j, l), (k, m) = divmod(literal % spec.features // spec.leaf_and, spec.inner_and), divmod(plane, spec.leaf_or)  # noqa: E741
        leaf = (((clause * spec.root + j) * spec.inner_or + k) * spec.inner_and + l) * spec.leaf_or + m
        order = np.argsort(leaf, kind="stable")
        leaf, literal = leaf[order], literal[order]
        first = np.flatnonzero(np.diff(leaf, prepend=-1))
        nth = np.arange(len(leaf)) - np.repeat(first, np.diff(first, append=len(leaf)))
        part = leaf // (self.leaves * together)
        order = np.lexsort((nth, part))
        part, nth, self.leaf, self.literal = part[order], nth[order], leaf[order] - part[order] * self.leaves * together, literal[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(nth, prepend=-1))
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(-(-spec.clauses // together))]
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            self.runs[part[a]].append((int(a), int(b)))
        self.some = np.zeros(spec.clauses, bool)
        self.some[clause] = True

    def held(self, x: np.ndarray, negation: str) -> Iterator[tuple[int, np.ndarray]]:
        """The first of some clauses, and for each of them at which nodes it holds (0 or 1). x: [node, bit]."""
        s, n = self.spec, len(x)
        true = np.packbits(np.ascontiguousarray(np.pad(x, ((0, -n % 64), (0, 0))).T), axis=1, bitorder="little").view(np.uint64)
        true = np.concatenate([true, ~true]) if negation == "complement" else true
        for i, runs in enumerate(self.runs):
            size = min(self.together, s.clauses - i * self.together)
            alive = np.full((size * self.leaves, true.shape[1]), ~np.uint64(0))
            for a, b in runs:
                alive[self.leaf[a:b]] &= true[self.literal[a:b]]
            alive = alive.reshape(size, s.root, s.inner_or, s.inner_and, s.leaf_or, -1)
            held = np.bitwise_and.reduce(np.bitwise_or.reduce(np.bitwise_and.reduce(np.bitwise_or.reduce(alive, axis=4), axis=3), axis=2), axis=1)
            yield i * self.together, np.unpackbits(held.view(np.uint8), axis=1, bitorder="little")[:, :n]


def _met(nodes: DataFrame, ta: DataFrame, spec: Spec, threshold: int, negation: str, work: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """What `work` gives of every block of clauses and every chunk of nodes: work(first clause, graph_id, node_id, block, bits of the nodes).
    Neither the machine nor the nodes are ever in one place: a task holds a block of clauses and a chunk of nodes. Both sides are packed
    and written once, and each task reads its part of either, so that what lies on disk grows with their sum, not with their product."""
    if negation not in ("complement", "offset"):
        raise ValueError("negation is `complement` or `offset`")
    count, chunks = -(-spec.clauses // BLOCK), max(1, -(-nodes.count() // NODES))
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    left = min(count, 4 * cores)
    right = min(chunks, max(-(-chunks // BESIDE), -(-4 * cores // left)))
    planes, need = spec.inner_or * spec.leaf_or, spec.features * (1 if negation == "complement" else 2)
    width = -(-need // 32)
    kind = np.int32 if 2 * spec.features * planes * BLOCK < 1 << 31 else np.int64

    literal = F.col("feature") + F.when(F.col("n") >= spec.leaf_and, spec.features).otherwise(0)
    code = (literal.cast("long") * planes + F.col("k") * spec.leaf_or + F.col("m")) * BLOCK + F.col("clause") % BLOCK
    rows = included(ta, threshold).where(F.col("clause").between(0, spec.clauses - 1))
    codes = _packed(rows.select(F.floor(F.col("clause") / BLOCK).alias("block"), code.alias("code")), "block", "codes binary", lambda t: [t["code"].to_numpy().astype(kind).tobytes()])
    every = nodes.sparkSession.range(count).select(F.col("id").alias("block"), F.lit(b"").alias("codes"))  # blocks without automata too
    blocks = codes.unionByName(every).repartition(left, "block").groupBy("block").agg(F.collect_list("codes").alias("codes"))

    def own_nodes(t: pa.Table) -> list:
        hv = t["hv"].combine_chunks()
        sizes = pa.compute.list_value_length(hv).fill_null(0).to_numpy()
        if (sizes < width).any():
            raise ValueError(f"a node has no vector of {need} bits")
        at = (np.cumsum(sizes) - sizes)[:, None] + np.arange(width)
        words = hv.flatten().to_numpy(zero_copy_only=False)[at].astype(np.uint32)
        return [t["graph_id"].combine_chunks(), t["node_id"].combine_chunks(), words.tobytes()]

    placed = nodes.select(F.col("graph_id").cast("long").alias("graph_id"), F.col("node_id").cast("long").alias("node_id"), F.col("hv").cast("array<long>").alias("hv"), F.pmod(F.xxhash64("graph_id"), F.lit(chunks)).cast("long").alias("chunk"))
    parts = _packed(placed, "chunk", "graph array<long>, node array<long>, words binary", own_nodes)
    parts = parts.repartition(right, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("graph", "node", "words")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != known:
                    codes = np.concatenate([np.frombuffer(x, kind) for x in batch.column(1)[i].as_py()]).astype(np.int64)
                    known, own = block, _Block(replace(spec, clauses=min(BLOCK, spec.clauses - block * BLOCK)), codes, BLOCK, TOGETHER)
                held = batch.column(2)[i].values
                words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in held.field("words")]).reshape(-1, width * 4)
                x = np.unpackbits(words, axis=1, count=need, bitorder="little")
                for rows in work(block * BLOCK, *(held.field(c).flatten() for c in ("graph", "node")), own, x):
                    yield pa.RecordBatch.from_pydict(rows)

    # Every block meets every chunk: a task goes through the chunks of its part for each of its blocks.
    return blocks.hint("shuffle_replicate_nl").crossJoin(parts).select("block", "codes", "nodes").mapInArrow(run, schema)


def held_clauses(nodes: DataFrame, ta: DataFrame, spec: Spec, threshold: int, negation: str = "complement", empty: bool = True) -> DataFrame:
    """graph_id, node_id and clause of every clause that holds at a node, for machines of any size. nodes and ta: as `fired_words` and
    `index` take them. empty: whether clauses that include nothing, which always hold, are given."""

    def work(first: int, graph: pa.Array, node: pa.Array, block: _Block, x: np.ndarray) -> Iterator[dict]:
        def rows() -> dict:
            at, clause = (np.concatenate(c) for c in zip(*found))
            return {"graph_id": graph.take(pa.array(at)), "node_id": node.take(pa.array(at)), "clause": pa.array(clause + first, pa.int64())}

        found, n = [], 0
        for start, held in block.held(x, negation):
            held = held if empty else held & block.some[start : start + len(held), None]
            clause, at = np.nonzero(held)
            found.append((at, clause + start))
            n += len(at)
            if n >= GIVEN:
                yield rows()
                found, n = [], 0
        if n:
            yield rows()

    return _met(nodes, ta, spec, threshold, negation, work, "graph_id long, node_id long, clause long")


def graph_votes(nodes: DataFrame, ta: DataFrame, spec: Spec, threshold: int, negation: str = "complement") -> DataFrame:
    """graph_id and votes (long, not clipped): even clauses that hold at any node of a graph, less odd ones. For machines of any size."""

    def work(first: int, graph: pa.Array, node: pa.Array, block: _Block, x: np.ndarray) -> Iterator[dict]:
        graphs = graph.dictionary_encode("encode")
        of = graphs.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        starts, votes = np.flatnonzero(np.diff(of[order], prepend=-1)), np.zeros(len(graphs.dictionary), np.int64)
        for start, held in block.held(x[order], negation):  # blocks and what is folded together begin with an even clause
            any_ = np.maximum.reduceat(held, starts, axis=1)  # a graph lies in one chunk
            votes += any_[::2].sum(axis=0, dtype=np.int64) - any_[1::2].sum(axis=0, dtype=np.int64)
        yield {"graph_id": graphs.dictionary, "votes": pa.array(votes, pa.int64())}

    return _met(nodes, ta, spec, threshold, negation, work, "graph_id long, votes long").groupBy("graph_id").agg(F.sum("votes").alias("votes"))
