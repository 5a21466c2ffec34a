"""A graph network that learns its message passing: a teacher for clause machines.

A layer adds to a node's vector what its neighbours send (their vectors and the bond's), weighs the node's own by 1 + eps, and passes
the sum through two dense layers; the means of all layers' vectors over a graph's nodes give its logit. All of it is learned: the
vectors of atoms and bonds, eps, and the weights.

Graphs are gathered once into blocks of about BLOCK graphs, a row each, that lie in the shared folder. For each step the parameters (some
thousands of numbers) are broadcast, every block gives its gradient by back-propagation, gradients are summed in SUMS groups, and the
driver adds up those and moves the parameters (Adam). So a step sees all graphs, no task holds more than a block, and the driver
holds nothing that grows with the data. Blocks follow from hashes and sums from the numbers of blocks, so a training can be
repeated."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, SUMS = 2048, 16
#: Up to about so many nodes are worked on at once: their numbers stay in a core's cache.
PIECE = 2048


@dataclass(frozen=True)
class Shape:
    atoms: int
    bonds: int
    hidden: int = 16
    layers: int = 2

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h, out = self.hidden, [("atom", (self.atoms, self.hidden))]
        for k in range(self.layers):
            out += [(f"bond{k}", (self.bonds, h)), (f"eps{k}", ()), (f"in{k}", (h, h)), (f"in_bias{k}", (h,)), (f"out{k}", (h, h)), (f"out_bias{k}", (h,))]
        return [*out, ("head", (self.layers + 1, h)), ("bias", ())]

    @property
    def size(self) -> int:
        return sum(math.prod(s) for _, s in self.parts())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters by name, as views of one row."""
        out, at = {}, 0
        for name, shape in self.parts():
            n = math.prod(shape)
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: int) -> np.ndarray:
        """Random parameters; biases and eps are zero."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for name, part in self.split(flat).items():
            if part.ndim and "bias" not in name:
                part[...] = rng.normal(0, 1 / np.sqrt(part.shape[0] if name.startswith(("in", "out")) else self.hidden), part.shape)
        return flat


@dataclass
class Block:
    """Graphs one after another: their nodes' atoms, how many nodes each has, and edges both ways between nodes by their place."""

    atoms: np.ndarray
    sizes: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    bond: np.ndarray


def pieces(b: Block, nodes: int) -> Iterator[tuple[slice, Block]]:
    """The graphs of a block by runs of about so many nodes, and which they are. The edges of a block are ordered by graph."""
    ends = np.cumsum(b.sizes)
    cuts = [*np.flatnonzero(np.diff((ends - 1) // nodes, prepend=-1)), len(ends)]
    of_nodes = np.concatenate([[0], ends])[cuts]
    of_edges = np.searchsorted(b.src, of_nodes)
    for g, h, i, j, k, m in zip(cuts, cuts[1:], of_nodes, of_nodes[1:], of_edges, of_edges[1:]):
        yield slice(g, h), Block(b.atoms[i:j], b.sizes[g:h], b.src[k:m] - i, b.dst[k:m] - i, b.bond[k:m])


def _places(to: np.ndarray, wide: int) -> np.ndarray:
    """For each number of rows that are `wide`, its place among those of their sums."""
    return (to[:, None] * wide + np.arange(wide)).ravel()


def _summed(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values that go to each of n rows."""
    return np.bincount(places, values.ravel(), n * values.shape[1]).reshape(n, -1)


def _counted(row: np.ndarray, kind: np.ndarray, rows: int, kinds: int) -> np.ndarray:
    """How often each kind occurs in each row."""
    return np.bincount(row * kinds + kind, minlength=rows * kinds).reshape(rows, kinds).astype(float)


def forward(p: dict[str, np.ndarray], layers: int, b: Block) -> tuple[np.ndarray, tuple[list, list]]:
    """The logit of each graph, and what the way back needs: what came into and out of each layer, and the graphs' means of all layers."""
    graphs, (kinds, wide) = len(b.sizes), p["bond0"].shape if layers else (0, p["atom"].shape[1])
    owner, to, each = _places(np.repeat(np.arange(graphs), b.sizes), wide), _places(b.dst, wide), 1 / b.sizes[:, None]
    bonds = _counted(b.dst, b.bond, len(b.atoms), kinds)
    h, kept = p["atom"].take(b.atoms, axis=0), []
    means = [_summed(h, owner, graphs) * each]
    logit = means[0] @ p["head"][0] + p["bias"]
    for k in range(layers):
        z = (1 + p[f"eps{k}"]) * h + _summed(h.take(b.src, axis=0), to, len(h)) + bonds @ p[f"bond{k}"]
        mid = np.maximum(z @ p[f"in{k}"] + p[f"in_bias{k}"], 0)
        out = np.maximum(mid @ p[f"out{k}"] + p[f"out_bias{k}"], 0)
        kept.append((h, z, mid, out))
        h = out
        means.append(_summed(h, owner, graphs) * each)
        logit = logit + means[-1] @ p["head"][k + 1]
    return logit, (kept, means)


def gradient(shape: Shape, flat: np.ndarray, b: Block, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the weighted sum of the graphs' log losses, and the logits."""
    p, owner = shape.split(flat), np.repeat(np.arange(len(b.sizes)), b.sizes)
    logit, (kept, means) = forward(p, shape.layers, b)
    back = np.zeros(shape.size)
    g = shape.split(back)
    slope = weight * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)
    at_nodes = (slope / b.sizes)[owner][:, None]
    g["bias"][...] = slope.sum()
    to, bonds = _places(b.src, shape.hidden), _counted(b.dst, b.bond, len(b.atoms), shape.bonds)
    down = np.zeros((len(b.atoms), shape.hidden))
    for k in range(shape.layers - 1, -1, -1):
        h, z, mid, out = kept[k]
        g["head"][k + 1] = means[k + 1].T @ slope
        d = (down + at_nodes * p["head"][k + 1]) * (out > 0)
        g[f"out{k}"][...], g[f"out_bias{k}"][...] = mid.T @ d, d.sum(axis=0)
        d = (d @ p[f"out{k}"].T) * (mid > 0)
        g[f"in{k}"][...], g[f"in_bias{k}"][...] = z.T @ d, d.sum(axis=0)
        d = d @ p[f"in{k}"].T
        g[f"eps{k}"][...] = np.vdot(d, h)
        g[f"bond{k}"][...] = bonds.T @ d
        down = (1 + p[f"eps{k}"]) * d + _summed(d.take(b.dst, axis=0), to, len(h))
    g["head"][0] = means[0].T @ slope
    g["atom"][...] = _counted(np.arange(len(b.atoms)), b.atoms, len(b.atoms), shape.atoms).T @ (down + at_nodes * p["head"][0])
    return back, logit


#: Whole numbers of nodes and edges are 32-bit integers in bytes, which pass between Spark and Python as they are.
BLOCKS = "block long, ids array<long>, y array<int>, part array<int>, atoms binary, sizes binary, src binary, dst binary, bond binary"


def parts(nodes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """graph_id, u, v and kind: a row for each node (v is null, kind its atom) and for each way of each bond."""
    of_nodes = nodes.select("graph_id", F.col("node_id").cast("long").alias("u"), F.lit(None).cast("long").alias("v"), F.col("atom_type").cast("int").alias("kind"))
    of_bonds = adjacent.select("graph_id", F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), F.col("bond_type").cast("int").alias("kind"))
    return of_nodes.unionByName(of_bonds).where("graph_id is not null")


def blocks(nodes: DataFrame, adjacent: DataFrame, graphs: DataFrame, fixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The graphs in blocks. nodes: graph_id, node_id, atom_type; adjacent: graph_id, src, dst, bond_type, both ways; graphs: graph_id
    and perhaps y (0 or 1) and split (train, valid or other). Graphs without nodes are left out."""
    return blocks_of(lambda block: parts(nodes, adjacent).withColumn("block", block), graphs, fixed)


def blocks_of(dealt: Callable[[Column], DataFrame], graphs: DataFrame, fixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As `blocks`, of what `dealt` makes of the number of a graph_id's block: the `parts` with this column. If it deals rows out by
    this number before it derives the parts, nothing is shuffled again."""
    y = F.col("y") if "y" in graphs.columns else F.lit(0)
    part = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2) if "split" in graphs.columns else F.lit(2)
    rows = fixed(graphs.where("graph_id is not null").select("graph_id", y.cast("int").alias("y"), part.alias("part")))
    block = F.pmod(F.xxhash64("graph_id"), F.lit(max(1, -(-rows.count() // BLOCK))))
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def gather(graphs: pa.Table, parts: pa.Table) -> pa.Table:
        graphs = graphs.sort_by([("graph_id", "ascending"), ("part", "ascending"), ("y", "ascending")])
        ids, is_node = graphs["graph_id"].to_numpy(), pa.compute.is_null(parts["v"])
        of, u, atoms = (parts.filter(is_node)[c].to_numpy() for c in ("graph_id", "u", "kind"))
        order = np.lexsort((atoms, u, of))
        of, u, atoms = of[order], u[order], atoms[order]
        first, last = np.searchsorted(of, ids), np.searchsorted(of, ids, "right")
        graphs, ids, first, last = graphs.filter(last > first), *(x[last > first] for x in (ids, first, last))
        # An edge's ends by their places among the nodes, which are ordered by graph, then node.
        edge_of, *ends, bond = (parts.filter(pa.compute.invert(is_node))[c].to_numpy() for c in ("graph_id", "u", "v", "kind"))
        known_ids, known = np.unique(ids), np.unique(u)
        key = lambda graph, node: np.searchsorted(known_ids, graph) * len(known) + np.searchsorted(known, node)
        kept = np.isin(of, known_ids)
        at = key(of[kept], u[kept])
        whole = np.flatnonzero(kept)
        own = np.isin(edge_of, known_ids)
        edge_of, bond, (src, dst) = edge_of[own], bond[own], (whole[np.searchsorted(at, key(edge_of[own], x[own].astype(np.int64)))] if own.any() else np.zeros(0, np.int64) for x in ends)
        order = np.lexsort((bond, dst, src))
        edge_of, src, dst, bond = edge_of[order], src[order], dst[order], bond[order]
        sizes, low, high = last - first, np.searchsorted(edge_of, ids), np.searchsorted(edge_of, ids, "right")
        shift = np.cumsum(sizes) - sizes - first
        edges, moved = _ranges(low, high), np.repeat(shift, high - low)
        numbers = [atoms[_ranges(first, last)], sizes, src[edges] + moved, dst[edges] + moved, bond[edges]]
        if not len(ids):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        made = [parts["block"][0].as_py(), ids, graphs["y"].to_numpy(), graphs["part"].to_numpy(), *[x.astype(np.int32).tobytes() for x in numbers]]
        return pa.table([pa.array([v], t) for v, t in zip(made, kinds)], names=names)

    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, *[pa.binary()] * 5]
    return fixed(rows.withColumn("block", block).groupBy("block").cogroup(dealt(block).groupBy("block")).applyInArrow(gather, BLOCKS))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its last."""
    count = last - first
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _read(batch: pa.RecordBatch, row: int) -> tuple[Block, dict[str, np.ndarray]]:
    """A block, and the numbers, labels and parts of its graphs."""
    numbers = [np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("atoms", "sizes", "src", "dst", "bond")]
    return Block(*[x.astype(np.int64) for x in numbers]), {c: batch.column(c)[row].values.to_numpy() for c in ("ids", "y", "part")}


STEP = "block long, loss double, graphs double, valid_loss double, valid_graphs double, gradient binary"


def step(of: DataFrame, shape: Shape, flat: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, float, float]:
    """The mean gradient over the training graphs, and the mean losses of training and validation graphs. weights: of labels 0, 1."""
    held = of.sparkSession.sparkContext.broadcast(flat)
    names = [c.split()[0] for c in STEP.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, of_graphs = _read(batch, row)
                y, part = of_graphs["y"], of_graphs["part"]
                weight = np.where(y == 1, weights[1], weights[0])
                back, logit = np.zeros(shape.size), np.zeros(len(y))
                for own, piece in pieces(block, PIECE):
                    more, logit[own] = gradient(shape, held.value, piece, y[own], (weight * (part == 0))[own])
                    back += more
                loss = weight * np.logaddexp(0, np.where(y == 1, -logit, logit))
                told = [batch.column("block")[row].as_py(), *[float(x[part == k].sum()) for k in (0, 1) for x in (loss, weight)], back.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in told], names=names)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")  # the same order whatever comes first
        total = np.sum([np.frombuffer(g.as_py()) for g in table["gradient"]], axis=0)
        sums = [pa.array([float(np.sum(table[c].to_numpy()))]) for c in names[1:-1]]
        return pa.table([table["block"].slice(0, 1), *sums, pa.array([total.tobytes()])], names=names)

    parts = sorted(of.mapInArrow(run, STEP).groupBy(F.pmod("block", F.lit(SUMS))).applyInArrow(add, STEP).collect())
    held.destroy()
    total = [sum(r[c] for r in parts) for c in names[1:-1]]
    back = np.sum([np.frombuffer(r["gradient"]) for r in parts], axis=0) if parts else np.zeros(shape.size)
    mean = lambda a, n: a / n if n else float("nan")
    return back / max(total[1], 1e-12), mean(total[0], total[1]), mean(total[2], total[3])


def fit(of: DataFrame, shape: Shape, steps: int, rate: float = 0.02, seed: int = 1, balanced: bool = True) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Parameters with the least loss on the validation graphs (the last without any), and the history: step, and both losses before
    it. balanced: both labels have the same weight in all. Without training graphs the parameters stay as they start."""
    counts = {r["y"]: r["n"] for r in of.select(F.explode(F.arrays_zip("y", "part")).alias("g")).where("g.part = 0").groupBy(F.col("g.y").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = tuple(sum(counts.values()) / (2 * counts[k]) if balanced and len(counts) == 2 else 1.0 for k in (0, 1))
    flat, first, second, history, best = shape.start(seed), np.zeros(shape.size), np.zeros(shape.size), [], None
    for k in range(steps + 1):
        back, loss, valid = step(of, shape, flat, weights)
        history.append((k, loss, valid))
        if best is None or not valid >= best[0]:  # also where there is nothing to validate on
            best = valid, flat.copy()
        first, second = 0.9 * first + 0.1 * back, 0.999 * second + 0.001 * back**2
        flat = flat - rate * (first / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.999 ** (k + 1))) + 1e-8)
    return best[1], history


def predict(of: DataFrame, shape: Shape, flat: np.ndarray) -> DataFrame:
    """graph_id, probability (of label 1) and hard (1 from a half on)."""
    held = of.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, of_graphs = _read(batch, row)
                p = shape.split(held.value)
                logit = np.concatenate([forward(p, shape.layers, piece)[0] for _, piece in pieces(block, PIECE)])
                p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(of_graphs["ids"], pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["graph_id", "probability", "hard"])

    return of.mapInArrow(run, "graph_id long, probability double, hard int")
