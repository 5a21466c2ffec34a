"""Minimal graph edits that change a prediction.

Edits are columns: op (remove_bond, add_bond, swap_atom, swap_bond_order), i, j and new_value. Candidates come from the
nodes at which clauses fire, in the order of clauses, nodes and bonds. The search tries the remaining candidates of all
graphs at once in each of a few rounds: every candidate gives a variant of its graph, all variants are scored together, and
each graph commits its best. `trials` encodes variants as a whole and takes any score; `near_trials` encodes only the nodes
that see the edit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from . import clauses, encoding

EDIT = ["op", "i", "j", "new_value"]


def valid_edit(op: Column, i: Column, j: Column, new_value: Column) -> Column:
    """Whether an edit has what its op needs: two different atoms for bonds, one for an atom, and a new value unless it removes."""
    pair, value = i.isNotNull() & j.isNotNull() & (i != j), new_value.isNotNull()
    return (
        F.when(op == "remove_bond", pair)
        .when(op.isin("add_bond", "swap_bond_order"), pair & value)
        .when(op == "swap_atom", i.isNotNull() & j.isNull() & value)
        .otherwise(F.lit(False))
    ) & F.coalesce(i >= 0, F.lit(False)) & F.coalesce(j >= 0, F.lit(True))


def node_candidates(nodes: DataFrame, adjacent: DataFrame, atom_types: int) -> DataFrame:
    """graph_id, node_id, kind, place and the edit: each bond at a node removed (in bond order), then its atom swapped."""
    ends = lambda a, b: (F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    cuts = adjacent.select("graph_id", F.col("src").alias("node_id"), F.lit(0).alias("kind"), F.col("edge_id").alias("place"), F.lit("remove_bond").alias("op"), *ends(F.col("src"), F.col("dst")), F.lit(None).cast("int").alias("new_value"))
    swaps = nodes.select("graph_id", "node_id", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.lit("swap_atom").alias("op"), F.col("node_id").alias("i"), F.lit(None).cast("int").alias("j"), ((F.col("atom_type") + 1) % atom_types).alias("new_value"))
    return cuts.unionByName(swaps) if atom_types > 1 else cuts


def edge_candidates(adjacent: DataFrame, bond_types: int) -> DataFrame:
    """graph_id, edge_id, kind and the edit: a bond removed, then its order changed to the next."""
    one = adjacent.where("src < dst").select("graph_id", "edge_id", "bond_type", F.col("src").alias("i"), F.col("dst").alias("j"))
    edits = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("remove_bond").alias("op"), F.lit(None).cast("int").alias("new_value")),
        F.struct(F.lit(1).alias("kind"), F.lit("swap_bond_order").alias("op"), ((F.col("bond_type") + 1) % bond_types).cast("int").alias("new_value")),
    )
    return one.select("graph_id", "edge_id", "i", "j", F.explode(edits).alias("e")).select("graph_id", "edge_id", "e.kind", "e.op", "i", "j", "e.new_value")


def candidates(firing: DataFrame, nodes: DataFrame, adjacent: DataFrame, atom_types: int, most: int = 50, firing_edges: DataFrame | None = None, bond_types: int = 1) -> DataFrame:
    """graph_id, ordinal (from 1) and the edit: the first `most` distinct edits in the order of clauses, nodes and bonds.
    firing: graph_id, clause, node_id. firing_edges: graph_id, clause, edge_id, if clauses also fire on edges; the edits of a
    clause's edges follow those of its nodes. A node or edge comes up first with its least clause: that is all that is joined."""
    first = firing.groupBy("graph_id", "node_id").agg(F.min("clause").alias("clause"))
    at = F.struct("clause", F.lit(0).alias("edges"), F.col("node_id").cast("long").alias("where"), F.col("kind"), F.col("place").cast("long").alias("place"))
    found = node_candidates(nodes, adjacent, atom_types).join(first, ["graph_id", "node_id"]).select("graph_id", *EDIT, at.alias("at"))
    if firing_edges is not None:
        first = firing_edges.groupBy("graph_id", "edge_id").agg(F.min("clause").alias("clause"))
        at = F.struct("clause", F.lit(1).alias("edges"), F.col("edge_id").cast("long").alias("where"), F.col("kind"), F.lit(0).cast("long").alias("place"))
        more = edge_candidates(adjacent, bond_types).where((F.col("op") == "remove_bond") | F.lit(bond_types > 1))
        found = found.unionByName(more.join(first, ["graph_id", "edge_id"]).select("graph_id", *EDIT, at.alias("at")))
    distinct = found.groupBy("graph_id", *EDIT).agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("at"))
    return distinct.withColumn("ordinal", rank).where(F.col("ordinal") <= most).select("graph_id", "ordinal", *EDIT)


OPS = ["remove_bond", "swap_atom", "swap_bond_order", "add_bond"]
REMOVE, SWAP, ORDER, ADD = range(4)


def machine_candidates(rows: DataFrame, score: MachineScore, atom_types: int, most: int = 50, bond_types: int = 0, flips: int | None = None) -> DataFrame:
    """What `candidates` gives for the clauses of a machine, from graphs that are gathered in rows (`encoding.gathered` of nodes and of
    bonds without loops: u, v, bond_type). bond_types: clauses also fire on bonds (where they fire at both ends), which have so many
    types; 0: they don't. flips: what `first_valid` commits of them in so many steps (graph_id, step, edit) instead.

    Clauses are evaluated, and edits ordered, by the graphs of a batch together, so nothing shuffles and no firing clause is a row."""
    spec, k, negation = score.spec, score.k, score.negation
    known, trees = encoding.codes(score.book), score.model.first()["clauses"]  # the size of the machine
    name = "ordinal" if flips is None else "step"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            n, m = (encoding.sizes(whole.column(f"__{c}")) for c in ("id", "u"))
            for batch in encoding.slices(whole, (n + 2 * m) * (k + 1)):
                graph, number, edits, _ = _ranked(batch, known, k, trees, spec, negation, atom_types, bond_types, most)
                if flips is not None:
                    owner, _ = encoding.counts_to_rows(encoding.sizes(batch.column("__u")))
                    number = _steps(graph, edits, (owner, *(encoding.flat(batch.column(f"__{c}")) for c in ("u", "v"))), flips)
                    kept = number > 0
                    graph, number, edits = graph[kept], number[kept], edits.filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(graph)), pa.array(number, pa.int32()), *edits.columns], names=["graph_id", name, *EDIT])

    kind = rows.schema["graph_id"].dataType.simpleString()
    return rows.where("graph_id is not null").mapInArrow(run, f"graph_id {kind}, {name} int, op string, i int, j int, new_value int")


def _ranked(batch: pa.RecordBatch, known: dict, k: int, trees: list, spec: clauses.Spec, negation: str, atom_types: int, bond_types: int, most: int) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]:
    """The candidates of the graphs of a batch in order: each one's graph (its row), its ordinal, and the edits; what holds at the nodes."""
    column = lambda c: batch.column(f"__{c}")
    owner, _ = encoding.counts_to_rows(encoding.sizes(column("id")))
    of_bond, _ = encoding.counts_to_rows(encoding.sizes(column("u")))
    ids, u, v = (encoding.flat(column(c)) for c in ("id", "u", "v"))
    (own, pu, pv), places = encoding.places_of([owner, of_bond, of_bond], [ids, u, v])
    if len(np.unique(own)) < len(own):
        raise ValueError("a node comes up twice in a graph")
    (atom, no_atom), (bond, no_bond) = _values(column("atom")), _values(column("bond_type"))
    edge = np.empty(len(u), np.int64)
    order = np.lexsort((bond, ~no_bond, v, u, of_bond))
    counts = np.bincount(of_bond, minlength=batch.num_rows)
    edge[order] = np.arange(len(u)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    types = np.full(places, -1)
    types[own] = np.where(no_atom, -1, atom)
    both = lambda a, b: np.concatenate([a, b])
    bonded = np.where(no_bond, -1, bond)
    hv = encoding.majorities(types, both(pu, pv), both(pv, pu), both(bonded, bonded), both(edge, edge), own, known, k, spec.features * (1 if negation == "complement" else 2))
    fired = np.zeros((places, (spec.clauses - 1) // bits.WORD + 1), np.int64)
    fired[own] = clauses.fired_rows(trees, hv, spec, negation)
    first = _first_clause(fired)
    low, high, none, some = np.minimum(u, v), np.maximum(u, v), np.ones(len(u), bool), np.zeros(len(u), bool)
    new_atom, no_atoms = np.fmod(atom + 1, max(atom_types, 1)), np.ones(len(ids), bool)
    # graph, clause, edges, where, kind, place, op, i, j, j is null, new_value, new_value is null
    parts = [(of_bond, first[end], 0, where, 0, edge, REMOVE, low, high, some, 0, none) for end, where in ((pu, u), (pv, v))]
    if atom_types > 1:
        parts.append((owner, first[own], 0, ids, 1, 0, SWAP, ids, 0, no_atoms, np.where(no_atom, 0, new_atom), no_atom))
    if bond_types:
        at_both = _first_clause(fired[pu] & fired[pv])
        parts.append((of_bond, at_both, 1, edge, 0, 0, REMOVE, low, high, some, 0, none))
        if bond_types > 1:
            parts.append((of_bond, at_both, 1, edge, 1, 0, ORDER, low, high, some, np.where(no_bond, 0, np.fmod(bond + 1, bond_types)), no_bond))
    table = np.concatenate([np.stack(np.broadcast_arrays(*part)).astype(np.int64) for part in parts], axis=1)
    table = table[:, table[1] < spec.clauses]
    table = table[:, np.lexsort(table[5::-1])]
    graph, op, i, j, no_j, value, no_value = table[[0, 6, 7, 8, 9, 10, 11]]
    # The first of each graph's equal edits stays.
    alike = np.lexsort((np.arange(len(graph)), no_value, value, no_j, j, i, op, graph))
    ahead = table[[0, 6, 7, 8, 9, 10, 11]][:, alike]
    fresh = np.ones(len(graph), bool)
    fresh[alike[1:]] = (ahead[:, 1:] != ahead[:, :-1]).any(axis=0)
    graph, op, i, j, no_j, value, no_value = (x[fresh] for x in (graph, op, i, j, no_j, value, no_value))
    counts = np.bincount(graph, minlength=batch.num_rows)
    ordinal = np.arange(len(graph)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    kept = ordinal <= most
    number = lambda x, null: pa.array(x[kept].astype(np.int32), mask=null[kept].astype(bool))
    edits = pa.RecordBatch.from_arrays([pa.array(OPS).take(pa.array(op[kept])), pa.array(i[kept].astype(np.int32)), number(j, no_j), number(value, no_value)], names=EDIT)
    return graph[kept], ordinal[kept], edits, fired[own]


class _Graphs:
    """The graphs of a batch as flat arrays, which edits change; fired: the clauses that hold at each node, in words."""

    def __init__(self, batch: pa.RecordBatch, fired: np.ndarray) -> None:
        column, sizes = lambda c: batch.column(f"__{c}"), lambda c: encoding.sizes(batch.column(f"__{c}"))
        self.rows, self.fired = batch.num_rows, fired
        self.owner, self.of = encoding.counts_to_rows(sizes("id"))[0], encoding.counts_to_rows(sizes("u"))[0]
        self.id, self.atom, self.u, self.v, self.bond_type = (encoding.flat(column(c)) for c in ("id", "atom", "u", "v", "bond_type"))

    def sums(self, spec: clauses.Spec) -> np.ndarray:
        every = np.zeros((self.rows, self.fired.shape[1]), np.int64)
        np.bitwise_or.at(every, self.owner, self.fired)
        return clauses.class_sums(every, spec)

    def applicable(self, graph: np.ndarray, edits: pa.RecordBatch) -> np.ndarray:
        """Which edits have their bond (or, to add one, don't)."""
        op, i, j, _, pair = _columns(edits)
        (asked, there), _ = encoding.places_of([graph, self.of], [i, self.u])
        (asked, there), _ = encoding.places_of([asked, there], [j, self.v])
        held = np.isin(asked, there) & pair
        return (((op == "remove_bond") | (op == "swap_bond_order")) & held) | ((op == "add_bond") & ~held) | (op == "swap_atom")

    def tried(self, graph: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> np.ndarray:
        """The class sum of each edit's variant. Edits come by graph."""
        if not len(graph):
            return np.zeros(0, np.int64)
        lists = lambda values, of: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(self.rows + 1)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
        words = self.fired.shape[1]
        fired = pa.ListArray.from_arrays(pa.array(np.arange(len(self.fired) + 1) * words, pa.int32()), pa.array(self.fired.reshape(-1)))
        own = {"ordinal": lists(graph, graph), **{c: lists(edits.column(c), graph) for c in EDIT}}
        own |= {"id": lists(self.id, self.owner), "atom": lists(self.atom, self.owner), "at": lists(self.id, self.owner), "fired": lists(fired, self.owner)}
        own |= {c: lists(getattr(self, c), self.of) for c in ("u", "v", "bond_type")}
        return _tried(pa.RecordBatch.from_arrays(list(own.values()), names=[f"__{c}" for c in own]), *machine)[1]

    def apply(self, graph: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> None:
        """One edit at most for a graph."""
        op, i, j, value, pair = _columns(edits)
        at = np.full(self.rows, -1)
        at[graph] = np.arange(len(graph))
        node, bond = at[self.owner], at[self.of]
        swapped = (node >= 0) & (op[node] == "swap_atom") & (self.id == i[node])
        self.atom = np.where(swapped, value[node], self.atom)
        here = (bond >= 0) & pair[bond] & (self.u == i[bond]) & (self.v == j[bond])
        self.bond_type = np.where(here & (op[bond] == "swap_bond_order"), value[bond], self.bond_type)
        stays, added = ~(here & (op[bond] == "remove_bond")), (op == "add_bond") & pair
        parts = [(self.of, graph), (self.u, np.minimum(i, j)), (self.v, np.maximum(i, j)), (self.bond_type, value)]
        order = np.argsort(np.concatenate([self.of[stays], graph[added]]), kind="stable")
        self.of, self.u, self.v, self.bond_type = (np.concatenate([a[stays], b[added]])[order] for a, b in parts)
        known, k, trees, spec, negation = machine
        (own, pu, pv), places = encoding.places_of([self.owner, self.of, self.of], [self.id, self.u, self.v])
        edge = np.empty(len(self.u), np.int64)
        edge[np.lexsort((self.bond_type, self.v, self.u, self.of))] = np.arange(len(self.u))
        types = np.full(places, -1)
        types[own] = self.atom
        both = lambda a, b: np.concatenate([a, b])
        anew = at[self.owner] >= 0
        bonds = [both(pu, pv), both(pv, pu), both(self.bond_type, self.bond_type), both(edge, edge)]
        hv = encoding.majorities(types, *bonds, own[anew], known, k, spec.features * (1 if negation == "complement" else 2))
        self.fired = self.fired.copy()
        self.fired[anew] = clauses.fired_rows(trees, hv, spec, negation)


def _columns(edits: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """op, i, j and new_value (-1: null), and whether both ends are there."""
    op, (i, j, value) = np.array(edits.column("op").to_pylist(), object), (edits.column(c) for c in EDIT[1:])
    pair = i.is_valid().to_numpy(zero_copy_only=False) & j.is_valid().to_numpy(zero_copy_only=False)
    return op, *(x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (i, j, value)), pair


def _best(graph: np.ndarray, ordinal: np.ndarray, sums: np.ndarray, target: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `best_steps` takes: the places of these edits; of all edits the margin after, and whether they flip. target and margin: by graph."""
    after, flipped = np.where(target[graph] == 1, sums, -sums), (sums > 0) != (target[graph] == 1)
    order = np.lexsort((ordinal, after, ~flipped, graph))
    first = order[np.unique(graph[order], return_index=True)[1]]
    return first[flipped[first] | (after[first] < margin[graph[first]])], after, flipped


def _machine_pass(rows: DataFrame, score: MachineScore, atom_types: int, most: int, bond_types: int, schema: str, give: Callable[..., dict]) -> DataFrame:
    """What `give` gives of the graphs of each batch: give(graphs, graph, ordinal, edits, machine), by graph (a row's place) and columns."""
    spec, k, negation = score.spec, score.k, score.negation
    machine = encoding.codes(score.book), k, score.model.first()["clauses"], spec, negation  # the size of the machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            n, m = (encoding.sizes(whole.column(f"__{c}")) for c in ("id", "u"))
            for batch in encoding.slices(whole, np.minimum(most, n + 2 * m) * (n + m) * (k + 1)):
                graph, ordinal, edits, fired = _ranked(batch, *machine, atom_types, bond_types, most)
                of, *columns = give(_Graphs(batch, fired), graph, ordinal, edits, machine)
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(of)), *columns], names=["graph_id", *(c.split()[0] for c in schema.split(", "))])

    return rows.where("graph_id is not null").mapInArrow(run, f"graph_id {rows.schema['graph_id'].dataType.simpleString()}, {schema}")


@dataclass(frozen=True)
class Own:
    """The edits that `machine_candidates` finds in graphs that are gathered in rows."""

    rows: Callable[[], DataFrame]
    atom_types: int
    bond_types: int = 0


_EDIT_TYPES = "op string, i int, j int, new_value int"


def machine_trials(rows: DataFrame, score: MachineScore, atom_types: int, most: int = 50, bond_types: int = 0) -> DataFrame:
    """What `trials` gives of the candidates that `machine_candidates` gives of such rows, in the same pass: a candidate is never written."""

    def give(graphs: _Graphs, graph: np.ndarray, ordinal: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> tuple:
        return graph, pa.array(ordinal, pa.int32()), *edits.columns, pa.array(graphs.tried(graph, edits, machine), pa.int32())

    return _machine_pass(rows, score, atom_types, most, bond_types, f"ordinal int, {_EDIT_TYPES}, class_sum int", give)


def machine_steps(rows: DataFrame, score: MachineScore, atom_types: int, most: int = 50, bond_types: int = 0) -> DataFrame:
    """What `best_steps` gives of these trials, for the class that the machine predicts."""

    def give(graphs: _Graphs, graph: np.ndarray, ordinal: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> tuple:
        now = graphs.sums(machine[3])
        best, after, flipped = _best(graph, ordinal, graphs.tried(graph, edits, machine), (now > 0).astype(np.int64), np.abs(now))
        return graph[best], pa.array(ordinal[best], pa.int32()), *edits.take(pa.array(best, pa.int64())).columns, pa.array(after[best], pa.int32()), pa.array(flipped[best])

    return _machine_pass(rows, score, atom_types, most, bond_types, f"ordinal int, {_EDIT_TYPES}, margin int, flipped boolean", give)


def machine_trace(rows: DataFrame, score: MachineScore, atom_types: int, most: int = 50, bond_types: int = 0) -> DataFrame:
    """What `trace` gives of these trials and steps: a row for each graph that has candidates."""

    def give(graphs: _Graphs, graph: np.ndarray, ordinal: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> tuple:
        now = graphs.sums(machine[3])
        best, _, flipped = _best(graph, ordinal, graphs.tried(graph, edits, machine), (now > 0).astype(np.int64), np.abs(now))
        of = np.unique(graph)
        counts = (np.bincount(x, minlength=graphs.rows)[of] for x in (graph, graph[flipped], graph[best]))
        return of, *(pa.array(x, pa.int64()) for x in counts)

    return _machine_pass(rows, score, atom_types, most, bond_types, "tried long, flips long, committed long", give)


def machine_search(rows: DataFrame, score: MachineScore, atom_types: int, max_flips: int = 3, most: int = 50, bond_types: int = 0, target: int = 1) -> DataFrame:
    """What `search` gives of the graphs that the machine predicts to be of class `target`, whose edits are `machine_candidates`: all rounds
    are taken where a graph is gathered, and nothing is passed on between them."""

    def give(graphs: _Graphs, graph: np.ndarray, ordinal: np.ndarray, edits: pa.RecordBatch, machine: tuple) -> tuple:
        now = graphs.sums(machine[3])
        leaves, margin, done = np.full(graphs.rows, target), np.abs(now), np.zeros(graphs.rows, bool)
        step_of, open_ = np.zeros(len(graph), np.int64), (now > 0) == (target == 1)
        for step in range(1, max_flips + 1):
            usable = np.flatnonzero(open_[graph] & (step_of == 0) & graphs.applicable(graph, edits))
            if not len(usable):
                break
            own = edits.take(pa.array(usable))
            best, after, flipped = _best(graph[usable], ordinal[usable], graphs.tried(graph[usable], own, machine), leaves, margin)
            step_of[usable[best]] = step
            open_ = np.zeros(graphs.rows, bool)
            goes_on = best[~flipped[best]]
            done[graph[usable[best[flipped[best]]]]] = True
            open_[graph[usable[goes_on]]] = True
            margin[graph[usable[goes_on]]] = after[goes_on]
            if step < max_flips and len(goes_on):
                graphs.apply(graph[usable[goes_on]], own.take(pa.array(goes_on)), machine)
        kept = np.flatnonzero((step_of > 0) & done[graph])
        return graph[kept], pa.array(step_of[kept], pa.int32()), *edits.take(pa.array(kept)).columns

    return _machine_pass(rows, score, atom_types, most, bond_types, f"step int, {_EDIT_TYPES}", give)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of arrays, one after another, and which of them are null (0 there)."""
    values = column.flatten()
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_null().to_numpy(zero_copy_only=False)


def _first_clause(fired: np.ndarray) -> np.ndarray:
    """The least clause that holds, from rows of words; a large number where none does."""
    out = np.full(len(fired), np.iinfo(np.int64).max)
    for w in range(fired.shape[1] - 1, -1, -1):
        least = fired[:, w] & -fired[:, w]
        out = np.where(least > 0, w * bits.WORD + np.frexp(least.astype(float))[1] - 1, out)
    return out


def _steps(graph: np.ndarray, edits: pa.RecordBatch, bonds: tuple[np.ndarray, np.ndarray, np.ndarray], flips: int) -> np.ndarray:
    """The step (from 1) that commits each edit, or 0: every step takes each graph's first edit left that applies to what the steps
    before have made. Edits come by graph, in order. bonds: graph, u and v of each."""
    op = np.array(edits.column("op").to_pylist(), object)
    i, j = (edits.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j"))
    has_i, has_j = (edits.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("i", "j"))
    pair, adds = has_i & has_j, op == "add_bond"
    # A null end is left out of the least and the greatest, as SQL does.
    least, greatest = np.where(pair, np.minimum(i, j), np.where(has_i, i, j)), np.where(pair, np.maximum(i, j), np.where(has_i, i, j))
    ends = np.unique(np.concatenate([i, j, bonds[1], bonds[2]]), return_inverse=True)[1] if len(i) else np.zeros(0, np.int64)
    width, n = int(ends.max(initial=0)) + 1, len(i)
    number_i, number_j, number_u, number_v = ends[:n], ends[n : 2 * n], ends[2 * n : 2 * n + len(bonds[1])], ends[2 * n + len(bonds[1]) :]
    if not n:
        return np.zeros(0, np.int64)
    number_least = np.where(least == i, number_i, number_j)
    number_greatest = np.where(greatest == j, number_j, number_i)
    key = lambda g, a, b: (g * width + a) * width + b
    _, place = np.unique(np.concatenate([key(graph, number_i, number_j), key(graph, number_least, number_greatest), key(bonds[0], number_u, number_v)]), return_inverse=True)
    asked, made, there = place[:n], place[n : 2 * n], place[2 * n :]
    present = np.zeros(int(place.max()) + 1, bool)
    present[there] = True
    step_of = np.zeros(n, np.int64)
    bonds_asked = (op == "remove_bond") | (op == "swap_bond_order")
    for step in range(1, flips + 1):
        held = present[asked] & pair
        usable = np.flatnonzero((step_of == 0) & ((bonds_asked & held) | (adds & ~held) | (op == "swap_atom")))
        if not len(usable):
            break
        chosen = usable[np.unique(graph[usable], return_index=True)[1]]
        step_of[chosen] = step
        present[asked[chosen[op[chosen] == "remove_bond"]]] = False
        present[made[chosen[adds[chosen] & (has_i | has_j)[chosen]]]] = True
    return step_of


def applicable(edits: DataFrame, bonds: DataFrame) -> DataFrame:
    """The edits whose bonds are there (or, for add_bond, are not): semi and anti joins."""
    pairs = bonds.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"))
    there = edits.where(F.col("op").isin("remove_bond", "swap_bond_order")).join(pairs, ["graph_id", "i", "j"], "left_semi")
    absent = edits.where(F.col("op") == "add_bond").join(pairs, ["graph_id", "i", "j"], "left_anti")
    return there.unionByName(absent).unionByName(edits.where(F.col("op") == "swap_atom"))


def checked(edits: DataFrame, nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """The edits as they are; an error if one removes or changes a bond that is not there, adds one that is, or swaps an atom
    that its graph lacks."""
    pairs = bonds.select("graph_id", F.least("u", "v").alias("__i"), F.greatest("u", "v").alias("__j"), F.lit(True).alias("__bond")).distinct()
    atoms = nodes.select("graph_id", F.col("node_id").alias("__i"), F.lit(True).alias("__atom"))
    i, j = F.least("i", F.coalesce("j", "i")), F.greatest("i", F.coalesce("j", "i"))
    joined = edits.withColumn("__i", i).withColumn("__j", j).join(pairs, ["graph_id", "__i", "__j"], "left")
    joined = joined.withColumn("__i", F.col("i")).join(atoms, ["graph_id", "__i"], "left")
    bond, atom = F.col("__bond").isNotNull(), F.col("__atom").isNotNull()
    fits = F.when(F.col("op").isin("remove_bond", "swap_bond_order"), bond).when(F.col("op") == "add_bond", ~bond).when(F.col("op") == "swap_atom", atom).otherwise(F.lit(False))
    what = F.concat_ws(" ", F.lit("edit does not apply:"), F.col("op"), F.col("i").cast("string"), F.col("j").cast("string"), F.lit("in graph"), F.col("graph_id").cast("string"))
    return joined.withColumn("op", F.when(fits, F.col("op")).otherwise(F.raise_error(what))).select(*edits.columns)


def apply_edits(nodes: DataFrame, bonds: DataFrame, edits: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and bonds of a variant for each edit: graph_id, ordinal and what nodes and bonds have. edits: graph_id, ordinal, edit.
    strict: an edit that doesn't apply is an error (`checked`); else the caller has removed these (`applicable`)."""
    edits = checked(edits, nodes, bonds) if strict else edits
    atoms = nodes.join(edits, "graph_id").select("graph_id", "ordinal", "node_id", F.when((F.col("op") == "swap_atom") & (F.col("node_id") == F.col("i")), F.col("new_value")).otherwise(F.col("atom_type")).alias("atom_type"))
    at = (F.col("u") == F.col("i")) & (F.col("v") == F.col("j"))
    joined = bonds.join(edits, "graph_id").where(~((F.col("op") == "remove_bond") & F.coalesce(at, F.lit(False))))
    order = F.when((F.col("op") == "swap_bond_order") & at, F.col("new_value")).otherwise(F.col("bond_type"))
    left = joined.select("graph_id", "ordinal", "u", "v", order.alias("bond_type"))
    added = edits.where(F.col("op") == "add_bond").select("graph_id", "ordinal", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), F.col("new_value").alias("bond_type"))
    return atoms, left.unionByName(added)


def _numbered(df: DataFrame, most: int) -> DataFrame:
    """Variants as graphs of their own: graph_id and ordinal in one number."""
    return df.withColumn("graph_id", F.col("graph_id") * (most + 1) + F.col("ordinal")).drop("ordinal")


Score = Callable[[DataFrame, DataFrame], DataFrame]


def trials(nodes: DataFrame, bonds: DataFrame, edits: DataFrame, score: Score, most: int = 50) -> DataFrame:
    """edits with class_sum, the score of each one's variant. score: nodes and bonds to graph_id and class_sum."""
    atoms, left = apply_edits(nodes, bonds, edits)
    scored = score(_numbered(atoms, most), _numbered(left, most))
    return edits.withColumn("variant", F.col("graph_id") * (most + 1) + F.col("ordinal")).join(scored.withColumnRenamed("graph_id", "variant"), "variant").drop("variant")


def near_trials(nodes: DataFrame, bonds: DataFrame, edits: DataFrame, fired: DataFrame, book: DataFrame, k: int, model: DataFrame, spec: clauses.Spec, negation: str = "complement") -> DataFrame:
    """What `trials` gives for a clause machine over k hops, from what holds at the nodes now (fired: graph_id, node_id, fired).

    An edit changes nothing but the vectors of nodes that see it: those within k hops of a swapped atom, or within k - 1 of an end of
    a bond. Only these are encoded and evaluated anew; other nodes keep what holds there. A graph is gathered once, with its edits, and
    all variants of the graphs of a batch are worked on together."""
    if not 0 <= k <= 7:
        raise ValueError("k is from 0 to 7")
    rows = encoding.gathered(nodes, bonds.where("u <> v"), ["u", "v", "bond_type"])
    lists = lambda df, names: df.groupBy("graph_id").agg(F.collect_list(F.struct(*names)).alias("__l"))
    asked = lists(edits, ["ordinal", *EDIT]).select("graph_id", *[F.col(f"__l.{c}").alias(f"__{c}") for c in ("ordinal", *EDIT)])
    held = lists(fired, ["node_id", "fired"]).select("graph_id", F.col("__l.node_id").alias("__at"), F.col("__l.fired").alias("__fired"))
    rows = asked.join(rows, "graph_id").join(held, "graph_id", "left")
    known, trees = encoding.codes(book), model.first()["clauses"]  # the size of the machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            n, m, e = (encoding.sizes(whole.column(f"__{c}")) for c in ("id", "u", "ordinal"))
            for batch in encoding.slices(whole, e * (n + m) * (k + 1)):
                owner, sums = _tried(batch, known, k, trees, spec, negation)
                own = [batch.column(f"__{c}").flatten() for c in ("ordinal", *EDIT)]
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(owner)), *own, pa.array(sums, pa.int32())], names=["graph_id", "ordinal", *EDIT, "class_sum"])

    kinds = ", ".join(f"{c} {edits.schema[c].dataType.simpleString()}" for c in ("graph_id", "ordinal", *EDIT))
    return rows.mapInArrow(run, f"{kinds}, class_sum int")


def _tried(batch: pa.RecordBatch, known: dict, k: int, trees: list, spec: clauses.Spec, negation: str) -> tuple[np.ndarray, np.ndarray]:
    """For every edit of the graphs of a batch: the graph's row, and the class sum of the variant."""
    column = lambda c: batch.column(f"__{c}")
    count = {c: encoding.sizes(column(c)) for c in ("ordinal", "id", "u", "at")}
    first = {c: np.cumsum(n) - n for c, n in count.items()}
    graph, _ = encoding.counts_to_rows(count["ordinal"])
    op = np.array(column("op").flatten().to_pylist(), object)
    i, j, value = (encoding.flat(column(c)) for c in ("i", "j", "new_value"))
    has_i, has_j = (column(c).flatten().is_valid().to_numpy(zero_copy_only=False) for c in ("i", "j"))
    swap = op == "swap_atom"

    def each(c: str) -> tuple[np.ndarray, np.ndarray]:
        """For every item of a variant's graph: the variant, and the item's place in the batch."""
        variant, place = encoding.counts_to_rows(count[c][graph])
        return variant, first[c][graph][variant] + place

    variant, item = each("id")
    ids, atoms = encoding.flat(column("id"))[item], encoding.flat(column("atom"))[item]
    atoms = np.where(swap[variant] & has_i[variant] & (ids == i[variant]), value[variant], atoms)
    of_bond, item = each("u")
    u, v, bond = (encoding.flat(column(c))[item] for c in ("u", "v", "bond_type"))
    of_fired, item = each("at")
    at = encoding.flat(column("at"))[item]
    words = (spec.clauses - 1) // bits.WORD + 1
    words_at = column("fired").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, words)[item] if len(item) else np.zeros((0, words), np.int64)
    added = np.flatnonzero((op == "add_bond") & has_i & has_j)
    new_u, new_v = np.minimum(i, j)[added], np.maximum(i, j)[added]
    start_i, start_j = np.flatnonzero(has_i), np.flatnonzero(has_j & ~swap)
    (own, pu, pv, fired_at, pi, pj, au, av), n = encoding.places_of([variant, of_bond, of_bond, of_fired, start_i, start_j, added, added], [ids, u, v, at, i[start_i], j[start_j], new_u, new_v])
    # Which nodes see the edit, by the bonds as they are.
    seen = np.zeros(n, bool)
    seen[pi] = seen[pj] = True
    for hop in range(k):
        goes = swap[of_bond] | (hop < k - 1)
        beyond = np.concatenate([pv[goes & seen[pu]], pu[goes & seen[pv]]])
        seen[beyond] = True
    is_root = seen[own]
    sees = np.zeros(len(op), bool)
    sees[variant[is_root]] = True
    head = np.ones(len(own), bool)
    head[1:] = variant[1:] != variant[:-1]
    is_root |= head & ~sees[variant]  # an edit that no node sees: one node stands for the graph
    roots, of_root = own[is_root], variant[is_root]
    anew = np.zeros(n, bool)
    anew[roots] = True
    # The graph after the edit.
    here = has_i[of_bond] & has_j[of_bond] & (u == i[of_bond]) & (v == j[of_bond])
    bond = np.where(here & (op == "swap_bond_order")[of_bond], value[of_bond], bond)
    stays = ~(here & (op == "remove_bond")[of_bond])
    pu, pv, bond = (np.concatenate([a[stays], b]) for a, b in ((pu, au), (pv, av), (bond, value[added])))
    owner, u, v = (np.concatenate([a[stays], b]) for a, b in ((of_bond, added), (u, new_u), (v, new_v)))
    edge = np.empty(len(u), np.int64)
    edge[np.lexsort((bond, v, u, owner))] = np.arange(len(u))
    types = np.full(n, -1)
    types[own] = atoms
    both = lambda a, b: np.concatenate([a, b])
    read = spec.features * (1 if negation == "complement" else 2)
    hv = encoding.majorities(types, both(pu, pv), both(pv, pu), both(bond, bond), both(edge, edge), roots, known, k, read)
    every = np.zeros((len(op), words), np.int64)
    others = ~anew[fired_at]
    np.bitwise_or.at(every, of_fired[others], words_at[others])
    np.bitwise_or.at(every, of_root, clauses.fired_rows(trees, hv, spec, negation))
    return graph, clauses.class_sums(every, spec)


class MachineScore:
    """The score of a clause machine over k hops: of whole graphs, and of edits by what they change (`near_trials`)."""

    def __init__(self, book: DataFrame, k: int, dim: int, model: DataFrame, spec: clauses.Spec, negation: str = "complement") -> None:
        self.book, self.k, self.dim, self.model, self.spec, self.negation = book, k, dim, model, spec, negation

    def fired(self, nodes: DataFrame, bonds: DataFrame) -> DataFrame:
        """graph_id, node_id, fired: the clauses that hold at each node."""
        read = self.spec.features * (1 if self.negation == "complement" else 2)
        return clauses.fired_words(encoding.node_vectors(nodes, encoding.adjacency(bonds), self.book, self.k, self.dim, read), self.model, self.spec, self.negation)

    def __call__(self, nodes: DataFrame, bonds: DataFrame) -> DataFrame:
        own = clauses.graph_clauses(self.fired(nodes, bonds))
        return own.select("graph_id", clauses.class_sum(F.col("fired"), self.spec).alias("class_sum"))

    def trials(self, nodes: DataFrame, bonds: DataFrame, edits: DataFrame, fired: DataFrame | None = None) -> DataFrame:
        """edits with class_sum. fired: what holds at the nodes, if it is known; else the graphs that have edits are encoded."""
        if fired is None:
            fired = self.fired(nodes.join(edits.select("graph_id").distinct(), "graph_id", "left_semi"), bonds)
        return near_trials(nodes, bonds, edits, fired, self.book, self.k, self.model, self.spec, self.negation)


def best_steps(tried: DataFrame, state: DataFrame) -> DataFrame:
    """graph_id, ordinal, edit, margin and flipped of each graph's best trial: one that changes the class before any that does
    not, then the least margin, then the first; only if it flips or lowers the margin. state: graph_id, target (the class to
    leave), margin (now). The margin is the target class's score less the other's."""
    joined = tried.join(state, "graph_id")
    after = F.when(F.col("target") == 1, F.col("class_sum")).otherwise(-F.col("class_sum"))
    flipped = (F.col("class_sum") > 0).cast("int") != F.col("target")
    chosen = joined.withColumn("now", F.col("margin")).withColumn("margin", after).withColumn("flipped", flipped)
    best = chosen.groupBy("graph_id").agg(F.min_by(F.struct("ordinal", *EDIT, "margin", "flipped", "now"), F.struct(~F.col("flipped"), "margin", "ordinal")).alias("b"))
    return best.select("graph_id", "b.*").where(F.col("flipped") | (F.col("margin") < F.col("now"))).drop("now")


def search(nodes: DataFrame, bonds: DataFrame, edits: DataFrame | Own, state: DataFrame, score: Score, fixed: Callable[[DataFrame], DataFrame], max_flips: int = 3, most: int = 50, valid: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """graph_id, step and edit of every committed edit of the graphs that flip within max_flips; graphs that don't have no row.

    All graphs take a round together; a graph stops when it flips or when no candidate helps. fixed: writes a small table
    and reads it again, so that plans don't grow with the rounds. valid: the variants (graph_id) that may be committed. score: a
    function of nodes and bonds, or a MachineScore. edits may be a machine's `Own`, of the graphs that it predicts positive: then nothing
    else is read, and all rounds are taken in one pass (`machine_search`)."""
    if isinstance(edits, Own):
        if valid is not None or not isinstance(score, MachineScore):
            raise ValueError("a machine's own candidates are scored by it, and all of them are valid")
        return machine_search(edits.rows(), score, edits.atom_types, max_flips, most, edits.bond_types)
    if max_flips < 1:
        return edits.where(F.lit(False)).select("graph_id", F.lit(1).alias("step"), *EDIT)
    open_, committed = state, None
    for step in range(1, max_flips + 1):
        usable = applicable(edits.join(open_.select("graph_id"), "graph_id", "left_semi"), bonds)
        tried = score.trials(nodes, bonds, usable) if isinstance(score, MachineScore) else trials(nodes, bonds, usable, score, most)
        if valid is not None:
            atoms, left = apply_edits(nodes, bonds, usable)
            good = valid(_numbered(atoms, most), _numbered(left, most)).select(F.col("graph_id").alias("variant"))
            tried = tried.withColumn("variant", F.col("graph_id") * (most + 1) + F.col("ordinal")).join(good, "variant", "left_semi").drop("variant")
        steps = fixed(best_steps(tried, open_).withColumn("step", F.lit(step)))
        committed = steps if committed is None else committed.unionByName(steps)
        if step == max_flips:
            break
        atoms, left = apply_edits(nodes, bonds, steps.where("not flipped").select("graph_id", "ordinal", *EDIT))
        nodes, bonds = fixed(atoms.drop("ordinal")), fixed(left.drop("ordinal"))
        edits = edits.join(steps, ["graph_id", "ordinal"], "left_anti")
        open_ = fixed(steps.where("not flipped").select("graph_id", "margin").join(open_.select("graph_id", "target"), "graph_id"))
    done = committed.where("flipped").select("graph_id").distinct()
    return committed.join(done, "graph_id", "left_semi").select("graph_id", "step", *EDIT)


def first_valid(nodes: DataFrame, bonds: DataFrame, edits: DataFrame, fixed: Callable[[DataFrame], DataFrame], max_flips: int = 3, most: int = 50, valid: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """graph_id, step and edit: without an encoder nothing can be scored, so each step commits the first remaining edit that
    applies and is valid, up to max_flips of them; graphs without any have no row. All graphs take a step together.

    Where every edit is valid, a graph's edits and bonds are gathered once and all steps are taken there."""
    if valid is None:
        return _first_of_all(bonds, edits, max_flips)
    committed = None
    for step in range(1, max_flips + 1):
        usable = applicable(edits, bonds)
        atoms, left = apply_edits(nodes, bonds, usable)
        good = valid(_numbered(atoms, most), _numbered(left, most)).select(F.col("graph_id").alias("variant"))
        usable = usable.withColumn("variant", F.col("graph_id") * (most + 1) + F.col("ordinal")).join(good, "variant", "left_semi").drop("variant")
        steps = usable.groupBy("graph_id").agg(F.min_by(F.struct("ordinal", *EDIT), "ordinal").alias("b")).select("graph_id", "b.*")
        steps = fixed(steps.withColumn("step", F.lit(step)))
        committed = steps if committed is None else committed.unionByName(steps)
        if step < max_flips:
            atoms, left = apply_edits(nodes, bonds, steps)
            nodes, bonds = fixed(atoms.drop("ordinal")), fixed(left.drop("ordinal"))
            edits = edits.join(steps, ["graph_id", "ordinal"], "left_anti").join(steps.select("graph_id"), "graph_id", "left_semi")
    return committed.select("graph_id", "step", *EDIT)


def _first_of_all(bonds: DataFrame, edits: DataFrame, max_flips: int) -> DataFrame:
    lists = lambda df, names: df.where("graph_id is not null").groupBy("graph_id").agg(F.collect_list(F.struct(*names)).alias("__l"))
    columns = ["ordinal", *EDIT]
    asked = lists(edits, columns).select("graph_id", *[F.col(f"__l.{c}").alias(f"__{c}") for c in columns])
    held = lists(bonds.where("u is not null and v is not null"), ["u", "v"]).select("graph_id", F.col("__l.u").alias("__u"), F.col("__l.v").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            e, m = (encoding.sizes(whole.column(f"__{c}")) for c in ("ordinal", "u"))
            for batch in encoding.slices(whole, e + m):
                graph, _ = encoding.counts_to_rows(encoding.sizes(batch.column("__ordinal")))
                owner, _ = encoding.counts_to_rows(encoding.sizes(batch.column("__u")))
                order = np.lexsort((encoding.flat(batch.column("__ordinal")), graph))
                own = pa.RecordBatch.from_arrays([batch.column(f"__{c}").flatten() for c in EDIT], names=EDIT).take(pa.array(order))
                step = _steps(graph, own, (owner, *(encoding.flat(batch.column(f"__{c}")) for c in ("u", "v"))), max_flips)
                kept = step > 0
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(graph[kept])), pa.array(step[kept], pa.int32()), *own.filter(pa.array(kept)).columns], names=["graph_id", "step", *EDIT])

    kinds = {c: edits.schema[c].dataType.simpleString() for c in ("graph_id", *EDIT)}
    return asked.join(held, "graph_id", "left").mapInArrow(run, f"graph_id {kinds['graph_id']}, step int, " + ", ".join(f"{c} {kinds[c]}" for c in EDIT))


def evaluation(asked: DataFrame, steps: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """One row: n_evaluated, successes, success_rate, mean_flips, flips_p50 and flips_p95 of a search, and latency_ms_p50, p95
    and p99 if seconds (graph_id, seconds) are given. asked: graph_id of all graphs that were searched for; steps: as `search`
    gives them. Rates are null without graphs, means without successes."""
    from .metrics import percentiles

    flips = steps.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("flips"))
    own = asked.select("graph_id").distinct().join(flips, "graph_id", "left")
    out = own.agg(F.count(F.lit(1)).alias("n_evaluated"), F.count("flips").alias("successes"), F.avg("flips").alias("mean_flips"))
    out = out.withColumn("success_rate", F.col("successes") / F.nullif(F.col("n_evaluated"), F.lit(0)))
    out = out.join(percentiles(own, [], "flips").select(F.col("p50").alias("flips_p50"), F.col("p95").alias("flips_p95")), F.lit(True))
    if seconds is not None:
        ms = percentiles(seconds.withColumn("ms", F.col("seconds") * 1000), [], "ms")
        out = out.join(ms.select(*[F.col(f"p{q}").alias(f"latency_ms_p{q}") for q in (50, 95, 99)]), F.lit(True))
    return out


def top_edits(steps: DataFrame, k: int = 10) -> DataFrame:
    """op, i, j and n of the k edits that are committed most, ties by the edit."""
    from .metrics import top_counts

    return top_counts(steps, ["op", "i", "j"], k)


def trace(steps: DataFrame, tried: DataFrame) -> DataFrame:
    """graph_id, tried, flips, committed: how many candidates were tried, how many of them flip, how many edits were committed."""
    counts = tried.groupBy("graph_id").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("flips")).alias("flips"))
    edits = steps.groupBy("graph_id").agg(F.count(F.lit(1)).alias("committed"))
    return counts.join(edits, "graph_id", "left").fillna(0, ["committed"])


def reports(steps: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """graph_id and report (JSON): the edits in order, the class and score before and after, whether it flipped, how many edits.
    before and after: graph_id, pred, class_sum."""
    edits = steps.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("step", *EDIT))).alias("edits"))
    one = lambda df, name: df.select("graph_id", F.struct(F.col("pred").alias("class"), F.col("class_sum").alias("score")).alias(name))
    joined = one(before, "before").join(one(after, "after"), "graph_id", "left").join(edits, "graph_id", "left")
    n = F.coalesce(F.size("edits"), F.lit(0))
    flipped = (F.col("before.class") != F.col("after.class")).alias("flipped")
    return joined.select("graph_id", F.to_json(F.struct(F.coalesce("edits", F.array()).alias("edits"), F.struct("before", "after").alias("prediction"), flipped, F.greatest(n, F.lit(0)).alias("n_edits"))).alias("report"))
