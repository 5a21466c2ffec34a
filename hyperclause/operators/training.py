"""Training of clause machines, and the teachers and baselines beside them.

What a sample changes depends on all samples before it, so one machine is trained by one task; seeds (and other settings)
are independent and are dealt out as groups: `groupBy(seed).applyInPandas`. The training rows of a machine must fit a task;
callers pass a bounded table.

Nothing is drawn from a generator with a state of its own. Every draw is a hash of the seed, the number of the update (step), what
is drawn for, and the place of the leaf or automaton, so any engine can replay a training and come to each state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, draw_array
from . import encoding
from .clauses import Spec


#: What is drawn for; a draw's counter is four times the step (or epoch) and this.
LEAF, AUTOMATON, NODE, ORDER = range(4)


def shuffled(n: int, epoch: int, seed: int) -> np.ndarray:
    """The order of samples 0 to n - 1 in an epoch: by draws, ties by number."""
    return np.argsort(draw_array(4 * epoch + ORDER, np.arange(n), seed), kind="stable")


class Machine:
    """States [clause, j, k, l, m, literal]; literals are the features of a leaf, then their negations. A place's number is that in
    this order; s counts in tenths."""

    def __init__(self, spec: Spec, seed: int, balanced: bool = True, boost: bool = True) -> None:
        self.spec, self.boost, self.seed, self.step, self.epoch, self.tenths = spec, boost, seed, 0, 0, round(10 * spec.s)
        shape = (spec.clauses, spec.root, spec.inner_or, spec.inner_and, spec.leaf_or, spec.leaf_and)
        coin = draw_array(0, np.arange(np.prod(shape)), seed + 1).reshape(shape) // 8 % 2 if balanced else np.zeros(shape, np.int64)
        self.state = np.concatenate([spec.states + coin, spec.states + (1 - coin if balanced else coin)], axis=-1).astype(np.int32)
        self.sign = np.where(np.arange(spec.clauses) % 2 == 0, 1, -1)
        j, l, n = np.arange(spec.root)[:, None, None], np.arange(spec.inner_and)[:, None], np.arange(spec.leaf_and)  # noqa: E741
        self.feature = j * spec.inner_and * spec.leaf_and + l * spec.leaf_and + n  # [j, l, n]

    def literals(self, x: np.ndarray) -> np.ndarray:
        """[j, 1, l, 1, literal] of one sample."""
        own = x[self.feature].astype(bool)
        return np.concatenate([own, ~own], axis=-1)[:, None, :, None, :]

    def evaluate(self, lit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Leaves and the values of all inner nodes up to the clauses."""
        leaf = (lit | (self.state <= self.spec.states)).all(axis=-1)
        ors = leaf.sum(axis=-1, dtype=np.int64)
        ands = ors.prod(axis=-1)
        inner = ands.sum(axis=-1)
        return leaf, ors, ands, inner, inner.prod(axis=-1)

    def score(self, x: np.ndarray) -> int:
        total = int((self.evaluate(self.literals(x))[-1] * self.sign).sum())
        return max(-self.spec.threshold, min(self.spec.threshold, total))

    def update(self, x: np.ndarray, y: int, node_literals: dict[int, np.ndarray] | None = None, total: int | None = None) -> None:
        """Feedback for one sample. For graphs: node_literals are a firing node's bits for each clause that fires, total the
        class sum; clauses that fire nowhere only forget."""
        s, t = self.spec, self.spec.threshold
        if node_literals is None:
            lit = self.literals(x)
            values = self.evaluate(lit)
            total = max(-t, min(t, int((values[-1] * self.sign).sum())))
        else:
            lit = np.stack([self.literals(node_literals.get(c, np.zeros(s.features, bool)))[:, :] for c in range(s.clauses)])
            values = self.evaluate(lit)
            silent = np.array([c not in node_literals for c in range(s.clauses)])
            values = (*values[:-1], np.where(silent, 0, values[-1]))
        leaf, ors, ands, inner, clause = values
        chosen = self._draws(LEAF, leaf.shape) * (2 * t) < (t + (1 - 2 * y) * total) * PRIME
        live = leaf & (ors > 0)[..., None] & (ands > 0)[..., None, None] & (inner > 0)[..., None, None, None] & (clause > 0)[:, None, None, None, None]
        for_it = (self.sign * (2 * y - 1) > 0)[:, None, None, None, None]
        draw = self._draws(AUTOMATON, self.state.shape) * self.tenths
        match = np.broadcast_to(lit, self.state.shape)
        recognise, forget, reject = (chosen & for_it & live)[..., None], (chosen & for_it & ~live)[..., None], (chosen & ~for_it & live)[..., None]
        first = recognise & match & ((draw < (self.tenths - 10) * PRIME) | self.boost)
        seldom = draw < 10 * PRIME
        wrong, gone, second = recognise & ~match & seldom, forget & seldom, reject & ~match & (self.state <= s.states)
        before = self.state.copy()
        self.state += (first | second).astype(np.int32) - (wrong | gone).astype(np.int32)
        np.clip(self.state, 1, 2 * s.states, out=self.state)
        self.step += 1
        self.last = (int(chosen.sum()), int(first.sum()), int(wrong.sum()), int(gone.sum()), int(second.sum()), int((self.state != before).sum()))

    def _draws(self, what: int, shape: tuple[int, ...]) -> np.ndarray:
        return draw_array(4 * self.step + what, np.arange(np.prod(shape)), self.seed).reshape(shape)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, shuffle: bool = True) -> Machine:
        """Goes on from the present state, step and epoch."""
        for _ in range(epochs):
            for i in shuffled(len(x), self.epoch, self.seed) if shuffle else range(len(x)):
                self.update(x[i], int(y[i]))
            self.epoch += 1
        return self

    def table(self) -> pd.DataFrame:
        """Its automata: clause, j, k, l, m, n and state."""
        places = np.indices(self.state.shape).reshape(6, -1)
        return pd.DataFrame(dict(zip(("clause", "j", "k", "l", "m", "n"), places.astype(np.int32)))).assign(state=self.state.ravel())

    def restore(self, automata: pd.DataFrame, step: int, epoch: int) -> Machine:
        """Goes on from such a table, in any order of rows."""
        if len(automata) != self.state.size:
            raise ValueError("the table is of a machine of another shape")
        self.state[tuple(automata[c].to_numpy() for c in ("clause", "j", "k", "l", "m", "n"))] = automata["state"]
        self.step, self.epoch = step, epoch
        return self


class MultiClass:
    """A machine for each class; a sample updates its own class's machine and, as a negative, one other at random."""

    def __init__(self, spec: Spec, seed: int) -> None:
        self.seed, self.step, self.epoch = seed, 0, 0
        self.machines = [Machine(spec, seed * 1009 + k) for k in range(spec.classes)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int) -> MultiClass:
        """Every machine counts the samples of all, whether it learns from them or not."""
        n = len(self.machines)
        for _ in range(epochs):
            for i in shuffled(len(x), self.epoch, self.seed):
                other = int(y[i] + 1 + draw_array(4 * self.step + NODE, np.array([0]), self.seed)[0] // 8 % (n - 1)) % n if n > 1 else None
                for k, machine in enumerate(self.machines):
                    machine.step = self.step
                    if k in (y[i], other):
                        machine.update(x[i], int(k == y[i]))
                self.step += 1
            self.epoch += 1
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array([int(np.argmax([m.score(row) for m in self.machines])) for row in x])


class FlatMachine:
    """Conjunctions over all literals, shared by the classes, with a weight for each class and clause.

    most: a clause that includes so many literals takes no more. q: how many other classes a sample counts against, on
    average. fit(..., incremental=True) goes on from the present state."""

    def __init__(self, features: int, clauses: int, classes: int, threshold: int, s: float, seed: int, q: float = 1.0, most: int | None = None, states: int = 128, boost: bool = True) -> None:
        self.features, self.classes, self.threshold, self.s, self.q, self.states, self.boost, self.seed = features, classes, threshold, s, q, states, boost, seed
        self.most, self.shape = most or 2 * features, (clauses, 2 * features)
        self.reset()

    def reset(self) -> None:
        self.step = self.epoch = 0
        self.tenths, self.share = round(10 * self.s), round(1000 * self.q / max(1, self.classes - 1))
        self.state = np.full(self.shape, self.states - 1, np.int32)
        places = np.arange(self.classes * self.shape[0])
        self.weights = (1 - 2 * (draw_array(0, places, self.seed + 1) // 8 % 2)).reshape(self.classes, -1)

    def _draws(self, what: int, shape: tuple[int, ...]) -> np.ndarray:
        return draw_array(4 * self.step + what, np.arange(np.prod(shape)), self.seed).reshape(shape)

    def literals(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(bool), ~x.astype(bool)])

    def outputs(self, lit: np.ndarray, learning: bool = False) -> np.ndarray:
        """Which clauses hold; an empty clause holds only while it learns."""
        include = self.state >= self.states
        return (lit | ~include).all(axis=1) & (include.any(axis=1) | learning)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ self.outputs(self.literals(x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array([int(self.sums(r).argmax()) for r in x])

    def transform(self, x: np.ndarray) -> np.ndarray:
        """The clauses' outputs as features."""
        return np.stack([self.outputs(self.literals(r)) for r in x]).astype(np.uint8)

    def _update(self, lit: np.ndarray, k: int, sign: int, out: np.ndarray | None = None) -> None:
        """Feedback for class k. lit: the literals, for all clauses or for each; out: which clauses hold, if it is known."""
        out, t = self.outputs(lit, learning=True) if out is None else out, self.threshold
        total = max(-t, min(t, int(self.weights[k] @ out)))
        chosen = self._draws(LEAF, out.shape) * (2 * t) < (t - sign * total) * PRIME
        agrees = self.weights[k] * sign >= 0
        draw = self._draws(AUTOMATON, self.state.shape) * self.tenths
        include = self.state >= self.states
        room = (include.sum(axis=1) < self.most)[:, None] | include
        first, second = (chosen & agrees)[:, None], (chosen & ~agrees & out)[:, None]
        up = first & out[:, None] & lit & ((draw < (self.tenths - 10) * PRIME) | self.boost) & room
        up |= second & ~lit & ~include & room
        down = first & (~out[:, None] | ~lit) & (draw < 10 * PRIME)
        self.weights[k] += sign * (chosen & out)
        self.state = np.clip(self.state + up - down.astype(np.int32), 0, 2 * self.states - 1).astype(np.int32)
        self.step += 1

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, incremental: bool = False) -> FlatMachine:
        if not incremental:
            self.reset()
        for _ in range(epochs):
            for i in shuffled(len(x), self.epoch, self.seed):
                lit = self.literals(x[i])
                against = self._draws(NODE, (self.classes,)) * 1000 < self.share * PRIME
                self._update(lit, int(y[i]), 1)
                for k in range(self.classes):
                    if k != y[i] and against[k]:
                        self._update(lit, k, -1)
            self.epoch += 1
        return self

    def fit_outputs(self, x: np.ndarray, y: np.ndarray, epochs: int) -> FlatMachine:
        """Several outputs at once: y has a column for each class, and each is learned for or against."""
        self.reset()
        for _ in range(epochs):
            for i in shuffled(len(x), self.epoch, self.seed):
                lit = self.literals(x[i])
                for k in range(self.classes):
                    self._update(lit, k, 1 if y[i, k] else -1)
            self.epoch += 1
        return self


    def tables(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Its automata (clause, literal, state) and weights (clause, class_id, weight)."""
        clause, literal = np.indices(self.state.shape).reshape(2, -1)
        class_id, own = np.indices(self.weights.shape).reshape(2, -1)
        return pd.DataFrame({"clause": clause, "literal": literal, "state": self.state.ravel()}), pd.DataFrame({"clause": own, "class_id": class_id, "weight": self.weights.ravel()})

    def restore(self, automata: pd.DataFrame, weights: pd.DataFrame) -> FlatMachine:
        """Goes on from such tables, in any order of rows; shapes must agree."""
        if len(automata) != self.state.size or len(weights) != self.weights.size:
            raise ValueError("the tables are of a machine of another shape")
        self.state[automata["clause"], automata["literal"]] = automata["state"]
        self.weights[weights["class_id"], weights["clause"]] = weights["weight"]
        return self


class MessageMachine(FlatMachine):
    """A flat machine over graphs whose clauses send messages and learn from those they receive.

    A clause has literals over a node's features and, for each further layer, over the messages that the node has received: of a clause
    that holds at a neighbour up to the layer before, the place (code of the clause + type of the edge) modulo `messages`. It holds
    at a node if it holds there in all layers, and for a graph if it does at any node. Feedback goes to all layers at once: of the
    nodes where a clause holds, that with the least draw gives it its features and messages as literals."""

    def __init__(self, features: int, messages: int, layers: int, clauses: int, classes: int, threshold: int, s: float, seed: int, **more) -> None:
        self.own, self.messages, self.layers = features, messages, layers
        super().__init__(features + layers * messages, clauses, classes, threshold, s, seed, **more)
        self.codes = draw_array(1, np.arange(clauses), seed + 1) // 8 % messages

    def nodes(self, x: np.ndarray, edges: np.ndarray, learning: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Which clauses hold at which nodes in all layers [node, clause], and the nodes' literals. x: features of the nodes; edges: rows
        of src, dst and type, one for each direction."""
        include, full = self.state >= self.states, np.zeros((len(x), self.features), bool)
        full[:, : self.own] = x
        held, at = np.ones((len(x), len(include)), bool), 0
        for width in (self.own, *[self.messages] * self.layers):
            if at:
                for src, dst, kind in edges:
                    full[dst, at + (self.codes[held[src]] + kind) % self.messages] = True
            for part, first in ((full, 0), (~full, self.features)):
                wanted = include[:, first + at : first + at + width]
                held &= (part[:, None, at : at + width] | ~wanted).all(axis=2)
            at += width
        return held & (include.any(axis=1) | learning), np.concatenate([full, ~full], axis=1)

    def graph_sums(self, x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.weights @ self.nodes(x, edges)[0].any(axis=0)

    def fit_graphs(self, graphs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, incremental: bool = False) -> MessageMachine:
        """graphs: features of the nodes, and edges."""
        if not incremental:
            self.reset()
        for _ in range(epochs):
            for g in shuffled(len(graphs), self.epoch, self.seed):
                against = self._draws(NODE, (self.classes,)) * 1000 < self.share * PRIME
                for k in [int(y[g]), *[k for k in range(self.classes) if k != y[g] and against[k]]]:
                    held, lit = self.nodes(*graphs[g], learning=True)
                    lot = draw_array(4 * self.step + ORDER, np.arange(held.shape[1])[None, :] * 64 + np.arange(len(held))[:, None], self.seed)
                    self._update(lit[np.where(held, lot, PRIME).argmin(axis=0)], k, 1 if k == y[g] else -1, held.any(axis=0))
            self.epoch += 1
        return self


MESSAGES = "seed int, epoch int, train_accuracy double, valid_accuracy double"


def message_history(graphs: DataFrame, features: int, messages: int, layers: int, clauses: int, threshold: int, s: float, seeds: list[int], epochs: int, most: int | None = None) -> DataFrame:
    """seed, epoch and the accuracies of message machines for two classes. graphs: id, split (train or valid), y, bits (an array of each
    node's bits) and edges (structs of src, dst, kind between nodes by place); one task for each seed."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("id"), []
        own = [(np.array([list(b) for b in bits], bool), np.array([[e["src"], e["dst"], e["kind"]] for e in edges], int).reshape(-1, 3)) for bits, edges in zip(pdf["bits"], pdf["edges"])]
        y, kept = pdf["y"].to_numpy(int), (pdf["split"] == "train").to_numpy()
        machine = MessageMachine(features, messages, layers, clauses, 2, threshold, s, int(pdf["seed"].iloc[0]), most=most)
        for epoch in range(1, epochs + 1):
            machine.fit_graphs([own[i] for i in np.flatnonzero(kept)], y[kept], 1, incremental=epoch > 1)
            right = np.array([machine.graph_sums(*g).argmax() for g in own]) == y
            out.append((machine.seed, epoch, *[float(right[k].mean()) if k.any() else float("nan") for k in (kept, ~kept)]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    return graphs.withColumn("seed", F.explode(F.lit(seeds))).groupBy("seed").applyInPandas(train, MESSAGES)


def graph_fit(machine: Machine, graphs: list[np.ndarray], y: np.ndarray, epochs: int) -> Machine:
    """graphs: the bits of each graph's nodes. A clause counts once if it fires at any node; one of these nodes, that with the least
    draw for (clause, node), gives its literals to the feedback."""
    for _ in range(epochs):
        for g in shuffled(len(graphs), machine.epoch, machine.seed):
            fired = np.stack([machine.evaluate(machine.literals(node))[-1] > 0 for node in graphs[g]])
            total = int((fired.any(axis=0) * machine.sign).sum())
            total = max(-machine.spec.threshold, min(machine.spec.threshold, total))
            lot = draw_array(4 * machine.step + NODE, np.arange(fired.shape[1])[None, :] * 64 + np.arange(len(fired))[:, None], machine.seed)
            first = np.where(fired, lot, PRIME).argmin(axis=0)
            picked = {c: graphs[g][first[c]] for c in np.flatnonzero(fired.any(axis=0)).tolist()}
            machine.update(graphs[g][0], int(y[g]), picked, total)
        machine.epoch += 1
    return machine


HISTORY = "seed int, epoch int, train_accuracy double, valid_auroc double, state binary"


def train_ensemble(rows: DataFrame, spec: Spec, seeds: list[int], epochs: int, features: str = "bits") -> DataFrame:
    """seed, epoch, train_accuracy, valid_auroc and state of every epoch of every seed's machine. rows: id, split (train or
    valid), y, and an array of spec.features bits. One task for each seed."""
    each = rows.select("id", "split", "y", F.col(features).alias("bits")).withColumn("seed", F.explode(F.lit(seeds)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")  # the same order whatever the partitioning
        x, y, kept = np.stack(pdf["bits"].to_numpy()).astype(bool), pdf["y"].to_numpy(int), (pdf["split"] == "train").to_numpy()
        machine, out = Machine(spec, int(pdf["seed"].iloc[0])), []
        for epoch in range(1, epochs + 1):
            machine.fit(x[kept], y[kept], 1)
            scores = np.array([machine.score(r) for r in x])
            out.append((int(pdf["seed"].iloc[0]), epoch, float(((scores > 0) == y)[kept].mean()) if kept.any() else float("nan"), _auroc(y[~kept], scores[~kept]), machine.state.astype(np.int16).tobytes()))
        return pd.DataFrame(out, columns=["seed", "epoch", "train_accuracy", "valid_auroc", "state"])

    return each.groupBy("seed").applyInPandas(train, HISTORY)


def distill(rows: DataFrame, teacher: DataFrame, spec: Spec, seeds: list[int], epochs: int) -> DataFrame:
    """The history of machines that learn the teacher's hard labels. rows: id, split, bits; teacher: graph_id, hard."""
    taught = rows.drop("y").join(teacher.select(F.col("graph_id").alias("id"), F.col("hard").alias("y")), "id")
    return train_ensemble(taught, spec, seeds, epochs)


def _auroc(y: np.ndarray, s: np.ndarray) -> float:
    p, n = int((y == 1).sum()), int((y == 0).sum())
    if not p or not n:
        return 0.5
    ranks = pd.Series(s).rank().to_numpy()
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n))


def states_table(history: DataFrame, spec: Spec) -> DataFrame:
    """seed and the automata (clause, j, k, l, m, n, state) of a history's states, as tables that the clause operators take."""
    names, shape = ["clause", "j", "k", "l", "m", "n"], (spec.clauses, spec.root, spec.inner_or, spec.inner_and, spec.leaf_or, 2 * spec.leaf_and)

    def unpack(pdf: pd.DataFrame) -> pd.DataFrame:
        index = np.indices(shape).reshape(len(shape), -1)
        parts = []
        for seed, state in zip(pdf["seed"], pdf["state"]):
            parts.append(pd.DataFrame({"seed": seed, **dict(zip(names, index)), "state": np.frombuffer(state, np.int16).astype(np.int32)}))
        return pd.concat(parts)

    out = history.groupBy("seed").applyInPandas(unpack, "seed int, clause int, j int, k int, l int, m int, n int, state int")
    feature = F.col("j") * (spec.inner_and * spec.leaf_and) + F.col("l") * spec.leaf_and + F.col("n") % spec.leaf_and
    return out.withColumn("feature", feature)


# Teachers and baselines


def neighbour_sums(nodes: DataFrame, adjacent: DataFrame, types: int, layers: int) -> DataFrame:
    """graph_id, size and a mean-pooled feature vector: each layer adds a node's neighbours to itself (sum aggregation) and
    takes log(1 + x); the pooled vectors of all layers are kept side by side. A graph is gathered once, and the graphs of a batch
    are summed together: nothing else shuffles, however many layers there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            for batch in encoding.slices(whole, encoding.sizes(whole.column("__id")) * types + encoding.sizes(whole.column("__src")) * types):
                size, edges = (encoding.sizes(batch.column(f"__{c}")) for c in ("id", "src"))
                (owner, _), (of_edge, _) = encoding.counts_to_rows(size), encoding.counts_to_rows(edges)
                (own, src, dst), n = encoding.places_of([owner, of_edge, of_edge], [encoding.flat(batch.column(f"__{c}")) for c in ("id", "src", "dst")])
                there, now = np.zeros(n, bool), np.zeros((n, types))
                there[own] = True
                atom = encoding.flat(batch.column("__atom"))
                known = (atom >= 0) & (atom < types)
                now[own[known], atom[known]] = 1
                src, dst = (x[there[src] & there[dst]] for x in (src, dst))
                pooled = []
                for layer in range(layers + 1):
                    if layer:
                        sums = np.zeros_like(now)
                        np.add.at(sums, src, now[dst])
                        now = np.log1p(now + sums)
                    total = np.zeros((batch.num_rows, types))
                    np.add.at(total, owner, now[own])
                    pooled.append(total / size[:, None])
                vectors = np.concatenate(pooled, axis=1)
                ends = pa.array(np.arange(batch.num_rows + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("graph_id"), pa.array(size.astype(float)), pa.ListArray.from_arrays(ends, pa.array(vectors.reshape(-1)))], names=["graph_id", "size", "vector"])

    rows = encoding.gathered(nodes, adjacent, ["src", "dst"])
    return rows.mapInArrow(run, f"graph_id {nodes.schema['graph_id'].dataType.simpleString()}, size double, vector array<double>")


def fit_teacher(features: DataFrame, label: str = "y", max_iter: int = 50):
    """A class-balanced logistic head over pooled graph vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from .metrics import inverse_frequency

    rows = inverse_frequency(features.withColumn("features", array_to_vector("vector")), label)
    return LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=max_iter).fit(rows)


def fit_forest(fingerprints: DataFrame, size: int, label: str = "y", trees: int = 200, seed: int = 42):
    """A random forest on folded fingerprints (sorted places in `bits`)."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed).fit(sparse(fingerprints, size))


def sparse(df: DataFrame, size: int, bits: str = "bits") -> DataFrame:
    """df with `features`, the sparse vector with ones at the places in bits."""
    from pyspark.ml.feature import CountVectorizerModel

    names = [str(i) for i in range(size)]
    model = CountVectorizerModel.from_vocabulary(names, inputCol="__names", outputCol="features")
    model.setBinary(True)
    return model.transform(df.withColumn("__names", F.col(bits).cast("array<string>"))).drop("__names")


def teacher_labels(model, features: DataFrame) -> DataFrame:
    """graph_id, soft (the probability of the positive class) and hard (soft of one half or more)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = features if "features" in features.columns else features.withColumn("features", array_to_vector("vector"))
    soft = vector_to_array("probability")[1]
    return model.transform(rows).select("graph_id", soft.alias("soft"), (soft >= 0.5).cast("int").alias("hard"))


# Replays: trainings whose every state another engine can repeat

STATES = "seed int, clause int, j int, k int, l int, m int, n int, state int"
FEEDBACK = "seed int, step int, chosen int, recognised int, mistaken int, forgotten int, rejected int, changed int"


def _samples(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("id")  # the same order whatever the partitioning
    return np.stack(pdf["bits"].to_numpy()).astype(bool), pdf["y"].to_numpy(int)


def trained_states(rows: DataFrame, spec: Spec, seeds: list[int], epochs: int, shuffle: bool = True, start: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """The automata of each seed's machine after so many epochs. rows: id, y, bits. start: such a table, after `epoch` epochs of the
    same rows, from which the machines go on. One task for each seed."""

    def train(machine: Machine, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _samples(pdf)
        return machine.fit(x, y, epochs, shuffle).table().assign(seed=machine.seed)[[c.split()[0] for c in STATES.split(", ")]]

    each = rows.select("id", "y", "bits").withColumn("seed", F.explode(F.lit(seeds)))
    if start is None:
        return each.groupBy("seed").applyInPandas(lambda pdf: train(Machine(spec, int(pdf["seed"].iloc[0])), pdf), STATES)

    def go_on(pdf: pd.DataFrame, automata: pd.DataFrame) -> pd.DataFrame:
        return train(Machine(spec, int(pdf["seed"].iloc[0])).restore(automata, epoch * len(pdf), epoch), pdf)

    return each.groupBy("seed").cogroup(start.groupBy("seed")).applyInPandas(go_on, STATES)


def feedback(rows: DataFrame, spec: Spec, seeds: list[int]) -> DataFrame:
    """Of each update of an epoch: how many leaves were chosen, automata strengthened for what they recognise, weakened for what they
    include by mistake, weakened where nothing held (forgotten), strengthened to reject, and how many states changed."""
    names = [c.split()[0] for c in FEEDBACK.split(", ")]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        (x, y), machine, out = _samples(pdf), Machine(spec, int(pdf["seed"].iloc[0])), []
        for i in shuffled(len(x), 0, machine.seed):
            machine.update(x[i], int(y[i]))
            out.append((machine.seed, machine.step - 1, *machine.last))
        return pd.DataFrame(out, columns=names)

    return rows.select("id", "y", "bits").withColumn("seed", F.explode(F.lit(seeds))).groupBy("seed").applyInPandas(train, FEEDBACK)


def class_states(rows: DataFrame, spec: Spec, seed: int, epochs: int) -> DataFrame:
    """The automata of the machines of a multi-class learner; seed is each machine's own. rows: id, y (a class), bits."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _samples(pdf)
        tables = [m.table().assign(seed=m.seed) for m in MultiClass(spec, seed).fit(x, y, epochs).machines]
        return pd.concat(tables)[[c.split()[0] for c in STATES.split(", ")]]

    return rows.select("id", "y", "bits", F.lit(seed).alias("seed")).groupBy("seed").applyInPandas(train, STATES)


def graph_states(nodes: DataFrame, spec: Spec, seeds: list[int], epochs: int) -> DataFrame:
    """The automata of each seed's machine after feedback from graphs. nodes: graph_id, node_id, y, bits; 64 nodes a graph at most."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        machine = Machine(spec, int(pdf["seed"].iloc[0]))
        graphs = [g.sort_values("node_id") for _, g in sorted(pdf.groupby("graph_id"))]
        graph_fit(machine, [np.stack(g["bits"].to_numpy()).astype(bool) for g in graphs], np.array([g["y"].iloc[0] for g in graphs]), epochs)
        return machine.table().assign(seed=machine.seed)[[c.split()[0] for c in STATES.split(", ")]]

    return nodes.select("graph_id", "node_id", "y", "bits").withColumn("seed", F.explode(F.lit(seeds))).groupBy("seed").applyInPandas(train, STATES)


FLAT = "seed int, clause int, literal int, state int, weight0 long, weight1 long"


def flat_states(rows: DataFrame, clauses: int, threshold: int, s: float, states: int, most: int, seeds: list[int], epochs: int) -> DataFrame:
    """The automata and the weights for both classes of each seed's flat machine. rows: id, y (0 or 1), bits."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _samples(pdf)
        seed = int(pdf["seed"].iloc[0])
        machine = FlatMachine(x.shape[1], clauses, 2, threshold, s, seed, most=most, states=states).fit(x, y, epochs)
        automata, weights = machine.tables()
        wide = weights.pivot(index="clause", columns="class_id", values="weight").rename(columns={0: "weight0", 1: "weight1"}).reset_index()
        return automata.merge(wide, on="clause").assign(seed=seed)[[c.split()[0] for c in FLAT.split(", ")]]

    return rows.select("id", "y", "bits").withColumn("seed", F.explode(F.lit(seeds))).groupBy("seed").applyInPandas(train, FLAT)
