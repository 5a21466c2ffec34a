"""Message layers that learn: what one layer can't tell, two can."""

import random

import numpy as np

from hyperclause.operators import training


def chains(n, seed):
    """Chains of two A and two B: positive if equal ones stand side by side. All have the same nodes."""
    r, out = random.Random(seed), []
    for _ in range(n):
        y = r.randrange(2)
        kinds = r.choice(["AABB", "BBAA"] if y else ["ABAB", "BABA"])
        x = np.array([[c == "A", c == "B"] for c in kinds])
        edges = np.array([e for i in range(3) for e in ((i, i + 1, 0), (i + 1, i, 0))])
        out.append((x, edges, y))
    return [g[:2] for g in out], np.array([g[2] for g in out])


def accuracy(machine, graphs, y):
    return np.mean([machine.graph_sums(*g).argmax() == k for g, k in zip(graphs, y)])


def test_a_second_layer_tells_arrangements():
    (train, y), (test, z) = chains(300, 1), chains(100, 2)
    deep = training.MessageMachine(2, 16, 1, 12, 2, 10, 3.0, 5).fit_graphs(train, y, 8)
    flat = training.MessageMachine(2, 16, 0, 12, 2, 10, 3.0, 5).fit_graphs(train, y, 8)
    assert accuracy(deep, test, z) > 0.95 and accuracy(flat, test, z) < 0.7


def test_two_nodes_that_differ():
    r = random.Random(3)
    rows = [(r.randrange(2), r.randrange(2)) for _ in range(400)]
    edges = np.array([(0, 1, 0), (1, 0, 0)])
    graphs, y = [(np.array([[a, 1 - a], [b, 1 - b]], bool), edges) for a, b in rows], np.array([int(a != b) for a, b in rows])
    machine = training.MessageMachine(2, 16, 1, 10, 2, 10, 3.0, 7, most=4).fit_graphs(graphs[:300], y[:300], 6)
    assert accuracy(machine, graphs[300:], y[300:]) > 0.95
    free = training.MessageMachine(2, 16, 1, 10, 2, 10, 3.0, 7).fit_graphs(graphs[:300], y[:300], 6)
    assert (machine.state >= machine.states).sum() < (free.state >= free.states).sum()  # a full clause takes no more literals


def test_without_layers_and_edges_it_is_the_flat_machine():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2, (60, 5)).astype(bool), rng.integers(0, 2, 60)
    flat = training.FlatMachine(5, 6, 2, 5, 3.0, 4).fit(x, y, 2)
    graphs = training.MessageMachine(5, 8, 0, 6, 2, 5, 3.0, 4).fit_graphs([(row[None, :], np.zeros((0, 3), int)) for row in x], y, 2)
    assert (flat.state == graphs.state).all() and (flat.weights == graphs.weights).all()


def test_repeats_and_goes_on():
    graphs, y = chains(60, 4)
    make = lambda: training.MessageMachine(2, 16, 2, 6, 2, 5, 3.0, 9)
    once, steps = make().fit_graphs(graphs, y, 3), make().fit_graphs(graphs, y, 1).fit_graphs(graphs, y, 2, incremental=True)
    assert (once.state == steps.state).all() and (once.weights == steps.weights).all()
    assert make().nodes(np.ones((1, 2), bool), np.zeros((0, 3), int))[0].sum() == 0  # an empty clause holds only while it learns
