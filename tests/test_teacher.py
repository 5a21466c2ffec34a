"""The graph network: its gradient, what it learns, and that it can be repeated."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.operators import encoding, teacher, training

SHAPE = teacher.Shape(9, 4, hidden=8, layers=2)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    shape = teacher.Shape(4, 3, hidden=3, layers=2)
    edges = np.array([[0, 1], [1, 0], [1, 2], [2, 1], [3, 4], [4, 3]])
    block = teacher.Block(rng.integers(0, 4, 6), np.array([3, 2, 1]), edges[:, 0], edges[:, 1], rng.integers(0, 3, 6))
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    flat = rng.normal(0, 1, shape.size)

    def loss(p):
        logit, _ = teacher.forward(shape.split(p), shape.layers, block)
        return (weight * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum()

    got, _ = teacher.gradient(shape, flat, block, y, weight)
    for i in range(shape.size):
        move = np.zeros(shape.size)
        move[i] = 1e-6
        assert abs((loss(flat + move) - loss(flat - move)) / 2e-6 - got[i]) < 1e-5, i
    assert np.abs(got).max() > 0.1


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def data(spark, folder):
    """Graphs that are positive if a bond of type 1 ends at an atom of type 0: neither atoms nor bonds tell this by themselves."""
    r = random.Random(3)
    graphs, nodes, bonds = [], [], []
    for g in range(900):
        n = r.randint(4, 8)
        kinds = [r.choice((0, 0, 1, 2, 3)) for _ in range(n)]
        own = [(i - 1, i, r.choice((0, 0, 1, 2))) for i in range(1, n)]
        nodes += [(g, i, k) for i, k in enumerate(kinds)]
        bonds += [(g, u, v, t) for u, v, t in own]
        graphs.append((g, int(any(t == 1 and 0 in (kinds[u], kinds[v]) for u, v, t in own)), r.choice(("train", "train", "train", "valid", "test"))))
    graphs = spark.createDataFrame(graphs, "graph_id long, y int, split string")
    nodes = spark.createDataFrame(nodes, "graph_id long, node_id int, atom_type int")
    near = encoding.adjacency(spark.createDataFrame(bonds, "graph_id long, u int, v int, bond_type int"))
    return graphs, nodes, near, teacher.blocks(nodes, near, graphs, lambda df: df.checkpoint())


def auroc(rows):
    pos, neg = [[p for p, y in rows if y == k] for k in (1, 0)]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_learns_more_than_fixed_sums(spark, data):
    graphs, nodes, near, of = data
    flat, history = teacher.fit(of, SHAPE, 60, rate=0.03)
    test = {r.graph_id: r.y for r in graphs.where("split = 'test'").collect()}
    found = teacher.predict(of, SHAPE, flat).collect()
    learned = auroc([(r.probability, test[r.graph_id]) for r in found if r.graph_id in test])
    assert {r.graph_id for r in found} == {r.graph_id for r in graphs.collect()} and all(r.hard == (r.probability >= 0.5) for r in found)
    pooled = training.neighbour_sums(nodes, near, 9, 2).join(graphs, "graph_id").select("split", "y", "vector").collect()
    x, y = np.array([r.vector for r in pooled]), np.array([r.y for r in pooled])
    kept, w = np.array([r.split == "train" for r in pooled]), np.zeros(x.shape[1] + 1)
    ones = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(len(x))]
    for _ in range(600):  # a logistic head over the fixed sums, to the end
        w -= 0.5 * (ones[kept].T @ (1 / (1 + np.exp(-ones[kept] @ w)) - y[kept])) / kept.sum()
    check = np.array([r.split == "test" for r in pooled])
    fixed = auroc(list(zip(ones[check] @ w, y[check])))
    assert learned > max(0.9, fixed + 0.02), (learned, fixed)
    assert history[-1][1] < 0.6 * history[0][1] and min(h[2] for h in history) < history[0][2]


def test_can_be_repeated(spark, data):
    graphs, nodes, near, of = data
    once = teacher.fit(of, SHAPE, 3)
    again = teacher.fit(teacher.blocks(nodes.repartition(7), near.repartition(3), graphs, lambda df: df.checkpoint()), SHAPE, 3)
    assert once[1] == again[1] and (once[0] == again[0]).all()


def test_edge_cases(spark):
    """Graphs without edges, numbers of nodes with gaps, one class, no training graphs, and no graphs."""
    nodes = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (2, 0, 2)], "graph_id long, node_id int, atom_type int")
    near = spark.createDataFrame([(1, 5, 9, 1), (1, 9, 5, 1)], "graph_id long, src int, dst int, bond_type int")
    fixed = lambda df: df.checkpoint()
    graphs = spark.createDataFrame([(1, 1, "train"), (2, 1, "train"), (3, 0, "train")], "graph_id long, y int, split string")
    of = teacher.blocks(nodes, near, graphs, fixed)
    flat, history = teacher.fit(of, SHAPE, 2)
    assert teacher.predict(of, SHAPE, flat).count() == 2 and history[0][1] > 0 and np.isnan(history[0][2])
    unlabelled = teacher.blocks(nodes, near, graphs.select("graph_id"), fixed)
    assert teacher.predict(unlabelled, SHAPE, flat).agg(F.sum("hard")).first()[0] is not None
    assert (teacher.fit(unlabelled, SHAPE, 1)[0] == SHAPE.start(1)).all()
    assert teacher.predict(teacher.blocks(nodes.limit(0), near, graphs, fixed), SHAPE, flat).count() == 0


def test_pieces_add_up():
    """Runs of graphs of any size give the gradient and the logits of the whole block."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 7, 40)
    first = np.cumsum(sizes) - sizes
    edges = np.array(sorted(e for f, n in zip(first, sizes) for i in range(n - 1) for e in ((f + i, f + i + 1), (f + i + 1, f + i))))
    block = teacher.Block(rng.integers(0, 9, sizes.sum()), sizes, edges[:, 0], edges[:, 1], rng.integers(0, 4, len(edges)))
    flat, y, weight = rng.normal(0, 0.5, SHAPE.size), rng.integers(0, 2, 40), rng.random(40)
    back, logit = teacher.gradient(SHAPE, flat, block, y, weight)
    for nodes in (1, 10, 64, 10**6):
        runs = [(own, teacher.gradient(SHAPE, flat, piece, y[own], weight[own])) for own, piece in teacher.pieces(block, nodes)]
        assert np.allclose(sum(g for _, (g, _) in runs), back, rtol=1e-12, atol=1e-13)
        assert np.allclose(np.concatenate([found for _, (_, found) in runs]), logit, rtol=1e-12, atol=1e-13)
        assert (nodes == 10**6) == (len(runs) == 1)


def test_lines_are_shuffled_once(spark, tmp_path):
    """Blocks of the sample graphs are those of their nodes and bonds, and no step of theirs but the first deals lines out."""
    from hyperclause.plans import derived

    r = random.Random(8)
    orders = [(k, r.choice(("1-URGENT", "5-LOW"))) for k in range(1, 60)]
    lines = [(k if r.random() > 0.02 else None, n + 1, r.randrange(200), 1, 1.0, 1.0, "1995-01-01", r.choice("NAR")) for k, _ in orders for n in range(r.randrange(8))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans = []

    def fixed(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    graphs = derived.graphs(spark, str(tmp_path))
    got = teacher.blocks_of(lambda block: derived.parts(spark, str(tmp_path), block), graphs, fixed).collect()
    want = teacher.blocks(derived.nodes(spark, str(tmp_path)), encoding.adjacency(derived.bonds(spark, str(tmp_path))), graphs, lambda df: df.checkpoint()).collect()
    assert got == want and len(got) == 1 and got[0].ids == sorted({k for k, *_ in lines if k is not None})
    assert plans[-1].count("Exchange ") == 2  # of the graphs and of the lines
