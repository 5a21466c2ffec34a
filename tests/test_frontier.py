"""Neighbourhoods by joins equal those walked in a row, and go where no row could; slices of graphs."""

import random

import pytest

from hyperclause.operators import encoding, messages


@pytest.fixture(scope="module")
def fixed(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return lambda df: df.checkpoint()


@pytest.mark.parametrize("k", [0, 1, 3])
def test_equals_the_walk(spark, fixed, k):
    r = random.Random(k)
    nodes, bonds = [], []
    for g in range(10):
        n = r.randint(1, 9)
        nodes += [(g, i, r.randrange(9)) for i in range(n)]
        bonds += [(g, *sorted((r.randrange(n), r.randrange(n))), r.randrange(4)) for _ in range(n + 2)]  # loops and repeated bonds too
    nodes = spark.createDataFrame(nodes, "graph_id long, node_id int, atom_type int")
    near = encoding.adjacency(spark.createDataFrame(bonds, "graph_id long, u int, v int, bond_type int"))
    book = encoding.codebook(spark, 9, 4, 4, 64, 0.3, 1)
    rows = lambda df: sorted((x.graph_id, x.root, x.node_id, x.hop, tuple(x.chain)) for x in df.collect())
    want = rows(encoding.neighbourhoods(nodes, near, book, k))
    assert rows(encoding.frontier_neighbourhoods(nodes, near, book, k, fixed)) == want and want


def test_a_graph_of_100000_nodes(spark, fixed):
    """A ring with a chord from every thousandth node: how many nodes lie within two hops is known."""
    n = 100_000
    nodes = spark.range(n).selectExpr("0 as graph_id", "id as node_id", "cast(id % 9 as int) as atom_type")
    ring = spark.range(n).selectExpr("id as u", f"(id + 1) % {n} as v").unionByName(spark.range(0, n, 2000).selectExpr("id as u", f"(id + 1000) % {n} as v"))
    near = ring.selectExpr("0 as graph_id", "explode(array(struct(u as src, v as dst), struct(v as src, u as dst))) as e", "0 as bond_type", f"u * {n} + v as edge_id").select("graph_id", "e.*", "bond_type", "edge_id")
    found = encoding.frontier_neighbourhoods(nodes, near, encoding.codebook(spark, 9, 4, 3, 64, 0.3, 1), 2, fixed)
    counts = {r.hop: r["count"] for r in found.groupBy("hop").count().collect()}
    ends = n // 1000  # nodes with a chord
    assert counts == {0: n, 1: 2 * n + ends, 2: 2 * n + 4 * ends}
    with pytest.raises(ValueError):
        encoding.frontier_neighbourhoods(nodes, near, None, 8, fixed)


def test_slices(spark):
    graphs = spark.range(12).selectExpr("id * 10 as graph_id", "id as position").cache()
    for bounds in [(None, None, 1), (3, 9, 2), (-4, None, 1), (None, -4, 3), (None, None, -1), (-2, 1, -3), (5, 2, 1), (100, None, 1), (None, 100, 1), (-100, 3, 1), (2, -100, -1)]:
        got = sorted((r.new_position, r.graph_id) for r in messages.sliced(graphs, *bounds).collect())
        assert got == list(enumerate([10 * i for i in range(12)][slice(*bounds)])), bounds
    with pytest.raises(ValueError):
        messages.sliced(graphs, step=0)
    assert messages.sliced(graphs.limit(0), -3).count() == 0
