"""Candidates and first steps from gathered graphs, held against the tables of firing nodes and the step-by-step search."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hyperclause.functions import bits
from hyperclause.operators import clauses, encoding, recourse

SPEC = clauses.Spec(clauses=40, threshold=50)
NODES, BONDS = "graph_id long, node_id int, atom_type int", "graph_id long, u int, v int, bond_type int"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _graphs(spark, seed):
    """Random graphs with bonds given either way round, several between two nodes, and loops."""
    r, nodes, bonds = random.Random(seed), [], []
    for g in range(30):
        n = r.randint(1, 7)
        nodes += [(g, i, r.randrange(9)) for i in range(n)]
        bonds += [(g, r.randrange(n), r.randrange(n), r.randrange(4)) for _ in range(r.randint(0, 9))]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(bonds, BONDS)


@pytest.mark.parametrize("k, most, bond_types", [(1, 50, 0), (2, 5, 4), (1, 50, 4), (0, 50, 1)])
def test_equals_candidates_of_firing_nodes(spark, k, most, bond_types):
    nodes, bonds = _graphs(spark, k + most)
    near = encoding.adjacency(bonds)
    book = encoding.codebook(spark, 9, 4, k + 1, 64, 0.3, 3)
    score = recourse.MachineScore(book, k, 64, clauses.model(clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, 42), SPEC, SPEC.states), SPEC)
    firing = score.fired(nodes, bonds).select("graph_id", "node_id", F.posexplode(bits.unpack(F.col("fired"), SPEC.clauses)).alias("clause", "output")).where("output = 1").drop("output")
    edges = None
    if bond_types:
        at = lambda end: firing.select("graph_id", F.col("node_id").alias(end), "clause")
        edges = near.where("src < dst").join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst", "clause"]).select("graph_id", "clause", "edge_id")
    want = recourse.candidates(firing, nodes, near, 9, most, edges, bond_types or 1)
    rows = encoding.gathered(nodes, bonds.where("u <> v"), ["u", "v", "bond_type"])
    got = recourse.machine_candidates(rows, score, 9, most, bond_types)
    assert _rows(got) == _rows(want) and want.count() > 60
    steps = recourse.machine_candidates(rows, score, 9, most, bond_types, flips=3)
    assert _rows(steps) == _rows(recourse.first_valid(nodes, bonds.where("u <> v"), want, lambda df: df.checkpoint(), 3)) and steps.count() > 30


def test_first_steps_equal_the_search_with_all_valid(spark):
    """Edits that need each other: bonds added and then changed, removed twice, without an end, with an end that is missing."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r, edits = random.Random(5), []
    nodes, bonds = _graphs(spark, 5)
    pairs = {}
    for x in bonds.collect():
        pairs.setdefault(x.graph_id, []).append((x.u, x.v))
    for g in range(32):
        own = pairs.get(g, [(0, 1)])
        for o in range(6):
            i, j = r.choice([r.choice(own), (r.randrange(7), r.randrange(7)), (r.randrange(3), None)])
            op = r.choice(["remove_bond", "swap_bond_order", "add_bond", "add_bond", "swap_atom", "rename"])
            edits.append((g, 10 - o, op, i, None if op == "swap_atom" else j, None if op == "remove_bond" else r.randrange(4)))
    edits = spark.createDataFrame(edits, "graph_id long, ordinal int, op string, i int, j int, new_value int")
    every = lambda n, b: n.select("graph_id").distinct()
    inside = edits.where("graph_id < 30")  # variants come from nodes
    fixed = lambda df: df.checkpoint()
    want = recourse.first_valid(nodes, bonds, inside, fixed, 4, valid=every)
    assert _rows(recourse.first_valid(nodes, bonds, inside, fixed, 4)) == _rows(want) and want.count() > 60
    assert {x.graph_id for x in recourse.first_valid(nodes, bonds, edits, fixed, 4).collect()} >= {x.graph_id for x in want.collect()}
    assert recourse.first_valid(nodes, bonds, edits.limit(0), fixed).count() == 0


@pytest.mark.parametrize("name", ["rc05_candidates", "rc05_edge_candidates", "rc07_first_valid"])
def test_lines_are_dealt_out_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
