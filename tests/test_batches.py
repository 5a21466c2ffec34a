"""Graphs, trials and machines that are worked on by batches and blocks: the same as row by row, and nothing multiplied on the way."""

import numpy as np
from pyspark.sql import functions as F

from hyperclause.functions import bits
from hyperclause.operators import clause_index, clauses, encoding, explain, recourse, training

SPEC = clauses.Spec()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _graphs(spark):
    nodes = spark.createDataFrame([(g, n, (g * n) % 3) for g in range(6) for n in range(g + 1)], "graph_id long, node_id int, atom_type int")
    bonds = spark.createDataFrame([(g, n, n + 1, n % 2) for g in range(6) for n in range(g)] + [(5, 0, 4, 1)], "graph_id long, u int, v int, bond_type int")
    return nodes, bonds


def test_vectors_of_a_batch_equal_those_walked_in_a_row(spark):
    nodes, bonds = _graphs(spark)
    near, book = encoding.adjacency(bonds), encoding.codebook(spark, 3, 2, 4, 64, 0.2, 1)
    want = encoding.bundled(encoding._near(nodes, near, book, 3), book, ["graph_id"], 64).select("graph_id", "node_id", "hv")
    got = encoding.node_vectors(nodes, near, book, 3, 64)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in _plan(encoding.node_vectors(nodes, bonds.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"), "bond_type", F.lit(1).alias("edge_id")), book, 3, 64))


def test_trials_multiply_no_rows(spark):
    nodes, bonds = _graphs(spark)
    book, model = encoding.codebook(spark, 3, 2, 2, 64, 0.2, 1), clauses.model(clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, 1), SPEC, SPEC.states).localCheckpoint()
    edits = spark.createDataFrame([(5, 1, "swap_atom", 0, None, 1), (5, 2, "remove_bond", 0, 4, None)], "graph_id long, ordinal int, op string, i int, j int, new_value int")
    fired = spark.createDataFrame([(5, n, [0]) for n in range(6)], "graph_id long, node_id int, fired array<long>")
    tried = recourse.near_trials(nodes, bonds, edits, fired, book, 1, model, SPEC)
    assert "Generate" not in _plan(tried) and tried.count() == 2


def test_few_inputs_are_looked_up(spark):
    ta = clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, 1)
    nodes = spark.range(300).select("id", F.lit(0).alias("node_id"), F.array("id").alias("hv")).withColumnRenamed("id", "graph_id")
    found = clauses.fired_words(nodes, clauses.model(ta, SPEC, SPEC.states), SPEC)
    assert "__input" in _plan(found)
    trees = clauses.model(ta, SPEC, SPEC.states).first()["clauses"]
    want = clauses.fired_rows(trees, np.array([[i >> b & 1 for b in range(8)] for i in range(300)]), SPEC, "complement")
    assert [r.fired for r in found.orderBy("graph_id").collect()] == want.tolist()


def test_firing_counts(spark):
    rows = spark.createDataFrame([(1, [0, 2]), (1, [1, 2]), (2, [0, 0])], "graph_id long, ways array<long>")
    assert sorted(map(tuple, explain.firing_counts(rows, 2, 2).select("member", "graph_id", "clause", "clause_output").collect())) == [(0, 1, 0, 1), (0, 1, 1, 2), (1, 1, 1, 2)]


def test_blocks_of_a_machine(spark, monkeypatch):
    monkeypatch.setattr(clause_index, "BLOCK", 64)
    monkeypatch.setattr(clause_index, "NODES", 20)
    spec = clause_index.WideSpec(clauses=150)
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 3).where("clause < 64 or clause >= 128")  # a block without automata: all hold
    nodes = spark.range(60).select(F.floor(F.col("id") / 3).alias("graph_id"), (F.col("id") % 3).cast("int").alias("node_id"), F.array(F.col("id") * 5 % 256).alias("hv"))
    words = clause_index.fired_words(nodes, clause_index.index(ta, spec, spec.states)).localCheckpoint()
    want = words.select("graph_id", "node_id", F.posexplode(bits.unpack(F.col("fired"), 150)).alias("clause", "held")).where("held = 1").drop("held")
    got = clause_index.held_clauses(nodes, ta, spec, spec.states)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    votes = want.select("graph_id", "clause").distinct().groupBy("graph_id").agg(F.sum(1 - 2 * (F.col("clause") % 2)).alias("votes"))
    assert sorted(map(tuple, clause_index.graph_votes(nodes, ta, spec, spec.states).collect())) == sorted(map(tuple, votes.collect()))


def test_pooled_sums_gather_a_graph_once(spark):
    nodes, bonds = _graphs(spark)
    near = encoding.adjacency(bonds)
    found = training.neighbour_sums(nodes, near, 3, 2)
    assert _plan(found).count("Join") == 1
    got = {r.graph_id: r for r in found.collect()}
    assert got[0].size == 1.0 and np.allclose(got[0].vector, [1, 0, 0, np.log(2), 0, 0, np.log1p(np.log(2)), 0, 0])
    assert np.allclose(got[1].vector[:6], [0.5, 0.5, 0, np.log(2), np.log(2), 0])


def test_words_of_keys_and_of_symbols(spark):
    """Whole columns of keys give the coins of each; words give the places of a node's symbols, whatever is missing."""
    keys = spark.createDataFrame([(k,) for k in (0, 1, 7, 2**31, 2**32 - 1, None)], "k long")
    got = encoding.random_vectors(keys, "k", 70, 9).select("k", "hv", bits.pack(bits.random_bits(F.col("k"), 70, 9)).alias("want")).collect()
    assert all(r.hv == (r.want if r.k is not None else [None] * 3) for r in got) and len({str(r.hv) for r in got}) == 4  # three keys are alike modulo the prime
    rows = [(0, 0, 1), (0, 0, 2), (0, 1, None), (1, 0, 5), (1, 0, 5)]
    nodes = spark.createDataFrame(rows, "graph_id long, node_id int, symbol int")
    for size in (32, 45, 64):
        places = {s: p for s, p in nodes.select("symbol", bits.hot_bits(F.col("symbol"), 3, size, 4)).where("symbol is not null").distinct().collect()}
        want = {(g, n): [int(any(i in places.get(s, []) for a, b, s in rows if (a, b) == (g, n))) for i in range(size)] for g, n, _ in rows}
        assert {(r.graph_id, r.node_id): r.bits for r in encoding.property_vectors(nodes, size, 3, 4, complement=False).collect()} == want
        words = encoding.property_words(nodes, size, 3, 4).select("graph_id", "node_id", bits.unpack(bits.inverted(F.col("words"), size), size).alias("no"))
        assert {(r.graph_id, r.node_id): [1 - b for b in r.no] for r in words.collect()} == want


def test_no_brand_is_one_task(spark):
    """The least key of a brand comes by a broadcast, without a window over all of a brand's parts; no symbol's place is a row."""
    import __spark_entry__

    plan = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan("enc03_majority")
    assert "Generate" not in plan("enc17_properties") and "collect_set" not in plan("enc17_properties")
    assert "aggregate(" not in plan("enc18_complements")
