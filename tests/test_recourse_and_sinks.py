"""Strict edits, the search without an encoder, its evaluation; teachers, students and machines written and read again."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.functions import bits
from hyperclause.operators import chemistry, clauses, messages, metrics, recourse, training
from hyperclause.sources import readers, writers

EDITS = "graph_id long, ordinal int, op string, i int, j int, new_value int"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(g, n, 0) for g in (0, 1) for n in range(3)], "graph_id long, node_id int, atom_type int")
    bonds = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 0), (1, 0, 1, 0)], "graph_id long, u int, v int, bond_type int")
    return nodes, bonds


@pytest.mark.parametrize("edit", [("remove_bond", 0, 2, None), ("swap_bond_order", 2, 0, 1), ("add_bond", 1, 0, 1), ("swap_atom", 7, None, 1), ("rename", 0, 1, 1)])
def test_edits_that_do_not_apply_are_errors(spark, graph, edit):
    with pytest.raises(Exception, match="does not apply"):
        recourse.apply_edits(*graph, spark.createDataFrame([(0, 1, *edit)], EDITS), strict=True)[1].collect()


def test_edits_that_apply(spark, graph):
    edits = spark.createDataFrame([(0, 1, "remove_bond", 0, 1, None), (0, 2, "swap_bond_order", 1, 2, 3), (0, 3, "add_bond", 2, 0, 1), (0, 4, "swap_atom", 1, None, 2)], EDITS)
    atoms, left = recourse.apply_edits(*graph, edits, strict=True)
    found = {k: sorted((r.u, r.v, r.bond_type) for r in left.where(F.col("ordinal") == k).collect()) for k in range(1, 5)}
    assert found == {1: [(1, 2, 0)], 2: [(0, 1, 0), (1, 2, 3)], 3: [(0, 1, 0), (0, 2, 1), (1, 2, 0)], 4: [(0, 1, 0), (1, 2, 0)]}
    assert atoms.where("ordinal = 4 and node_id = 1").first().atom_type == 2


def test_search_without_an_encoder(spark, graph):
    """Each step commits the first edit that applies to what the steps before have left, and is valid."""
    fixed = lambda df: df.checkpoint()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edits = spark.createDataFrame([(0, 1, "remove_bond", 0, 1, None), (0, 2, "swap_bond_order", 0, 1, 2), (0, 3, "swap_atom", 2, None, 5), (1, 1, "remove_bond", 1, 2, None)], EDITS)
    got = recourse.first_valid(*graph, edits, fixed)
    assert sorted((r.graph_id, r.step, r.op) for r in got.collect()) == [(0, 1, "remove_bond"), (0, 2, "swap_atom")]
    no_swaps = lambda n, b: n.groupBy("graph_id").agg(F.max("atom_type").alias("m")).where("m = 0")
    got = recourse.first_valid(*graph, edits, fixed, valid=no_swaps)
    assert [(r.graph_id, r.step, r.op) for r in got.collect()] == [(0, 1, "remove_bond")]


def test_evaluation(spark):
    steps = spark.createDataFrame([(g, s, "remove_bond", 0, 1, None) for g, n in ((0, 1), (1, 3), (2, 2)) for s in range(1, n + 1)], "graph_id long, step int, op string, i int, j int, new_value int")
    seconds = spark.createDataFrame([(g, 0.1 * (g + 1)) for g in range(5)], "graph_id long, seconds double")
    r = recourse.evaluation(seconds.select("graph_id"), steps, seconds).first()
    assert (r.n_evaluated, r.successes, r.success_rate, r.mean_flips, r.flips_p50) == (5, 3, 0.6, 2.0, 2.0)
    assert [r.latency_ms_p50, r.latency_ms_p95, r.latency_ms_p99] == pytest.approx(np.percentile([100, 200, 300, 400, 500], [50, 95, 99]).tolist())
    none = recourse.evaluation(seconds.where("graph_id < 0").select("graph_id"), steps).first()
    assert (none.n_evaluated, none.success_rate, none.mean_flips) == (0, None, None)
    assert [tuple(x) for x in recourse.top_edits(steps).collect()] == [("remove_bond", 0, 1, 6)]


def test_percentiles_of_many_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), None if rng.random() < 0.05 else float(rng.integers(0, 40))) for k in rng.integers(0, 3, 700)] + [(9, 4.0)]
    got = {r.k: r for r in metrics.percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in got:
        own = [v for key, v in rows if key == k and v is not None]
        assert [got[k][f"p{q}"] for q in (50, 90, 95, 99)] == pytest.approx(np.percentile(own, [50, 90, 95, 99]).tolist())
        assert (got[k].mean, got[k].max) == pytest.approx((np.mean(own), max(own)))


def test_a_machine_goes_on_from_what_was_written(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 4))
    y = x[:, 0]
    machine = training.FlatMachine(4, 10, 2, 10, 3.9, seed=2).fit(x, y, 3)
    writers.save_machine(spark, machine, str(tmp_path / "m"))
    again = writers.load_machine(spark, training.FlatMachine(4, 10, 2, 10, 3.9, seed=9), str(tmp_path / "m"))
    assert (again.state == machine.state).all() and (again.weights == machine.weights).all()
    before = again.state.copy()
    again.fit(x, y, 1, incremental=True)
    assert (again.predict(x) == y).mean() > 0.9 and np.abs(again.state - before).max() < 400
    with pytest.raises(ValueError):
        writers.load_machine(spark, training.FlatMachine(5, 10, 2, 10, 3.9, seed=9), str(tmp_path / "m"))


def test_teachers_and_students_are_written(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(v[0] > 0), [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(80, 3)))], "graph_id long, y int, vector array<double>")
    model = training.fit_teacher(rows)
    labels = training.teacher_labels(model, rows)
    writers.save_teacher(model, labels, str(tmp_path / "t"))
    again = training.teacher_labels(writers.load_teacher(spark, str(tmp_path / "t")), rows)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/predictions")).collect()))
    spec = clauses.Spec(clauses=4, root=1, inner_or=1, inner_and=1, leaf_or=2, leaf_and=3)
    bits_ = rows.select(F.col("graph_id").alias("id"), F.when(F.col("graph_id") < 60, "train").otherwise("valid").alias("split"), F.transform("vector", lambda v: (v > 0).cast("int")).alias("bits"), F.lit(0).alias("y"))
    history = training.distill(bits_, labels, spec, [1], 2).checkpoint()
    writers.save_student(history, training.states_table(history.where("epoch = 2"), spec), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/automata")).count() == spec.clauses * spec.literals
    assert [(r.seed, r.epoch) for r in spark.read.json(str(tmp_path / "s/metrics")).orderBy("epoch").collect()] == [(1, 1), (1, 2)]
    forest = training.fit_forest(bits_.select("id", F.col("id").alias("graph_id"), (F.col("bits")[0]).alias("y"), F.filter(F.transform("bits", lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull()).alias("bits")), 3, trees=3)
    assert forest.numFeatures == 3


def test_sparse_vectors(spark):
    df = spark.createDataFrame([(0, [1, 4]), (1, [])], "id int, bits array<int>")
    got = {r.id: r.features for r in training.sparse(df, 6).collect()}
    assert got[0].size == 6 and got[0].indices.tolist() == [1, 4] and got[0].values.tolist() == [1.0, 1.0] and got[1].indices.tolist() == []


def test_tags():
    east = timezone(timedelta(hours=3))
    assert writers.run_tag(datetime(2024, 1, 1, 1, 2, 3, tzinfo=east)) == "20231231_220203"
    assert len(writers.run_tag()) == 15


def test_graphs_of_molecules(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1"), (3, "C("), (4, None)], "id long, smiles string")
    nodes, bonds, counts = readers.molecule_graphs(df)
    assert tuple(counts.first()) == (2, 2)
    assert sorted((r.graph_id, r.node_id, r.atom_type) for r in nodes.where("graph_id = 1").collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 2)]
    assert {r.bond_type for r in bonds.where("graph_id = 2").collect()} == {3} and bonds.where("graph_id = 2").count() == 6


def test_cores_that_refinement_alone_confuses():
    """Two triangles side by side and a hexagon have alike neighbourhoods; so have decalin and two linked pentagons."""
    key = lambda s: chemistry.scaffold(*chemistry.parse(s))
    assert key("C1CCC2CCCCC2C1") != key("C1CCC(C1)C1CCCC1")
    assert key("C1CC1.C1CC1") != key("C1CCCCC1")
    assert key("C1CCC2CCCCC2C1") == key("C1CCCC2C1CCCC2")


@pytest.mark.parametrize("size", [20, 70])
def test_flat_machine_against_its_definition(spark, size):
    """Two layers on random graphs, with vectors that don't fill their last word."""
    rng = np.random.default_rng(size)
    rows, edges = [], []
    for g in range(12):
        n = int(rng.integers(1, 6))
        rows += [(g, k, sorted(set(rng.integers(0, size, 3).tolist()))) for k in range(n)]
        for k in range(n - 1):
            t = int(rng.integers(0, 3))
            edges += [(g, k, k + 1, t), (g, k + 1, k, t)]
    own = [(c, int(p)) for c in range(1, 6) for p in set(rng.choice([*range(size, 2 * size), *range(3)], 2).tolist())] + [(0, None)]
    then = [(c, int(p)) for c in range(2, 6) for p in set(rng.choice(2 * size, 1).tolist())] + [(0, None), (1, None)]
    code = {c: int(rng.integers(0, size)) for c in range(6)}
    df = spark.createDataFrame(rows, "graph_id long, node_id int, places array<int>").withColumn("words", bits.from_places(F.col("places"), size))
    near = spark.createDataFrame(edges, "graph_id long, src int, dst int, bond_type int")
    layer = lambda x: spark.createDataFrame(x, "clause int, place int")
    codes = spark.createDataFrame(list(code.items()), "clause int, code int")
    match = lambda places, inc, c: all((p in places) if p < size else (p - size not in places) for k, p in inc if k == c and p is not None)
    first = {(g, n, c) for g, n, p in rows for c in range(6) if match(set(p), own, c)}
    sent = {(g, b, (code[c] + t) % size) for g, a, b, t in edges for c in range(6) if (g, a, c) in first}
    last = {(g, n, c) for g, n, c in first if match({p for h, m, p in sent if (h, m) == (g, n)}, then, c)}
    graphs = messages.gathered(df, near, layer(own), size)
    assert {tuple(r) for r in messages.matches(df, layer(own), size).collect()} == first
    assert {tuple(r) for r in messages.exchange(graphs, codes, size).collect()} == sent
    assert {tuple(r) for r in messages.layers(graphs, [layer(then)], codes, size).collect()} == last
    gated = messages.gathered(df, near, layer(own), size, F.col("clause") % 2 == F.col("node_id") % 2)
    assert {tuple(r) for r in messages.layers(gated, [], codes, size).collect()} == {x for x in first if x[2] % 2 == x[1] % 2}


def test_rules_with_unbalanced_patterns(spark, tmp_path):
    rules = [{"kazius_id": i, "name": f"n{i}", "smarts": "C(" if i == 3 else "C"} for i in range(8)]
    (tmp_path / "r.yaml").write_text(json.dumps(rules))
    with pytest.raises(ValueError, match="unbalanced"):
        readers.rules(spark, str(tmp_path / "r.yaml"))
