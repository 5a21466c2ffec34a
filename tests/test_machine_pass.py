"""Trials, first steps, traces and searches in one pass over gathered graphs, held against those by tables that are written between rounds."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hyperclause.operators import clauses, encoding, recourse
from hyperclause.plans import derived, machine, search_queries

SPEC = clauses.Spec(clauses=40, threshold=50)
FOLDER = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def fixed(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return lambda df: df.checkpoint()


@pytest.mark.parametrize("k, most, bond_types, target, negation", [(1, 50, 0, 1, "complement"), (2, 7, 4, 0, "offset"), (0, 50, 1, 1, "complement")])
def test_equals_rounds_by_tables(spark, fixed, k, most, bond_types, target, negation):
    r, nodes, bonds = random.Random(k + most + target), [], []
    for g in range(40):
        n = r.randint(1, 7)
        nodes += [(g * 3, i, r.choice([*range(9), None])) for i in range(n)]
        bonds += [(g * 3, *r.choice([sorted, list])((r.randrange(n), r.randrange(n))), r.choice([0, 1, 2, 3, None])) for _ in range(r.randint(0, 9))]  # loops, repeated and turned bonds too
    nodes = spark.createDataFrame(nodes, "graph_id long, node_id int, atom_type int").localCheckpoint()
    bonds = spark.createDataFrame(bonds, "graph_id long, u int, v int, bond_type int").where("u <> v").localCheckpoint()
    score = recourse.MachineScore(encoding.codebook(spark, 9, 4, k + 1, 64, 0.3, 3), k, 64, clauses.model(clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, 42), SPEC, SPEC.states), SPEC, negation)
    rows = encoding.gathered(nodes, bonds, ["u", "v", "bond_type"])
    edits = fixed(recourse.machine_candidates(rows, score, 9, most, bond_types))
    sums = score(nodes, bonds)
    state = fixed(sums.select("graph_id", (F.col("class_sum") > 0).cast("int").alias("target"), F.abs("class_sum").alias("margin")))
    tried = fixed(score.trials(nodes, bonds, edits))
    assert _rows(recourse.machine_trials(rows, score, 9, most, bond_types)) == _rows(tried) and tried.count() > 60
    steps = recourse.best_steps(tried, state)
    assert _rows(recourse.machine_steps(rows, score, 9, most, bond_types)) == _rows(steps) and steps.count() > 5
    flips = tried.join(state, "graph_id").withColumn("flips", (F.col("class_sum") > 0).cast("int") != F.col("target"))
    assert _rows(recourse.machine_trace(rows, score, 9, most, bond_types)) == _rows(recourse.trace(steps, flips))
    own = state.where(F.col("target") == target)
    for flip in (0, 3):
        want = _rows(recourse.search(nodes, bonds, edits.join(own.select("graph_id"), "graph_id", "left_semi"), own, score, fixed, flip, most))
        assert _rows(recourse.machine_search(rows, score, 9, flip, most, bond_types, target)) == want
    assert target == 0 or any(x[1] > 1 for x in want)


def test_own_candidates_are_all_valid(spark):
    with pytest.raises(ValueError):
        recourse.search(None, None, recourse.Own(lambda: None, 9), None, lambda nodes, bonds: nodes, None)


@pytest.mark.skipif(not __import__("os").path.isdir(FOLDER), reason="the sample tables are not here")
@pytest.mark.parametrize("name", ["rc06_search", "rc08_search_trace", "rc06_first_step", "rc06_tried_edits"])
def test_lines_are_dealt_out_once(spark, fixed, name):
    """Nothing of a round is written: the plan reads the lines, deals them out by graph, and that is all."""
    found = __spark_entry__.queries()[name](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "ExistingRDD" not in plan
    if name == "rc06_search":
        state = fixed(search_queries._state(spark, FOLDER).where("target = 1"))
        edits = fixed(search_queries._candidates(spark, FOLDER).join(state.select("graph_id"), "graph_id", "left_semi"))
        want = recourse.search(derived.nodes(spark, FOLDER), derived.bonds(spark, FOLDER), edits, state, search_queries._score(spark), fixed)
        assert _rows(found) == _rows(want) and found.count() > 100 and machine.SPEC == search_queries.SPEC
