"""The index from literals to leaves, held against the walk through every tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.operators import clause_index, clauses


def random_nodes(spark, rng, n, words):
    rows = [(int(i // 3), int(i % 3), [int(w) for w in rng.integers(0, 1 << 32, words)]) for i in range(n)]
    return spark.createDataFrame(rows, "graph_id long, node_id int, hv array<long>")


SHAPES = [dict(clauses=8), dict(clauses=70, root=1, inner_or=3, inner_and=2, leaf_or=1, leaf_and=5), dict(clauses=66, root=3, inner_or=1, inner_and=1, leaf_or=3, leaf_and=7), dict(clauses=2, root=1, inner_or=1, inner_and=1, leaf_or=1, leaf_and=31)]


@pytest.mark.parametrize("negation", ["complement", "offset"])
@pytest.mark.parametrize("shape", SHAPES)
def test_equals_the_walk(spark, shape, negation):
    spec = clauses.Spec(**shape)
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 130, 5)  # about a quarter of the literals are included
    nodes = random_nodes(spark, np.random.default_rng(1), 40, 4).cache()
    want = clauses.fired_words(nodes, clauses.model(ta, spec, spec.states), spec, negation)
    built = clause_index.index(ta, spec, spec.states)
    got = clause_index.fired_words(nodes, built, negation)
    rows = lambda df: sorted((r.graph_id, r.node_id, list(r.fired)) for r in df.collect())
    assert rows(got) == rows(want) and (spec.clauses == 2 or any(any(f) for _, _, f in rows(got)))
    assert rows(clauses.graph_clauses(got).withColumn("node_id", F.lit(0))) == rows(clauses.graph_clauses(want).withColumn("node_id", F.lit(0)))


def plain(x, included, spec, offset):
    """Whether one tree holds. included: (j, k, l, m, n)."""
    f = spec.features

    def leaf(j, k, l, m):  # noqa: E741
        for n in included.get((j, k, l, m), ()):
            place = j * spec.inner_and * spec.leaf_and + l * spec.leaf_and + n % spec.leaf_and
            value = x[place] if n < spec.leaf_and else x[place + f] if offset else 1 - x[place]
            if not value:
                return False
        return True

    return all(any(all(any(leaf(j, k, l, m) for m in range(spec.leaf_or)) for l in range(spec.inner_and)) for k in range(spec.inner_or)) for j in range(spec.root))  # noqa: E741


@pytest.mark.parametrize("negation", ["complement", "offset"])
@pytest.mark.parametrize("limit", [clause_index.TABLES, 1 << 20, 1000])
def test_wide_machines(spark, monkeypatch, limit, negation):
    """More features than a mask holds, with tables by eight, four and one features."""
    spec, rng = clause_index.WideSpec(clauses=130, leaf_and=60, threshold=50), np.random.default_rng(3)
    shape = (spec.clauses, spec.root, spec.inner_or, spec.inner_and, spec.leaf_or)
    rows = [(*map(int, at), int(n), int((at[1] * spec.inner_and + at[3]) * spec.leaf_and + n % spec.leaf_and), spec.states + 1) for at in np.ndindex(*shape) for n in set(rng.integers(0, 2 * spec.leaf_and, 2))]
    ta = spark.createDataFrame(rows, "clause int, j int, k int, l int, m int, n int, feature int, state int")
    nodes = random_nodes(spark, rng, 30, 15).cache()
    built = clause_index.index(ta, spec, spec.states)
    monkeypatch.setattr(clause_index, "TABLES", limit)
    engine = clause_index._Evaluator(built, negation)
    found = nodes.collect()
    x = np.unpackbits(np.array([r.hv for r in found], np.uint32).view(np.uint8).reshape(len(found), -1), axis=1, bitorder="little")
    bits = np.unpackbits(engine.rows(x).view(np.uint8), axis=1, bitorder="little")[:, : spec.clauses]
    included = {}
    for c, j, k, l, m, n, _, _ in rows:  # noqa: E741
        included.setdefault(c, {}).setdefault((j, k, l, m), []).append(n)
    want = np.array([[plain(own, included.get(c, {}), spec, negation == "offset") for c in range(spec.clauses)] for own in x])
    assert (bits == want).all() and 0 < want.sum() < want.size
    assert engine.width == {clause_index.TABLES: engine.width, 1 << 20: engine.width, 1000: 1}[limit]


def test_edge_cases(spark):
    spec = clauses.Spec()
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 5)
    built = clause_index.index(ta, spec, spec.states)
    none = clause_index.index(ta.limit(0), spec, spec.states)  # without literals every clause holds
    nodes = spark.createDataFrame([(1, 0, [0, 5], 7)], "graph_id long, node_id int, hv array<long>, fired int")
    assert clause_index.fired_words(nodes, none).first().fired == [255]
    assert clause_index.fired_words(nodes.limit(0), built).count() == 0
    for bad in ([(1, 0, None)], [(1, 0, [])], [(1, 0, [1]), (2, 0, [1, 2])]):
        with pytest.raises(Exception, match="vector of"):
            clause_index.fired_words(spark.createDataFrame(bad, "graph_id long, node_id int, hv array<long>").coalesce(1), built, "offset" if len(bad) > 1 else "complement").collect()
    with pytest.raises(ValueError):
        clause_index.fired_words(nodes, built, "other")
    with pytest.raises(ValueError):
        clauses.Spec(leaf_and=128)
