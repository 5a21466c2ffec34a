"""Trials that encode only the nodes that see an edit, held against encoding every variant as a whole."""

import random

import pytest

from hyperclause.operators import clauses, encoding, recourse

SPEC = clauses.Spec(clauses=40, threshold=50)
DIM = 64


@pytest.mark.parametrize("k, negation", [(1, "complement"), (2, "offset"), (3, "complement"), (0, "complement")])
def test_equals_whole_variants(spark, k, negation):
    r = random.Random(k)
    nodes, bonds, edits = [], [], []
    for g in range(12):
        n = r.randint(1, 8)
        nodes += [(g, i, r.randrange(9)) for i in range(n)]
        own = {(i - 1, i) for i in range(1, n) if r.random() < 0.8} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(2) if n > 1}
        bonds += [(g, u, v, r.randrange(4)) for u, v in own]
        some = [("remove_bond", u, v, None) for u, v in own] + [("swap_bond_order", u, v, r.randrange(4)) for u, v in own] + [("swap_atom", i, None, r.randrange(9)) for i in range(n)]
        absent = [(i, j) for i in range(n) for j in range(i + 1, n) if (i, j) not in own]
        some += [("add_bond", *r.choice([(i, j), (j, i)]), r.randrange(4)) for i, j in absent[:3]]
        edits += [(g, o + 1, *e) for o, e in enumerate(r.sample(some, min(8, len(some))))]
    nodes = spark.createDataFrame(nodes, "graph_id long, node_id int, atom_type int")
    bonds = spark.createDataFrame(bonds, "graph_id long, u int, v int, bond_type int")
    edits = spark.createDataFrame(edits, "graph_id long, ordinal int, op string, i int, j int, new_value int")
    book = encoding.codebook(spark, 9, 4, k + 1, DIM, 0.3, 3)
    model = clauses.model(clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, 42), SPEC, SPEC.states)
    score = recourse.MachineScore(book, k, DIM, model, SPEC, negation)
    rows = lambda df: sorted((tuple(x) for x in df.select("graph_id", "ordinal", *recourse.EDIT, "class_sum").collect()), key=repr)
    want = rows(recourse.trials(nodes, bonds, edits, score.__call__))
    assert rows(score.trials(nodes, bonds, edits)) == want and len(want) == edits.count() and len({x[-1] for x in want}) > 1
    assert rows(score.trials(nodes, bonds, edits, score.fired(nodes, bonds))) == want
    assert score.trials(nodes, bonds, edits.limit(0)).count() == 0
