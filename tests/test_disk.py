"""What large tables would write to disk: nothing is written once for each part of the other side, nor for each round."""

import pytest
from pyspark.sql import functions as F

from hyperclause.functions import bits
from hyperclause.operators import clause_index, clauses, encoding


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("empty", [True, False])
def test_blocks_and_chunks_are_written_once(spark, monkeypatch, empty):
    monkeypatch.setattr(clause_index, "BLOCK", 64)
    monkeypatch.setattr(clause_index, "NODES", 7)
    monkeypatch.setattr(clause_index, "PACKED", 40)
    monkeypatch.setattr(clause_index, "GIVEN", 3)
    monkeypatch.setattr(clause_index, "TOGETHER", 10)
    spec = clause_index.WideSpec(clauses=150)
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 3).where("clause % 5 <> 1 and clause < 130").localCheckpoint()
    rows = [(None if i % 9 == 0 else i // 3, i % 3, [i * 5 % 256, *range(i % 2)]) for i in range(60)]  # graphs without a number, vectors longer than what is read
    nodes = spark.createDataFrame(rows, "graph_id long, node_id int, hv array<long>").localCheckpoint()
    words = clause_index.fired_words(nodes.withColumn("hv", F.slice("hv", 1, 1)), clause_index.index(ta, spec, spec.states))
    want = words.select("graph_id", "node_id", F.posexplode(bits.unpack(F.col("fired"), 150)).alias("clause", "held")).where("held = 1").drop("held").localCheckpoint()
    got = clause_index.held_clauses(nodes, ta, spec, spec.states, empty=empty)
    included = ta.where(F.col("state") > spec.states).select("clause").distinct()
    key = lambda df: sorted((str(r.graph_id), r.node_id, r.clause) for r in df.collect())
    assert key(got) == key(want if empty else want.join(included, "clause", "left_semi"))
    votes = clause_index.graph_votes(nodes, ta, spec, spec.states)
    assert {r.graph_id: r.votes for r in votes.collect()} == {r.graph_id: r.v for r in want.select("graph_id", "clause").distinct().groupBy("graph_id").agg(F.sum(1 - 2 * (F.col("clause") % 2)).alias("v")).collect()}
    # Neither side is multiplied before it is dealt out, and nothing of the result is joined or dealt out again.
    assert "Generate" not in _plan(got) and _plan(got).count("Join") == 1 and "Join Cross" in _plan(got)


def test_frontier_writes_no_hop_that_is_read_once(spark):
    """Neither the first nor the last hop is written, no row is dealt out again for its atom, and bonds may end at no node."""
    written = []
    nodes = spark.createDataFrame([(g, n, n % 3) for g in range(3) for n in range(6)], "graph_id long, node_id int, atom_type int")
    bonds = spark.createDataFrame([(g, n, n + 1, n % 2) for g in range(3) for n in range(6)] + [(1, 0, 4, 1), (2, 5, 5, 0)], "graph_id long, u int, v int, bond_type int")
    near, book = encoding.adjacency(bonds), encoding.codebook(spark, 3, 2, 5, 64, 0.2, 1)
    rows = lambda df: sorted((r.graph_id, r.root, r.node_id, r.hop, tuple(r.chain)) for r in df.collect())
    for k, times in ((1, 0), (2, 0), (4, 2)):
        written.clear()
        found = encoding.frontier_neighbourhoods(nodes, near, book, k, lambda df: written.append(df) or df.localCheckpoint())
        assert len(written) == times
        assert rows(found) == rows(encoding.neighbourhoods(nodes, near, book, k)) and any(r.node_id == 6 for r in found.collect())
