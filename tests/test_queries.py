"""Registered queries against their SQL in another engine, where the sample tables are at hand."""

import math
import os

import pytest

import __spark_entry__
from hyperclause.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the sample tables are not here")


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


#: One query of each group; the driver compares all.
CHOSEN = ["enc04_codebook", "enc11_edge_vectors", "enc14_node_vectors", "cl07_node_clauses_offset", "cl11_predict", "cl19_two_layers", "cl22_flat_multiplicity", "exp03_firing_clauses", "agg04_alert_coverage", "agg07_auroc", "sp02_group_split", "sp04_stratified_holdout", "rc05_candidates", "rc06_tried_edits", "src03_tolerant_table", "src13_noisy_parity",
          "tr11_fit", "tr12_multiclass_fit", "tr09_graph_feedback", "tr14_flat_fit", "tr16_incremental_fit", "jn04_substructures", "sp01_ring_scaffolds", "cl07_indexed_clauses", "agg08_auroc_pairs", "agg11_percentiles", "win_prefix_offsets", "flt07_graph_subset"]


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    r = duck.execute(SQL[name])
    place = [[d[0] for d in r.description].index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in place) for row in r.fetchall()), key=repr)
    assert got and got == want


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["graph_id", "class_sum", "pred"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_goes_three_rounds(spark, monkeypatch):
    """The registered search takes as many edits as the operator does by default."""
    import inspect

    from hyperclause.operators import recourse
    from hyperclause.plans import search_queries

    asked = {}
    most = inspect.signature(recourse.search).parameters["max_flips"].default
    rows = spark.range(1).selectExpr("id as graph_id", "1 as target")
    monkeypatch.setattr(search_queries, "_fixed", lambda spark: lambda df: df)
    for name in ("_state", "_candidates"):
        monkeypatch.setattr(search_queries, name, lambda spark, sf_dir: rows)
    monkeypatch.setattr(search_queries, "_score", lambda spark: None)
    for name in ("nodes", "bonds"):
        monkeypatch.setattr(search_queries.derived, name, lambda spark, sf_dir: rows)
    monkeypatch.setattr(recourse, "search", lambda *a, max_flips=most: asked.update(most=max_flips))
    search_queries.rc06_search(spark, "")
    assert asked["most"] == most == 3
