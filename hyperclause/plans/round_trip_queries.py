"""Queries of adaptors, sinks that are read back, searches' traces, slices, and neighbourhoods by joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import encoding, messages, recourse
from ..sources import writers
from . import derived, machine
from .core_queries import BASE
from .derived import read
from .registry import query
from .search_queries import _STEP, _fixed, _near, _score, shared_folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("src08_array_adaptor", f"{BASE}, b AS (SELECT graph_id, count(*) AS bonds, sum(bond_type) AS kinds FROM bonds GROUP BY graph_id) SELECT graph_id, count(*) AS nodes, CAST(sum(atom_type * (node_id + 1)) AS BIGINT) AS atoms, any_value(coalesce(bonds, 0)) AS bonds, CAST(any_value(coalesce(kinds, 0)) AS BIGINT) AS kinds FROM nodes LEFT JOIN b USING (graph_id) GROUP BY graph_id")
def src08(spark, sf_dir):
    """Graphs as arrays of symbols and named bonds, taken apart into nodes and bonds again."""
    symbols, names = (F.array(*map(F.lit, x)) for x in (encoding.ATOM_SYMBOLS, ["SINGLE", "double", "3", "12"]))
    own = derived.nodes(spark, sf_dir).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "atom_type"))).alias("n"))
    edges = derived.bonds(spark, sf_dir).groupBy("graph_id").agg(F.collect_list(F.struct("u", "v", F.element_at(names, F.col("bond_type") + 1).alias("bond"))).alias("edges"))
    arrays = own.join(edges, "graph_id", "left").select("graph_id", F.transform("n", lambda x: F.element_at(symbols, x["atom_type"] + 1)).alias("atom_types"), "edges")
    nodes, bonds = encoding.from_arrays(arrays)
    atoms = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("atom_type") * (F.col("node_id") + 1)).cast("long").alias("atoms"))
    return atoms.join(bonds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("bonds"), F.sum("bond_type").cast("long").alias("kinds")), "graph_id", "left").fillna(0)


@query("snk01_json_rows", "SELECT doc_id, quality, toxic FROM labels")
def snk01(spark, sf_dir):
    """Labels written as JSON lines and read back."""
    path = writers.write_json(read(spark, sf_dir, "labels"), _folder(spark), "labels")
    return spark.read.schema("doc_id long, quality int, toxic int").json(path)


@query("snk02_markdown_report", "SELECT '# Suppliers' || chr(10) || chr(10) || '| nation | suppliers |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || s_nationkey || ' | ' || n || ' |', chr(10) ORDER BY s_nationkey, n) || chr(10) AS report FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey ORDER BY s_nationkey, n LIMIT 25)")
def snk02(spark, sf_dir):
    counts = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return spark.createDataFrame([(writers.markdown(counts, "Suppliers"),)], "report string")


@query("snk03_snapshot", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, feature, state FROM ta")
def snk03(spark, sf_dir):
    """Automata written as a snapshot and read back."""
    path = _folder(spark)
    writers.save_automata(machine.table_automata(spark, sf_dir), path)
    return writers.load_automata(spark, path).select("clause", "j", "k", "l", "m", "n", "feature", "state")


@query("rc08_search_trace", f"{_STEP} SELECT t.graph_id, count(*) AS tried, count(*) FILTER (WHERE t.flipped) AS flips, CAST(count(DISTINCT s.graph_id) AS BIGINT) AS committed FROM t LEFT JOIN step s ON s.graph_id = t.graph_id GROUP BY t.graph_id")
def rc08(spark, sf_dir):
    """Of each graph's first round: the edits tried, those that flip, and whether one was committed."""
    return recourse.machine_trace(derived.gathered(spark, sf_dir), _score(spark), derived.ATOMS)


@query("flt07_graph_slices", f"{BASE}, p AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS position, count(*) OVER () AS n FROM graphs) SELECT 'last' AS slice, CAST(position - (n - 50) AS INTEGER) AS new_position, graph_id FROM p WHERE position >= n - 50 UNION ALL SELECT 'back', CAST((n - 3 - position) // 7 AS INTEGER), graph_id FROM p WHERE position <= n - 3 AND position > 10 AND (n - 3 - position) % 7 = 0")
def flt07_slices(spark, sf_dir):
    placed = _fixed(spark)(messages.offsets(derived.graphs(spark, sf_dir).select("graph_id")).select("graph_id", F.col("first").alias("position")))
    parts = [messages.sliced(placed, *bounds).select(F.lit(name).alias("slice"), "new_position", "graph_id") for name, bounds in (("last", (-50, None)), ("back", (-3, 10, -7)))]
    return parts[0].unionByName(parts[1])


@query("enc13_frontier_neighbourhoods", f"{BASE}, {machine.ADJACENCY_SQL}, {machine.HOPS_SQL} SELECT graph_id, root, node_id, hop FROM near")
def enc13_frontier(spark, sf_dir):
    found = encoding.frontier_neighbourhoods(derived.nodes(spark, sf_dir), _near(spark, sf_dir), machine.book(spark), 2, _fixed(spark))
    return found.select("graph_id", "root", "node_id", "hop")


@query("enc13_one_large_graph", "WITH e AS (SELECT DISTINCT 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v FROM lineitem), n AS (SELECT u AS x FROM e UNION SELECT v FROM e) SELECT x AS root, x AS node_id, 0 AS hop FROM n UNION ALL SELECT u, v, 1 FROM e UNION ALL SELECT v, u, 1 FROM e")
def enc13_large(spark, sf_dir):
    """All parts and suppliers as one graph, bonded by the lines that have both."""
    pairs = read(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("u"), (2 * F.col("l_suppkey") + 1).alias("v")).distinct().withColumn("edge_id", F.col("u") * (1 << 31) + F.col("v"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    near = pairs.select(F.lit(0).alias("graph_id"), ends.alias("e"), F.lit(0).alias("bond_type"), "edge_id").select("graph_id", "e.*", "bond_type", "edge_id")
    nodes = near.select("graph_id", F.col("src").alias("node_id"), F.lit(0).alias("atom_type")).distinct()
    return encoding.frontier_neighbourhoods(nodes, near, machine.book(spark), 1, _fixed(spark)).select("root", "node_id", "hop")
