"""Queries of a machine of the published size: 512 bits, and a clause for each part (2,000 of them in the tables of 60,000 lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import mix, mix_sql
from ..operators import clause_index
from .derived import read
from .machine import SEED
from .registry import query

#: Thermometer levels of each number of a vector; 64 numbers give 512 bits.
LEVELS = [-0.21, -0.14, -0.08, -0.03, 0.03, 0.08, 0.14, 0.21]
LEAF_AND, LITERALS = 128, 3
_SHAPE = {"root": 2, "inner_or": 2, "inner_and": 2, "leaf_or": 2}
_CUTS = "[" + ", ".join(map(str, LEVELS)) + "]"


def _machine(spark, sf_dir):
    """The automata that include, and the shape: each leaf of a part's clause takes LITERALS literals by hashes of its key."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    last = parts.agg(F.max("key")).first()[0] or 0
    spec = clause_index.WideSpec(clauses=int(last) + 2 - int(last) % 2, leaf_and=LEAF_AND, threshold=2000, **_SHAPE)
    # A part is some hundred bytes of automata: a file of parts is too much for one task.
    rows = parts.repartition(spark.sparkContext.defaultParallelism).select(F.col("key").cast("int").alias("clause"), "key")
    for name, size in zip("jklm", _SHAPE.values()):
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    leaf = ((F.col("j") * 2 + F.col("k")) * 2 + F.col("l")) * 2 + F.col("m")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LITERALS - 1))))
    n = (F.floor(mix(F.col("key"), leaf * LITERALS + F.col("i"), SEED) / 64) % (2 * LEAF_AND)).cast("int")
    rows = rows.withColumn("n", n).withColumn("feature", (F.col("j") * 2 + F.col("l")) * LEAF_AND + F.col("n") % LEAF_AND)
    return rows.withColumn("state", F.lit(spec.states + 1)), spec


def _nodes(spark, sf_dir):
    """A node for each vector, four to a graph."""
    level = F.flatten(F.transform("embedding", lambda v: F.transform(F.array(*map(F.lit, LEVELS)), lambda c: (v.cast("double") > c).cast("int"))))
    word = lambda w: F.aggregate(F.slice("bits", w * 32 + 1, F.lit(32)), F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("i")), lambda a, b: F.struct((a["v"] + b.cast("long") * bits.power(a["i"])).alias("v"), (a["i"] + 1).alias("i")))["v"]
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("graph_id"), (F.col("vec_id") % 4).cast("int").alias("node_id"), level.alias("bits"))
    return rows.select("graph_id", "node_id", F.transform(F.sequence(F.lit(0), F.lit(15)), word).alias("hv"))


_SQL = f"""lit AS (
        SELECT p_partkey AS clause, j, k, l, m, CAST(({mix_sql('p_partkey', f'(((j * 2 + k) * 2 + l) * 2 + m) * {LITERALS} + i', SEED)} // 64) % {2 * LEAF_AND} AS INTEGER) AS n
        FROM part, range(2) a(j), range(2) b(k), range(2) c(l), range(2) d(m), range({LITERALS}) e(i)),
    leaf AS (SELECT clause, j, k, l, m, list((j * 2 + l) * {LEAF_AND} + n % {LEAF_AND} + 1) AS place, list(CAST(n < {LEAF_AND} AS INTEGER)) AS want FROM lit GROUP BY clause, j, k, l, m),
    node AS (
        SELECT vec_id, flatten(list_transform(embedding, lambda v: list_transform({_CUTS}, lambda c: CAST(CAST(v AS DOUBLE) > c AS INTEGER)))) AS x FROM embeddings),
    held AS (SELECT vec_id, clause, j, k, l FROM node, leaf WHERE list_transform(place, lambda p: x[p]) = want GROUP BY ALL),
    ands AS (SELECT vec_id, clause, j, k FROM held GROUP BY ALL HAVING count(*) = 2),
    ors AS (SELECT DISTINCT vec_id, clause, j FROM ands),
    fired AS (SELECT vec_id, clause FROM ors GROUP BY ALL HAVING count(*) = 2)"""


@query("cl07_indexed_clauses", f"WITH {_SQL} SELECT vec_id // 4 AS graph_id, CAST(vec_id % 4 AS INTEGER) AS node_id, CAST(clause AS INTEGER) AS clause FROM fired")
def cl07_indexed(spark, sf_dir):
    """Every clause that holds at a node. Numbers that no part has, as 0, include nothing and always hold; they are left out."""
    ta, spec = _machine(spark, sf_dir)
    rows = clause_index.held_clauses(_nodes(spark, sf_dir), ta, spec, spec.states, empty=False)
    return rows.select(F.col("clause").cast("int").alias("clause"), "graph_id", F.col("node_id").cast("int").alias("node_id"))


@query("cl10_indexed_sums", f"WITH {_SQL}, g AS (SELECT DISTINCT vec_id // 4 AS graph_id, clause FROM fired), a AS (SELECT DISTINCT vec_id // 4 AS graph_id FROM embeddings) SELECT graph_id, CAST(greatest(-2000, least(2000, coalesce((SELECT sum(CASE WHEN clause % 2 = 0 THEN 1 ELSE -1 END) FROM g WHERE g.graph_id = a.graph_id), 0) + (SELECT coalesce(sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END), 0) FROM range((SELECT max(p_partkey) + 2 - max(p_partkey) % 2 FROM part)) t(c) WHERE c NOT IN (SELECT p_partkey FROM part)))) AS INTEGER) AS class_sum FROM a")
def cl10_indexed(spark, sf_dir):
    """Class sums of the graphs: each clause votes once if it holds at any node; numbers that no part has are empty clauses."""
    ta, spec = _machine(spark, sf_dir)
    own, t = clause_index.graph_votes(_nodes(spark, sf_dir), ta, spec, spec.states), F.lit(spec.threshold)
    return own.select("graph_id", F.greatest(-t, F.least(t, F.col("votes"))).cast("int").alias("class_sum"))
