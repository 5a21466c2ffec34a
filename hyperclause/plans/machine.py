"""The sample machine that the registered queries share, and its tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import mix, mix_sql
from ..operators import clauses, encoding
from . import derived

DIM, SPARSITY, SEED, HOPS = 64, 0.2, 42, 2
ONES = encoding.ones_of(DIM, SPARSITY)
SPEC = clauses.Spec()
INCLUDE = SPEC.states


def book(spark: SparkSession) -> DataFrame:
    return encoding.codebook(spark, derived.ATOMS, derived.BONDS, HOPS + 1, DIM, SPARSITY, SEED)


def automata(spark: SparkSession) -> DataFrame:
    return clauses.hashed_states(clauses.addresses(spark, SPEC), 1, 150, SEED)


def table_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automata of a machine with a clause for each supplier; states follow from its key and nation."""
    rows = derived.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("clause"), F.col("s_nationkey").alias("nation"))
    key = (((F.col("j") * 16 + F.col("k")) * 16 + F.col("l")) * 256 + F.col("m") * 16 + F.col("n")) + F.col("nation") * 65536
    return clauses.addresses_of(rows, SPEC).withColumn("state", (1 + mix(F.col("clause"), key, SEED) % 150).cast("int")).drop("nation")


def vectors(spark: SparkSession, sf_dir: str, hops: int = HOPS, read_bits: int | None = None) -> DataFrame:
    nodes, near = derived.nodes(spark, sf_dir), encoding.adjacency(derived.bonds(spark, sf_dir))
    return encoding.node_vectors(nodes, near, book(spark), hops, DIM, read_bits)


def fired(spark: SparkSession, sf_dir: str, negation: str = "complement") -> DataFrame:
    """Only the bits that literals read are encoded, at one hop."""
    read = SPEC.features * (1 if negation == "complement" else 2)
    return clauses.fired_words(vectors(spark, sf_dir, 1, read), clauses.model(automata(spark), SPEC, INCLUDE), SPEC, negation)


def graph_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.graph_clauses(fired(spark, sf_dir), SPEC)


def predictions(spark: SparkSession, sf_dir: str, at_nodes: DataFrame | None = None) -> DataFrame:
    """graph_id, class_sum, pred. at_nodes: what `fired` gives, if it is at hand."""
    own = (graph_fired(spark, sf_dir) if at_nodes is None else clauses.graph_clauses(at_nodes, SPEC)).select("graph_id", clauses.class_sum(F.col("fired"), SPEC).alias("class_sum"))
    return own.withColumn("pred", (F.col("class_sum") > 0).cast("int"))


CODES_SQL = f"""
    kinds AS (
        SELECT 'atom' AS kind, 0 AS number, CAST(range AS INTEGER) AS code FROM range({derived.ATOMS})
        UNION ALL SELECT 'bond', 1, CAST(range AS INTEGER) FROM range({derived.BONDS})
        UNION ALL SELECT 'role', 2, CAST(range AS INTEGER) FROM range({HOPS + 1})),
    positions AS (SELECT CAST(range AS INTEGER) AS bit FROM range({DIM})),
    ranked AS (
        SELECT kind, code, bit, row_number() OVER (PARTITION BY kind, code ORDER BY {mix_sql("number * 1000 + code", "bit", SEED)}, bit) AS r
        FROM kinds CROSS JOIN positions),
    codes AS (SELECT kind, code, bit, CAST(r <= {ONES} AS INTEGER) AS v FROM ranked)"""

ADJACENCY_SQL = """
    numbered AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY u, v, bond_type) AS edge_id FROM bonds WHERE u <> v),
    adjacent AS (
        SELECT graph_id, u AS src, v AS dst, bond_type, edge_id FROM numbered
        UNION ALL SELECT graph_id, v, u, bond_type, edge_id FROM numbered)"""

HOPS_SQL = """
    hop1 AS (SELECT graph_id, src AS root, dst AS node_id, bond_type AS b1, edge_id AS r1 FROM adjacent),
    met AS (
        SELECT h.graph_id, h.root, a.dst AS node_id, h.b1, a.bond_type AS b2,
               row_number() OVER (PARTITION BY h.graph_id, h.root, a.dst ORDER BY h.r1, a.edge_id) AS r
        FROM hop1 h JOIN adjacent a ON h.graph_id = a.graph_id AND h.node_id = a.src
        WHERE a.dst <> h.root AND NOT EXISTS (SELECT 1 FROM hop1 x WHERE x.graph_id = h.graph_id AND x.root = h.root AND x.node_id = a.dst)),
    near AS (
        SELECT graph_id, node_id AS root, node_id, 0 AS hop, NULL AS b1, NULL AS b2 FROM nodes
        UNION ALL SELECT graph_id, root, node_id, 1, b1, NULL FROM hop1
        UNION ALL SELECT graph_id, root, node_id, 2, b1, b2 FROM met WHERE r = 1)"""


def bits_sql(hops: int, read: int) -> str:
    """Node vectors bit by bit: node_bits(graph_id, node_id, bit, v)."""
    return f"""
    spread AS (
        SELECT n.graph_id, n.root, n.hop, p.bit,
               (a.v + coalesce(b.v, 0) + coalesce(c.v, 0)) % 2 AS v
        FROM near n JOIN nodes e ON n.graph_id = e.graph_id AND n.node_id = e.node_id AND n.hop <= {hops}
        JOIN positions p ON p.bit < {read}
        JOIN codes a ON a.kind = 'atom' AND a.code = e.atom_type AND a.bit = (p.bit - n.hop + {DIM}) % {DIM}
        LEFT JOIN codes b ON b.kind = 'bond' AND b.code = n.b1 AND b.bit = a.bit
        LEFT JOIN codes c ON c.kind = 'bond' AND c.code = n.b2 AND c.bit = a.bit),
    node_bits AS (
        SELECT graph_id, root AS node_id, bit,
               CAST(2 * sum(v) + sum(CASE WHEN hop = 0 THEN v ELSE 0 END) > count(*) AS INTEGER) AS v
        FROM spread GROUP BY graph_id, root, bit)"""


WORDS_SQL = """CAST(sum(CASE WHEN bit < 32 THEN CAST(v AS BIGINT) << bit ELSE 0 END) AS BIGINT) AS w0,
               CAST(sum(CASE WHEN bit >= 32 THEN CAST(v AS BIGINT) << (bit - 32) ELSE 0 END) AS BIGINT) AS w1"""

_KEY = "((j * 16 + k) * 16 + l) * 256 + m * 16 + n"
AUTOMATA_SQL = f"""
    places AS (
        SELECT CAST(c.range AS INTEGER) AS clause, CAST(j.range AS INTEGER) AS j, CAST(k.range AS INTEGER) AS k, CAST(l.range AS INTEGER) AS l,
               CAST(m.range AS INTEGER) AS m, CAST(n.range AS INTEGER) AS n
        FROM range({SPEC.clauses}) c, range({SPEC.root}) j, range({SPEC.inner_or}) k, range({SPEC.inner_and}) l, range({SPEC.leaf_or}) m, range({2 * SPEC.leaf_and}) n),
    ta AS (
        SELECT *, CAST(j * {SPEC.inner_and * SPEC.leaf_and} + l * {SPEC.leaf_and} + n % {SPEC.leaf_and} AS INTEGER) AS feature,
               CAST(1 + {mix_sql("clause", _KEY, SEED)} % 150 AS INTEGER) AS state
        FROM places)"""
#: The automata of `table_automata`, under the same name.
TABLE_AUTOMATA_SQL = f"""
    places AS (
        SELECT CAST(s_suppkey AS INTEGER) AS clause, s_nationkey AS nation, CAST(j.range AS INTEGER) AS j, CAST(k.range AS INTEGER) AS k, CAST(l.range AS INTEGER) AS l,
               CAST(m.range AS INTEGER) AS m, CAST(n.range AS INTEGER) AS n
        FROM supplier, range({SPEC.root}) j, range({SPEC.inner_or}) k, range({SPEC.inner_and}) l, range({SPEC.leaf_or}) m, range({2 * SPEC.leaf_and}) n),
    ta AS (
        SELECT *, CAST(j * {SPEC.inner_and * SPEC.leaf_and} + l * {SPEC.leaf_and} + n % {SPEC.leaf_and} AS INTEGER) AS feature,
               CAST(1 + {mix_sql("clause", f"{_KEY} + nation * 65536", SEED)} % 150 AS INTEGER) AS state
        FROM places)"""
LEAVES_SQL = f"""
    leaf AS (
        SELECT clause, j, k, l, m,
               bit_or(CASE WHEN state > {INCLUDE} AND n < {SPEC.leaf_and} THEN CAST(1 AS BIGINT) << feature ELSE 0 END) AS pos,
               bit_or(CASE WHEN state > {INCLUDE} AND n >= {SPEC.leaf_and} THEN CAST(1 AS BIGINT) << feature ELSE 0 END) AS neg
        FROM ta GROUP BY clause, j, k, l, m)"""


def fired_sql(negation: str = "complement") -> str:
    """All tables up to node_fired(graph_id, node_id, clause, ways)."""
    f, full = SPEC.features, (1 << SPEC.features) - 1
    negative = f"{full} - sum(CASE WHEN bit < {f} THEN CAST(v AS BIGINT) << bit ELSE 0 END)" if negation == "complement" else f"sum(CASE WHEN bit >= {f} THEN CAST(v AS BIGINT) << (bit - {f}) ELSE 0 END)"
    return f"""WITH {derived.SQL}, {CODES_SQL}, {ADJACENCY_SQL}, {HOPS_SQL}, {bits_sql(1, f if negation == "complement" else 2 * f)}, {AUTOMATA_SQL}, {LEAVES_SQL},
    input AS (
        SELECT graph_id, node_id, CAST(sum(CASE WHEN bit < {f} THEN CAST(v AS BIGINT) << bit ELSE 0 END) AS BIGINT) AS x, CAST({negative} AS BIGINT) AS nx
        FROM node_bits GROUP BY graph_id, node_id),
    hit AS (
        SELECT i.x, i.nx, clause, j, k, l, sum(CASE WHEN (pos & ({full} - x)) = 0 AND (neg & ({full} - nx)) = 0 THEN 1 ELSE 0 END) AS s
        FROM (SELECT DISTINCT x, nx FROM input) i CROSS JOIN leaf GROUP BY i.x, i.nx, clause, j, k, l),
    conj AS (SELECT x, nx, clause, j, k, product(s) AS s FROM hit GROUP BY x, nx, clause, j, k),
    disj AS (SELECT x, nx, clause, j, sum(s) AS s FROM conj GROUP BY x, nx, clause, j),
    tree AS (SELECT x, nx, clause, CAST(product(s) AS BIGINT) AS ways FROM disj GROUP BY x, nx, clause),
    node_fired AS (SELECT graph_id, node_id, clause, ways FROM input JOIN tree USING (x, nx)),
    graph_fired AS (SELECT graph_id, clause, max(CAST(ways > 0 AS INTEGER)) AS output FROM node_fired GROUP BY graph_id, clause),
    summed AS (
        SELECT graph_id, CAST(greatest(-{SPEC.threshold}, least({SPEC.threshold}, sum(CASE WHEN clause % 2 = 0 THEN output ELSE -output END))) AS INTEGER) AS class_sum
        FROM graph_fired GROUP BY graph_id)"""
