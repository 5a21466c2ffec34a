"""Queries of bit vectors, encoders and clause machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import mix_sql
from ..operators import clauses, encoding
from . import derived, machine
from .derived import read
from .machine import DIM, SEED, SPEC
from .registry import query

BASE = f"WITH {derived.SQL}"
WORDS = ["words[0] AS w0", "words[1] AS w1"]
HV = ["hv[0] AS w0", "hv[1] AS w1"]
_coin = f"CAST(({mix_sql('p_partkey', 'i', SEED)} // 8) % 2 AS INTEGER)"
#: Random bits of each part, and of its brand-mate by number.
PART_BITS = f"WITH b AS (SELECT p_partkey, CAST(i AS INTEGER) AS bit, {_coin} AS v FROM part CROSS JOIN range({DIM}) t(i))"


def _part_bits(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", bits.random_bits(F.col("p_partkey"), DIM, SEED).alias("bits"))


@query("enc01_random_bits", f"{PART_BITS} SELECT p_partkey, {machine.WORDS_SQL} FROM b GROUP BY p_partkey")
def enc01(spark, sf_dir):
    return _part_bits(spark, sf_dir).withColumn("words", bits.pack(F.col("bits"))).selectExpr("p_partkey", *WORDS)


@query(
    "enc02_bind",
    f"""{PART_BITS}, o AS (SELECT p_partkey, CAST(i AS INTEGER) AS bit, CAST(({mix_sql("p_size", "i", SEED)} // 8) % 2 AS INTEGER) AS v FROM part CROSS JOIN range({DIM}) t(i)),
    x AS (SELECT b.p_partkey, b.bit, (b.v + o.v) % 2 AS v FROM b JOIN o USING (p_partkey, bit))
    SELECT p_partkey, {machine.WORDS_SQL} FROM x GROUP BY p_partkey""",
)
def enc02(spark, sf_dir):
    other = bits.pack(bits.random_bits(F.col("p_size"), DIM, SEED))
    return _part_bits(spark, sf_dir).withColumn("words", bits.bind(bits.pack(F.col("bits")), other)).selectExpr("p_partkey", *WORDS)


@query(
    "enc03_majority",
    f"""WITH b AS (SELECT p_brand, p_partkey, CAST(i AS INTEGER) AS bit, {_coin} AS v, p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) AS lead FROM part CROSS JOIN range({DIM}) t(i)),
    g AS (SELECT p_brand, bit, CAST(2 * sum(v) + sum(CASE WHEN lead THEN v ELSE 0 END) > count(*) AS INTEGER) AS v FROM b GROUP BY p_brand, bit)
    SELECT p_brand, {machine.WORDS_SQL} FROM g GROUP BY p_brand""",
)
def enc03(spark, sf_dir):
    """Each brand's least key is joined on, a row for each brand, so that no brand's parts meet in one task. A small file is one
    task's input: keys are spread before they are hashed."""
    parts = read(spark, sf_dir, "part").select("p_brand", "p_partkey")
    leads = parts.groupBy(F.col("p_brand").alias("__brand")).agg(F.min("p_partkey").alias("least"))
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lead = F.coalesce(F.col("p_partkey") == F.col("least"), F.lit(False)).alias("lead")
    coded = encoding.random_vectors(spread.join(F.broadcast(leads), F.col("p_brand").eqNullSafe(F.col("__brand"))).select("p_brand", "p_partkey", lead), "p_partkey", DIM, SEED)
    return encoding.majority(coded, ["p_brand"], "hv", F.col("lead"), DIM).selectExpr("p_brand", *HV)


@query("enc04_codebook", f"{BASE}, {machine.CODES_SQL}, used AS (SELECT 'atom' AS kind, atom_type AS code, count(*) AS uses FROM nodes GROUP BY atom_type UNION ALL SELECT 'bond', bond_type, count(*) FROM bonds GROUP BY bond_type) SELECT kind, code, any_value(uses) AS uses, CAST(sum(v) AS INTEGER) AS set_bits, {machine.WORDS_SQL} FROM codes JOIN used USING (kind, code) GROUP BY kind, code")
def enc04(spark, sf_dir):
    """The codes of the atoms and bonds that the graphs have, and how often."""
    used = [part(spark, sf_dir).groupBy(F.lit(kind).alias("kind"), F.col(f"{kind}_type").alias("code")).agg(F.count(F.lit(1)).alias("uses")) for kind, part in (("atom", derived.nodes), ("bond", derived.bonds))]
    return machine.book(spark).join(used[0].unionByName(used[1]), ["kind", "code"]).selectExpr("kind", "code", "uses", "aggregate(bits, 0, (a, b) -> a + b) AS set_bits", *WORDS)


@query(
    "enc05_permute",
    f"{PART_BITS}, s AS (SELECT p_partkey, (bit + p_size) % {DIM} AS bit, v FROM b JOIN part USING (p_partkey)) SELECT p_partkey, {machine.WORDS_SQL} FROM s GROUP BY p_partkey",
)
def enc05(spark, sf_dir):
    return _part_bits(spark, sf_dir).withColumn("words", bits.pack(bits.permute(F.col("bits"), F.col("p_size")))).selectExpr("p_partkey", *WORDS)


@query(
    "enc06_similarity",
    f"""{PART_BITS} SELECT a.p_partkey, round(1.0 - sum(CASE WHEN a.v <> c.v THEN 1 ELSE 0 END) / {DIM}.0, 6) AS similarity
    FROM b a JOIN b c ON c.p_partkey = 1 AND a.bit = c.bit GROUP BY a.p_partkey""",
)
def enc06(spark, sf_dir):
    first = bits.pack(bits.random_bits(F.lit(1), DIM, SEED))
    return _part_bits(spark, sf_dir).select("p_partkey", F.round(bits.similarity(bits.pack(F.col("bits")), first, DIM), 6).alias("similarity"))


@query(
    "enc07_thermometer",
    """SELECT l_orderkey, l_linenumber, l_quantity, CAST(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN l_quantity > 0.0 + least(i, 7) * 6.25 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS bits FROM lineitem""",
)
def enc07(spark, sf_dir):
    coded = bits.pack(bits.thermometer(F.col("l_quantity"), 8, 0.0, 50.0))[0]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", coded.alias("bits"))


@query("enc08_thermometer_int", "SELECT p_partkey, CAST((CAST(1 AS BIGINT) << least(16, greatest(0, p_size))) - 1 AS BIGINT) AS bits FROM part")
def enc08(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", bits.pack(bits.thermometer_int(F.col("p_size"), 16))[0].alias("bits"))


@query("enc09_one_hot", "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 31 THEN CAST(1 AS BIGINT) << p_size ELSE 0 END AS bits FROM part")
def enc09(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", bits.pack(bits.one_hot(F.col("p_size"), 32))[0].alias("bits"))


@query(
    "enc11_edge_vectors",
    f"""{BASE}, {machine.CODES_SQL}, {machine.ADJACENCY_SQL},
    e AS (SELECT x.graph_id, src, dst, p.bit, (a.v + b.v + c.v) % 2 AS v
          FROM adjacent x JOIN nodes s ON s.graph_id = x.graph_id AND s.node_id = src JOIN nodes t ON t.graph_id = x.graph_id AND t.node_id = dst
          CROSS JOIN positions p JOIN codes a ON a.kind = 'atom' AND a.code = s.atom_type AND a.bit = p.bit
          JOIN codes b ON b.kind = 'bond' AND b.code = bond_type AND b.bit = p.bit JOIN codes c ON c.kind = 'atom' AND c.code = t.atom_type AND c.bit = p.bit)
    SELECT graph_id, src, dst, {machine.WORDS_SQL} FROM e GROUP BY graph_id, src, dst""",
)
def enc11(spark, sf_dir):
    near = encoding.adjacency(derived.bonds(spark, sf_dir))
    return encoding.edge_vectors(derived.nodes(spark, sf_dir), near, machine.book(spark)).selectExpr("graph_id", "src", "dst", *HV)


@query("enc12_adjacency", f"{BASE}, {machine.ADJACENCY_SQL} SELECT graph_id, src, dst, bond_type, CAST(edge_id AS INTEGER) AS edge_id FROM adjacent")
def enc12(spark, sf_dir):
    return encoding.adjacency(derived.bonds(spark, sf_dir)).select("graph_id", "src", "dst", "bond_type", "edge_id")


@query("enc13_neighbourhoods", f"{BASE}, {machine.ADJACENCY_SQL}, {machine.HOPS_SQL} SELECT graph_id, root, hop, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS node_sum FROM near GROUP BY graph_id, root, hop")
def enc13(spark, sf_dir):
    near = encoding.neighbourhoods(derived.nodes(spark, sf_dir), encoding.adjacency(derived.bonds(spark, sf_dir)), machine.book(spark), 2)
    return near.groupBy("graph_id", "root", "hop").agg(F.count(F.lit(1)).alias("n"), F.sum("node_id").alias("node_sum"))


@query("enc14_node_vectors", f"{BASE}, {machine.CODES_SQL}, {machine.ADJACENCY_SQL}, {machine.HOPS_SQL}, {machine.bits_sql(2, DIM)} SELECT graph_id, node_id, {machine.WORDS_SQL} FROM node_bits GROUP BY graph_id, node_id")
def enc14(spark, sf_dir):
    return machine.vectors(spark, sf_dir).selectExpr("graph_id", "node_id", *HV)


@query("enc16_bit_test", f"{PART_BITS} SELECT p_partkey, v AS bit FROM b JOIN part USING (p_partkey) WHERE b.bit = p_size % {DIM}")
def enc16(spark, sf_dir):
    return _part_bits(spark, sf_dir).select("p_partkey", bits.bit(bits.pack(F.col("bits")), F.col("p_size") % DIM).alias("bit"))


def _hot(key: str, i: str) -> str:
    return f"({mix_sql(key, '0', SEED)} % 32 + {i} * (({mix_sql(key, '1', SEED)} % 16) * 2 + 1)) % 32"


def _symbols(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol")).distinct()


@query("enc19_symbol_codes", f"SELECT CAST(s AS BIGINT) AS symbol, CAST(i AS INTEGER) AS i, CAST({_hot('s', 'i')} AS INTEGER) AS place FROM (SELECT DISTINCT p_partkey AS s FROM part) a CROSS JOIN range(3) b(i)")
def enc19(spark, sf_dir):
    return _symbols(spark, sf_dir).select("symbol", F.posexplode(bits.hot_bits(F.col("symbol"), 3, 32, SEED)).alias("i", "place"))


@query("enc19_one_hot_codes", "SELECT DISTINCT p_partkey AS symbol, CAST(p_partkey AS INTEGER) AS place FROM part")
def enc19_one_hot(spark, sf_dir):
    return _symbols(spark, sf_dir).select("symbol", F.explode(bits.one_hot_place(F.col("symbol"))).alias("place"))


@query("enc19_random_codes", f"WITH r AS (SELECT s AS symbol, CAST(p AS INTEGER) AS place, row_number() OVER (PARTITION BY s ORDER BY {mix_sql('s', 'p', SEED)}, p) AS r FROM (SELECT DISTINCT p_partkey AS s FROM part) a CROSS JOIN range(32) b(p)) SELECT symbol, place FROM r WHERE r <= 3")
def enc19_random(spark, sf_dir):
    return _symbols(spark, sf_dir).select("symbol", F.explode(bits.random_places(F.col("symbol"), 3, 32, SEED)).alias("place"))


_PROPERTIES = f"""places AS (SELECT DISTINCT graph_id, node_id, {_hot("atom_type", "i")} AS place FROM nodes CROSS JOIN range(3) t(i)),
    property_bits AS (SELECT n.graph_id, n.node_id, b.range AS bit, CAST(p.place IS NOT NULL AS INTEGER) AS v FROM nodes n CROSS JOIN range(32) b
        LEFT JOIN places p ON p.graph_id = n.graph_id AND p.node_id = n.node_id AND p.place = b.range)"""


@query(
    "enc17_properties",
    f"{BASE}, {_PROPERTIES} SELECT graph_id, node_id, CAST(sum(CAST(v AS BIGINT) << bit) AS BIGINT) AS own, CAST(sum(CAST(1 - v AS BIGINT) << bit) AS BIGINT) AS complement FROM property_bits GROUP BY graph_id, node_id",
)
def enc17(spark, sf_dir):
    symbols = derived.nodes(spark, sf_dir).withColumnRenamed("atom_type", "symbol")
    own = F.col("words")
    return encoding.property_words(symbols, 32, 3, SEED).select("graph_id", "node_id", own[0].alias("own"), bits.inverted(own, 32)[0].alias("complement"))


@query(
    "enc20_membership",
    f"""{BASE}, {_PROPERTIES}, code AS (SELECT s AS symbol, {_hot("s", "i")} AS place FROM range(9) a(s) CROSS JOIN range(3) b(i))
    SELECT graph_id, node_id, CAST(symbol AS INTEGER) AS symbol FROM property_bits JOIN code ON place = bit GROUP BY graph_id, node_id, symbol HAVING min(v) = 1""",
)
def enc20(spark, sf_dir):
    symbols = derived.nodes(spark, sf_dir).withColumnRenamed("atom_type", "symbol")
    own = encoding.property_vectors(symbols, 32, 3, SEED, complement=False)
    codes = [bits.hot_bits(F.lit(s), 3, 32, SEED) for s in range(9)]
    held = F.array(*[F.when(F.forall(c, lambda p: F.get("bits", p) == 1), s) for s, c in enumerate(codes)])
    return own.select("graph_id", "node_id", F.explode(F.filter(held, lambda s: s.isNotNull())).alias("symbol"))


@query(
    "enc21_nearest_code",
    f"""WITH {machine.CODES_SQL}, b AS (SELECT p_partkey, CAST(i AS INTEGER) AS bit, {_coin} AS v FROM part CROSS JOIN range({DIM}) t(i)),
    d AS (SELECT p_partkey, code, sum(CASE WHEN b.v <> c.v THEN 1 ELSE 0 END) AS differ FROM b JOIN codes c ON c.kind = 'atom' AND c.bit = b.bit GROUP BY p_partkey, code),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY differ, code) AS r FROM d)
    SELECT p_partkey, code, round(1.0 - differ / {DIM}.0, 6) AS similarity FROM r WHERE r = 1""",
)
def enc21(spark, sf_dir):
    parts = _part_bits(spark, sf_dir).select("p_partkey", bits.pack(F.col("bits")).alias("hv"))
    return encoding.nearest_code(parts, "hv", machine.book(spark), "atom", DIM).select("p_partkey", "code", F.round("similarity", 6).alias("similarity"))


@query("enc24_targets", f"{BASE} SELECT graph_id, CASE WHEN y = 1 THEN {SPEC.threshold} ELSE -{SPEC.threshold} END AS target FROM graphs")
def enc24(spark, sf_dir):
    return derived.graphs(spark, sf_dir).select("graph_id", bits.target(F.col("y"), 1, SPEC.threshold).alias("target"))


# Clause machines

FIRED = machine.fired_sql()


@query("cl01_included", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, feature, state FROM ta WHERE state > {machine.INCLUDE}")
def cl01(spark, sf_dir):
    return clauses.included(machine.table_automata(spark, sf_dir), machine.INCLUDE).select("clause", "j", "k", "l", "m", "n", "feature", "state")


@query("cl02_leaves", f"WITH {machine.TABLE_AUTOMATA_SQL}, {machine.LEAVES_SQL} SELECT clause, j, k, l, m, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM leaf")
def cl02(spark, sf_dir):
    return clauses.leaves(machine.table_automata(spark, sf_dir), SPEC, machine.INCLUDE)


@query("cl07_node_clauses", f"{FIRED} SELECT graph_id, node_id, clause, CAST(ways > 0 AS INTEGER) AS output FROM node_fired")
def cl07(spark, sf_dir):
    rows = machine.fired(spark, sf_dir)
    return rows.select("graph_id", "node_id", F.posexplode_outer(bits.unpack(F.col("fired"), SPEC.clauses)).alias("clause", "output"))


@query("cl07_node_clauses_offset", f"{machine.fired_sql('offset')} SELECT graph_id, node_id, clause, CAST(ways > 0 AS INTEGER) AS output FROM node_fired")
def cl07_offset(spark, sf_dir):
    rows = machine.fired(spark, sf_dir, "offset")
    return rows.select("graph_id", "node_id", F.posexplode_outer(bits.unpack(F.col("fired"), SPEC.clauses)).alias("clause", "output"))


@query("cl08_graph_clauses", f"{FIRED} SELECT graph_id, clause, output FROM graph_fired")
def cl08(spark, sf_dir):
    return clauses.clause_outputs(machine.graph_fired(spark, sf_dir), SPEC)


@query("cl09_class_sums", f"{FIRED} SELECT graph_id, class_sum FROM summed")
def cl09(spark, sf_dir):
    return machine.graph_fired(spark, sf_dir).select("graph_id", clauses.class_sum(F.col("fired"), SPEC).alias("class_sum"))


@query("cl10_class_scores", f"{FIRED} SELECT graph_id, 0 AS class_id, 0 AS score FROM summed UNION ALL SELECT graph_id, 1, class_sum FROM summed")
def cl10(spark, sf_dir):
    return clauses.class_scores(machine.graph_fired(spark, sf_dir), SPEC)


@query("cl11_predict", f"{FIRED} SELECT graph_id, CAST(class_sum > 0 AS INTEGER) AS pred FROM summed")
def cl11(spark, sf_dir):
    return clauses.predict(clauses.class_scores(machine.graph_fired(spark, sf_dir), SPEC))


@query(
    "cl12_weighted_sums",
    f"{FIRED} SELECT graph_id, CAST(c AS INTEGER) AS class_id, CAST(sum({mix_sql('clause', 'c', 7)} % 21 - 10) AS BIGINT) AS score FROM graph_fired CROSS JOIN range(3) t(c) WHERE output = 1 GROUP BY graph_id, c",
)
def cl12(spark, sf_dir):
    from ..functions.hashing import mix

    weights = spark.range(SPEC.clauses).select(F.col("id").cast("int").alias("clause"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("class_id"))
    weights = weights.withColumn("weight", mix(F.col("clause"), F.col("class_id"), 7) % 21 - 10)
    return clauses.weighted_sums(clauses.clause_outputs(machine.graph_fired(spark, sf_dir), SPEC), weights)


@query("cl15_include_counts", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, count(*) FILTER (WHERE state > {machine.INCLUDE}) AS n FROM ta GROUP BY clause")
def cl15(spark, sf_dir):
    return machine.table_automata(spark, sf_dir).groupBy("clause").agg(F.count_if(F.col("state") > machine.INCLUDE).alias("n"))


#: Flat rows: the signs of the first components of the embeddings.
_FLAT = f"""WITH {machine.AUTOMATA_SQL}, {machine.LEAVES_SQL},
    input AS (SELECT vec_id, CAST(list_sum(list_transform(range({SPEC.features}), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS x FROM embeddings),
    hit AS (SELECT vec_id, clause, j, k, l, sum(CASE WHEN (pos & ({(1 << SPEC.features) - 1} - x)) = 0 AND (neg & x) = 0 THEN 1 ELSE 0 END) AS s FROM input CROSS JOIN leaf GROUP BY vec_id, clause, j, k, l),
    conj AS (SELECT vec_id, clause, j, k, product(s) AS s FROM hit GROUP BY vec_id, clause, j, k),
    disj AS (SELECT vec_id, clause, j, sum(s) AS s FROM conj GROUP BY vec_id, clause, j),
    tree AS (SELECT vec_id, clause, CAST(product(s) AS BIGINT) AS ways FROM disj GROUP BY vec_id, clause)"""


def _flat(spark, sf_dir, overflow="exact"):
    signs = F.transform(F.slice("embedding", 1, SPEC.features), lambda v: (v > 0).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", bits.pack(signs).alias("hv"))
    x, nx = clauses.literal_inputs(F.col("hv"), SPEC, "complement")
    held = clauses.with_model(rows.select("vec_id", x.alias("x"), nx.alias("nx")), clauses.model(machine.automata(spark), SPEC, machine.INCLUDE))
    ways = F.transform("clauses", lambda c: clauses.multiplicity(c, F.col("x"), F.col("nx"), overflow))
    return held.select("vec_id", F.posexplode_outer(ways).alias("clause", "ways"))


@query("cl22_flat_multiplicity", f"{_FLAT} SELECT vec_id, clause, ways FROM tree")
def cl22(spark, sf_dir):
    return _flat(spark, sf_dir)


@query("cl22_flat_wrapped", f"{_FLAT} SELECT vec_id, clause, ways FROM tree")
def cl22_wrapped(spark, sf_dir):
    """At this shape nothing overflows, so wrapping changes nothing; tests hold it against larger shapes."""
    return _flat(spark, sf_dir, "wrap32")


@query("cl22_flat_scores", f"{_FLAT} SELECT vec_id, CAST(greatest(-{SPEC.threshold}, least({SPEC.threshold}, sum(CASE WHEN clause % 2 = 0 THEN ways ELSE -ways END))) AS BIGINT) AS score FROM tree GROUP BY vec_id")
def cl22_scores(spark, sf_dir):
    votes = F.sum(F.col("ways") * clauses.sign(F.col("clause")))
    return _flat(spark, sf_dir).groupBy("vec_id").agg(F.greatest(F.lit(-SPEC.threshold), F.least(F.lit(SPEC.threshold), votes)).cast("long").alias("score"))


@query(
    "exp08_bit_planes",
    f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, CAST(p AS INTEGER) AS plane, CAST((state >> p) & 1 AS INTEGER) AS bit FROM ta CROSS JOIN range(8) t(p)",
)
def exp08(spark, sf_dir):
    return machine.table_automata(spark, sf_dir).select("clause", "j", "k", "l", "m", "n", F.posexplode(clauses.bit_planes(F.col("state"))).alias("plane", "bit"))


@query("exp08_planes_decoded", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, CAST(state AS BIGINT) AS state, CAST(state > {machine.INCLUDE} AS INTEGER) AS action FROM ta")
def exp08_decoded(spark, sf_dir):
    state = clauses.from_planes(clauses.bit_planes(F.col("state")))
    return machine.table_automata(spark, sf_dir).select("clause", "j", "k", "l", "m", "n", state.alias("state"), (state > machine.INCLUDE).cast("int").alias("action"))
