"""Queries of recourse, training, molecules, sources and sinks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import mix_sql
from ..operators import chemistry, clauses, encoding, metrics, recourse, training
from ..sources import readers, writers
from ..streaming import scoring
from . import derived, machine, smoke
from .core_queries import BASE, FIRED
from .derived import read
from .machine import INCLUDE, SEED, SPEC
from .registry import query

# Recourse

_NODE_EDITS = f"""edits AS (
    SELECT graph_id, src AS node_id, 0 AS kind, edge_id AS place, 'remove_bond' AS op, least(src, dst) AS i, greatest(src, dst) AS j, CAST(NULL AS INTEGER) AS new_value FROM adjacent
    UNION ALL SELECT graph_id, node_id, 1, 0, 'swap_atom', node_id, NULL, (atom_type + 1) % {derived.ATOMS} FROM nodes)"""


def _near(spark, sf_dir):
    return encoding.adjacency(derived.bonds(spark, sf_dir))


@query("rc03_node_candidates", f"{BASE}, {machine.ADJACENCY_SQL}, {_NODE_EDITS} SELECT graph_id, node_id, kind, CAST(place AS INTEGER) AS place, op, i, j, CAST(new_value AS INTEGER) AS new_value FROM edits")
def rc03(spark, sf_dir):
    return recourse.node_candidates(derived.nodes(spark, sf_dir), _near(spark, sf_dir), derived.ATOMS).withColumn("new_value", F.col("new_value").cast("int"))


@query(
    "rc04_edge_candidates",
    f"""{BASE}, {machine.ADJACENCY_SQL} SELECT graph_id, CAST(edge_id AS INTEGER) AS edge_id, 0 AS kind, 'remove_bond' AS op, src AS i, dst AS j, CAST(NULL AS INTEGER) AS new_value FROM adjacent WHERE src < dst
    UNION ALL SELECT graph_id, CAST(edge_id AS INTEGER), 1, 'swap_bond_order', src, dst, (bond_type + 1) % {derived.BONDS} FROM adjacent WHERE src < dst""",
)
def rc04(spark, sf_dir):
    return recourse.edge_candidates(_near(spark, sf_dir), derived.BONDS)


_CANDIDATES = f"""{_NODE_EDITS},
    firing AS (SELECT graph_id, node_id, min(clause) AS clause FROM node_fired WHERE ways > 0 GROUP BY graph_id, node_id),
    ordered AS (SELECT graph_id, op, i, j, new_value, row_number() OVER (PARTITION BY graph_id, op, i, j, new_value ORDER BY clause, node_id, kind, place) AS r, clause, node_id, kind, place FROM edits JOIN firing USING (graph_id, node_id)),
    candidate AS MATERIALIZED (SELECT * FROM (SELECT graph_id, op, i, j, CAST(new_value AS INTEGER) AS new_value, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY clause, node_id, kind, place) AS INTEGER) AS ordinal FROM ordered WHERE r = 1) WHERE ordinal <= 50)"""


def _firing(spark, sf_dir):
    rows = machine.fired(spark, sf_dir).select("graph_id", "node_id", F.posexplode_outer(bits.unpack(F.col("fired"), SPEC.clauses)).alias("clause", "output"))
    return rows.where("output = 1").select("graph_id", "clause", "node_id")


def _candidates(spark, sf_dir, **asked):
    return recourse.machine_candidates(derived.gathered(spark, sf_dir), _score(spark), derived.ATOMS, **asked)


@query("rc05_candidates", f"{FIRED}, {_CANDIDATES} SELECT graph_id, ordinal, op, i, j, new_value FROM candidate")
def rc05(spark, sf_dir):
    return _candidates(spark, sf_dir)


#: A clause fires on a bond if it fires at both ends.
_EDGE_CANDIDATES = f"""{_NODE_EDITS},
    fires_at AS (SELECT graph_id, node_id, clause FROM node_fired WHERE ways > 0),
    node_first AS (SELECT graph_id, node_id, min(clause) AS clause FROM fires_at GROUP BY graph_id, node_id),
    edge_first AS (SELECT a.graph_id, edge_id, src, dst, bond_type, min(x.clause) AS clause FROM adjacent a JOIN fires_at x ON x.graph_id = a.graph_id AND x.node_id = a.src
        JOIN fires_at z ON z.graph_id = a.graph_id AND z.node_id = a.dst AND z.clause = x.clause WHERE src < dst GROUP BY a.graph_id, edge_id, src, dst, bond_type),
    every AS (
        SELECT graph_id, op, i, j, CAST(new_value AS INTEGER) AS new_value, clause, 0 AS e, node_id AS w, kind, place FROM edits JOIN node_first USING (graph_id, node_id)
        UNION ALL SELECT graph_id, 'remove_bond', src, dst, NULL, clause, 1, edge_id, 0, 0 FROM edge_first
        UNION ALL SELECT graph_id, 'swap_bond_order', src, dst, (bond_type + 1) % {derived.BONDS}, clause, 1, edge_id, 1, 0 FROM edge_first),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY graph_id, op, i, j, new_value ORDER BY clause, e, w, kind, place) AS r FROM every),
    candidate AS (SELECT * FROM (SELECT graph_id, op, i, j, new_value, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY clause, e, w, kind, place) AS INTEGER) AS ordinal FROM ordered WHERE r = 1) WHERE ordinal <= 50)"""


@query("rc05_edge_candidates", f"{FIRED}, {_EDGE_CANDIDATES} SELECT graph_id, ordinal, op, i, j, new_value FROM candidate")
def rc05_edges(spark, sf_dir):
    return _candidates(spark, sf_dir, bond_types=derived.BONDS)


#: What the search without an encoder commits: the first three, as no candidate of a graph undoes another.
_FIRST = f"{FIRED}, {_CANDIDATES}, first AS (SELECT graph_id, ordinal AS step, op, i, j, new_value FROM candidate WHERE ordinal <= 3)"


def _first_valid(spark, sf_dir):
    return _candidates(spark, sf_dir, flips=3)


@query("rc07_first_valid", f"{_FIRST} SELECT graph_id, step, op, i, j, new_value FROM first")
def rc07(spark, sf_dir):
    return _first_valid(spark, sf_dir)


@query("rc14_evaluation", f"{_FIRST}, f AS (SELECT graph_id, CAST(count(*) AS DOUBLE) AS flips FROM first GROUP BY graph_id) SELECT count(*) AS n_evaluated, count(flips) AS successes, round(avg(flips), 9) AS mean_flips, round(count(flips) / CAST(count(*) AS DOUBLE), 9) AS success_rate, quantile_cont(flips, 0.5) AS flips_p50, quantile_cont(flips, 0.95) AS flips_p95 FROM graphs LEFT JOIN f USING (graph_id)")
def rc14(spark, sf_dir):
    got = recourse.evaluation(derived.graphs(spark, sf_dir), _fixed(spark)(_first_valid(spark, sf_dir)))
    return got.select("n_evaluated", "successes", F.round("mean_flips", 9).alias("mean_flips"), F.round("success_rate", 9).alias("success_rate"), "flips_p50", "flips_p95")


@query("rc14_top_edits", f"{_FIRST} SELECT op, i, j, count(*) AS n FROM first GROUP BY op, i, j ORDER BY n DESC, op, i, j NULLS FIRST LIMIT 10")
def rc14_top(spark, sf_dir):
    return recourse.top_edits(_first_valid(spark, sf_dir))


#: Variants as graphs of their own, numbered as the search numbers them, and the same tables over them.
_VARIANTS = """
    variant_nodes AS (SELECT n.graph_id * 51 + ordinal AS graph_id, node_id, CASE WHEN op = 'swap_atom' AND node_id = i THEN new_value ELSE atom_type END AS atom_type FROM nodes n JOIN candidate USING (graph_id)),
    variant_bonds AS (SELECT b.graph_id * 51 + ordinal AS graph_id, u, v, bond_type FROM bonds b JOIN candidate USING (graph_id) WHERE NOT (op = 'remove_bond' AND u = i AND v = j))"""


def _again(sql: str) -> str:
    """The tables from adjacency to sums once more, over the variants."""
    own = "numbered adjacent hop1 met near spread node_bits input hit conj disj tree node_fired graph_fired summed".split()
    for name in own:
        sql = re.sub(rf"\b{name}\b", f"{name}_v", sql)
    return re.sub(r"\bbonds\b", "variant_bonds", re.sub(r"\bnodes\b", "variant_nodes", sql))


_first = FIRED.index("numbered AS")
_model = FIRED[FIRED.index("places AS") : FIRED.index("input AS")]
_TRIED = f"{FIRED}, {_CANDIDATES}, {_VARIANTS}, {_again(FIRED[_first:].replace(_model, ''))}"


@query("rc06_tried_edits", f"{_TRIED} SELECT c.graph_id, ordinal, op, i, j, new_value, class_sum FROM candidate c JOIN summed_v s ON s.graph_id = c.graph_id * 51 + ordinal")
def rc06_tried(spark, sf_dir):
    return recourse.machine_trials(derived.gathered(spark, sf_dir), _score(spark), derived.ATOMS)


_STEP = f"""{_TRIED}, t AS (
        SELECT c.graph_id, ordinal, op, i, j, new_value, CASE WHEN b.class_sum > 0 THEN s.class_sum ELSE -s.class_sum END AS margin, abs(b.class_sum) AS now,
               (s.class_sum > 0) <> (b.class_sum > 0) AS flipped
        FROM candidate c JOIN summed_v s ON s.graph_id = c.graph_id * 51 + ordinal JOIN summed b ON b.graph_id = c.graph_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY NOT flipped, margin, ordinal) AS r FROM t),
    step AS (SELECT graph_id, ordinal, op, i, j, new_value, margin, flipped FROM r WHERE r = 1 AND (flipped OR margin < now))"""


@query("rc06_first_step", f"{_STEP} SELECT * FROM step")
def rc06_first(spark, sf_dir):
    return recourse.machine_steps(derived.gathered(spark, sf_dir), _score(spark), derived.ATOMS)


def _score(spark):
    return recourse.MachineScore(machine.book(spark), 1, machine.DIM, clauses.model(machine.automata(spark), SPEC, INCLUDE), SPEC)


def _state(spark, sf_dir, fired=None):
    own = machine.predictions(spark, sf_dir, fired)
    return own.select("graph_id", F.col("pred").alias("target"), F.abs("class_sum").alias("margin"))


def shared_folder(spark):
    """The folder that spark.checkpoint.dir names, or else the one set on the context; only a session in one process may do
    without a name for it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def _fixed(spark):
    """Small tables between rounds go to the shared checkpoint folder."""
    shared_folder(spark)
    return lambda df: df.checkpoint()


@query("rc06_search")
def rc06_search(spark, sf_dir):
    """Up to three rounds for every graph that is predicted positive."""
    own = recourse.Own(lambda: derived.gathered(spark, sf_dir), derived.ATOMS)
    return recourse.search(None, None, own, None, _score(spark), _fixed(spark), max_flips=3)


@query("rc02_removed_bonds", f"{BASE}, {machine.ADJACENCY_SQL}, e AS (SELECT graph_id, u, v, edge_id FROM numbered) SELECT b.graph_id, CAST(e.edge_id AS INTEGER) AS ordinal, b.u, b.v, b.bond_type FROM bonds b JOIN e ON e.graph_id = b.graph_id WHERE NOT (e.u = b.u AND e.v = b.v)")
def rc02(spark, sf_dir):
    removals = recourse.edge_candidates(_near(spark, sf_dir), derived.BONDS).where("op = 'remove_bond'").withColumnRenamed("edge_id", "ordinal").drop("kind")
    return recourse.apply_edits(derived.nodes(spark, sf_dir), derived.bonds(spark, sf_dir), removals)[1].select("graph_id", "ordinal", "u", "v", "bond_type")


@query("rc02_swapped_orders", f"{BASE}, {machine.ADJACENCY_SQL}, e AS (SELECT graph_id, u, v, edge_id FROM numbered) SELECT b.graph_id, CAST(e.edge_id AS INTEGER) AS ordinal, b.u, b.v, CAST(CASE WHEN e.u = b.u AND e.v = b.v THEN (b.bond_type + 1) % {derived.BONDS} ELSE b.bond_type END AS INTEGER) AS bond_type FROM bonds b JOIN e ON e.graph_id = b.graph_id")
def rc02_orders(spark, sf_dir):
    swaps = recourse.edge_candidates(_near(spark, sf_dir), derived.BONDS).where("op = 'swap_bond_order'").withColumnRenamed("edge_id", "ordinal").drop("kind")
    return recourse.apply_edits(derived.nodes(spark, sf_dir), derived.bonds(spark, sf_dir), swaps)[1].select("graph_id", "ordinal", "u", "v", "bond_type")


@query("rc09_valence", f"{BASE}, used AS (SELECT graph_id, node_id, sum(CASE bond_type WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 3 END) AS twice FROM (SELECT graph_id, u AS node_id, bond_type FROM bonds UNION ALL SELECT graph_id, v, bond_type FROM bonds) GROUP BY graph_id, node_id) SELECT graph_id FROM graphs WHERE graph_id NOT IN (SELECT n.graph_id FROM nodes n JOIN used USING (graph_id, node_id) WHERE twice > 2 * [4, 3, 2, 6, 1, 1, 1, 1, 8][atom_type + 1])")
def rc09(spark, sf_dir):
    return recourse_valence(spark, sf_dir)


def recourse_valence(spark, sf_dir):
    return chemistry.valence_ok(derived.nodes(spark, sf_dir), derived.bonds(spark, sf_dir), [4, 3, 2, 6, 1, 1, 1, 1, 8])


_EDIT = """'{"step":1,"op":"' || op || '","i":' || i || coalesce(',"j":' || j, '') || coalesce(',"new_value":' || new_value, '') || '}'"""
_AFTER = """',"after":{"class":' || CASE WHEN flipped THEN 1 - was ELSE was END || ',"score":' || CASE WHEN was = 1 THEN margin ELSE -margin END || '}'"""


@query("rc13_reports", f"""{_STEP}, b AS (SELECT graph_id, class_sum, CAST(class_sum > 0 AS INTEGER) AS was FROM summed)
    SELECT graph_id, '{{"edits":[' || coalesce({_EDIT}, '') || '],"prediction":{{"before":{{"class":' || was || ',"score":' || class_sum || '}}' || coalesce({_AFTER}, '') || '}}'
        || coalesce(',"flipped":' || CAST(flipped AS VARCHAR), '') || ',"n_edits":' || CAST(op IS NOT NULL AS INTEGER) || '}}' AS report
    FROM b LEFT JOIN step USING (graph_id)""")
def rc13(spark, sf_dir):
    fixed = _fixed(spark)
    before = fixed(machine.predictions(spark, sf_dir))
    steps = fixed(rc06_first(spark, sf_dir).withColumn("step", F.lit(1)))
    after = steps.join(before.select("graph_id", F.col("pred").alias("was")), "graph_id").select("graph_id", F.when(F.col("flipped"), 1 - F.col("was")).otherwise(F.col("was")).alias("pred"), F.when(F.col("was") == 1, F.col("margin")).otherwise(-F.col("margin")).alias("class_sum"))
    return recourse.reports(steps, before, after)


#: Edits that lines name: an op, two atoms and a value, some of which are missing or of no use.
_EDITS_SQL = """e AS (
        SELECT l_orderkey, l_linenumber, ['remove_bond', 'add_bond', 'swap_atom', 'swap_bond_order', 'rename'][1 + l_partkey % 5] AS op, CAST(l_suppkey % 4 - 1 AS INTEGER) AS i,
               CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 7 - 1 AS INTEGER) END AS j, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS new_value FROM lineitem)"""


@query("rc01_valid_edits", f"""WITH {_EDITS_SQL} SELECT l_orderkey, l_linenumber, op, coalesce(i >= 0 AND (j IS NULL OR j >= 0) AND CASE op
    WHEN 'remove_bond' THEN j IS NOT NULL AND i <> j WHEN 'add_bond' THEN j IS NOT NULL AND i <> j AND new_value IS NOT NULL WHEN 'swap_bond_order' THEN j IS NOT NULL AND i <> j AND new_value IS NOT NULL
    WHEN 'swap_atom' THEN j IS NULL AND new_value IS NOT NULL ELSE false END, false) AS ok FROM e""")
def rc01(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, ("remove_bond", "add_bond", "swap_atom", "swap_bond_order", "rename"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    j, value = F.when(F.col("l_partkey") % 3 > 0, (F.col("l_partkey") % 7 - 1).cast("int")), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber"))
    edits = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", op.alias("op"), (F.col("l_suppkey") % 4 - 1).cast("int").alias("i"), j.alias("j"), value.alias("new_value"))
    return edits.select("l_orderkey", "l_linenumber", "op", recourse.valid_edit(F.col("op"), F.col("i"), F.col("j"), F.col("new_value")).alias("ok"))


# Training


def _supplier_addresses(spark, sf_dir):
    return clauses.addresses_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("clause")), SPEC)


@query("tr01_balanced_start", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, CASE WHEN ({mix_sql('clause', f'((j * 16 + k) * 16 + l) * 256 + m * 16 + n % {SPEC.leaf_and}', 9)} // 8) % 2 = CAST(n < {SPEC.leaf_and} AS INTEGER) THEN {SPEC.states + 1} ELSE {SPEC.states} END AS state FROM ta")
def tr01(spark, sf_dir):
    return clauses.balanced_states(_supplier_addresses(spark, sf_dir), SPEC, 9).select("clause", "j", "k", "l", "m", "n", "state")


@query("tr02_central_start", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, n, {SPEC.states} AS state FROM ta")
def tr02(spark, sf_dir):
    return clauses.central_states(_supplier_addresses(spark, sf_dir), SPEC).select("clause", "j", "k", "l", "m", "n", "state")


@query("tr03_feedback_probability", f"{FIRED} SELECT graph_id, round(greatest(0.0, least(1.0, ({SPEC.threshold} + (1 - 2 * y) * class_sum) / (2.0 * {SPEC.threshold}))), 9) AS p FROM summed JOIN graphs USING (graph_id)")
def tr03(spark, sf_dir):
    joined = machine.predictions(spark, sf_dir).join(derived.graphs(spark, sf_dir), "graph_id")
    t = SPEC.threshold
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(t) + (1 - 2 * F.col("y")) * F.col("class_sum")) / F.lit(2.0 * t)))
    return joined.select("graph_id", F.round(p, 9).alias("p"))


def _chosen_sql(key: str) -> str:
    return mix_sql("graph_id", f"{key} * 64 + node_id", 21)


@query("tr08_chosen_nodes", f"{FIRED}, r AS (SELECT graph_id, clause, node_id, row_number() OVER (PARTITION BY graph_id, clause ORDER BY {_chosen_sql('clause')}, node_id) AS r FROM node_fired WHERE ways > 0), c AS (SELECT graph_id, CAST(range AS INTEGER) AS clause FROM graphs CROSS JOIN range({SPEC.clauses})) SELECT c.graph_id, c.clause, coalesce(node_id, -1) AS node_id FROM c LEFT JOIN r ON r.graph_id = c.graph_id AND r.clause = c.clause AND r = 1")
def tr08(spark, sf_dir):
    from ..functions.hashing import mix

    order = F.struct(mix(F.col("graph_id"), F.col("clause") * 64 + F.col("node_id"), 21).alias("h"), F.col("node_id").alias("n"))
    picked = _firing(spark, sf_dir).groupBy("graph_id", "clause").agg(F.min_by("node_id", order).alias("node_id"))
    every = derived.graphs(spark, sf_dir).select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(SPEC.clauses - 1))).alias("clause"))
    return every.join(picked, ["graph_id", "clause"], "left").select("graph_id", "clause", F.coalesce("node_id", F.lit(-1)).alias("node_id"))


#: A machine is trained by one task on so many rows at most, chosen by hash.
TRAINED_ROWS = 50_000


def _training_rows(spark, sf_dir):
    signs = F.transform(F.slice("embedding", 1, SPEC.features), lambda v: (v > 0).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("y"), signs.alias("bits"))
    return metrics.random_split(metrics.subsample(rows, "id", SEED, TRAINED_ROWS), "id", SEED, 0.8, 0.2).where("split <> 'test'")


@query("tr18_ensemble_history")
def tr18(spark, sf_dir):
    return training.train_ensemble(_training_rows(spark, sf_dir), SPEC, [42, 43, 44], 2).drop("state")


@query("tr21_distilled_states")
def tr21(spark, sf_dir):
    """The best epoch of each seed of machines that learn a teacher's hard labels, as tables of automata."""
    fixed, rows = _fixed(spark), _training_rows(spark, sf_dir)
    rows = fixed(rows.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), "id"))
    teacher = training.teacher_labels(training.fit_teacher(rows.where("split = 'train'")), rows.withColumnRenamed("id", "graph_id"))
    history = fixed(training.distill(rows.drop("vector"), teacher, SPEC, [42, 43, 44], 2))
    best = metrics.best_epoch(history.select("seed", "epoch", F.col("valid_auroc").alias("value")), ["seed"])
    return training.states_table(history.join(best.select("seed", "epoch"), ["seed", "epoch"], "left_semi"), SPEC)


@query("tr20_teacher_labels")
def tr20(spark, sf_dir):
    features = training.neighbour_sums(derived.nodes(spark, sf_dir), _near(spark, sf_dir), derived.ATOMS, 2).join(derived.graphs(spark, sf_dir), "graph_id")
    features = _fixed(spark)(features)  # read for the weights, the fit and the labels
    return training.teacher_labels(training.fit_teacher(features), features)


_sums = ", ".join(f"round(avg(CAST(atom_type = {i} AS INTEGER)), 9) AS a{i}" for i in range(derived.ATOMS))


@query("tr19_pooled_atoms", f"{BASE} SELECT graph_id, CAST(count(*) AS DOUBLE) AS size, {_sums} FROM nodes GROUP BY graph_id")
def tr19(spark, sf_dir):
    pooled = training.neighbour_sums(derived.nodes(spark, sf_dir), _near(spark, sf_dir), derived.ATOMS, 0)
    return pooled.select("graph_id", "size", *[F.round(F.col("vector")[i], 9).alias(f"a{i}") for i in range(derived.ATOMS)])


_layer = ", ".join(f"avg(ln(1 + own{i} + coalesce(near{i}, 0))) AS b{i}" for i in range(derived.ATOMS))


@query("tr19_one_layer", f"{BASE}, {machine.ADJACENCY_SQL}, s AS (SELECT a.graph_id, a.src AS node_id, {', '.join(f'sum(CAST(n.atom_type = {i} AS INTEGER)) AS near{i}' for i in range(derived.ATOMS))} FROM adjacent a JOIN nodes n ON n.graph_id = a.graph_id AND n.node_id = a.dst GROUP BY a.graph_id, a.src), o AS (SELECT graph_id, node_id, {', '.join(f'CAST(atom_type = {i} AS INTEGER) AS own{i}' for i in range(derived.ATOMS))} FROM nodes), p AS (SELECT o.graph_id, {_layer} FROM o LEFT JOIN s USING (graph_id, node_id) GROUP BY o.graph_id) SELECT graph_id, {', '.join(f'round(b{i}, 9) AS b{i}' for i in range(derived.ATOMS))} FROM p")
def tr19_layer(spark, sf_dir):
    """The part of the pooled vectors that the first layer gives: neighbours summed, log(1 + x), mean over the graph."""
    pooled = training.neighbour_sums(derived.nodes(spark, sf_dir), _near(spark, sf_dir), derived.ATOMS, 1)
    return pooled.select("graph_id", *[F.round(F.col("vector")[derived.ATOMS + i], 9).alias(f"b{i}") for i in range(derived.ATOMS)])


#: Fingerprints as the reference's forest reads them.
RADIUS, PLACES = 2, 2048


@query("enc22_fingerprints")
def enc22(spark, sf_dir):
    return encoding.circular_fingerprints(derived.nodes(spark, sf_dir), _near(spark, sf_dir), RADIUS, PLACES).select("graph_id", F.size("bits").alias("n"), F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("bits"))


@query("tr23_forest_labels")
def tr23(spark, sf_dir):
    prints = encoding.circular_fingerprints(derived.nodes(spark, sf_dir), _near(spark, sf_dir), RADIUS, PLACES).join(derived.graphs(spark, sf_dir), "graph_id")
    prints = _fixed(spark)(prints)  # read for the fit, which goes over it several times, and the labels
    model = training.fit_forest(prints, PLACES)
    return training.teacher_labels(model, training.sparse(prints, PLACES))


# Molecules

#: A molecule for each part: an alcohol, a substituted cyclohexane or benzene, an amine, or text that is no molecule.
_KINDS = ["C{c}O", "C1CCCCC1{c}", "c1ccccc1{c}", "NC{c}", "C{c}("]
_PART = """part_molecules AS (SELECT p_partkey AS id, p_partkey % 5 AS kind, p_size AS n FROM part),
    m AS (SELECT id, kind, n, kind < 4 AS ok,
        CASE kind WHEN 0 THEN n + 2 WHEN 1 THEN n + 6 WHEN 2 THEN n + 6 WHEN 3 THEN n + 2 ELSE 0 END AS atoms,
        CASE kind WHEN 0 THEN n + 1 WHEN 1 THEN n + 6 WHEN 2 THEN n + 6 WHEN 3 THEN n + 1 ELSE 0 END AS bonds,
        CASE kind WHEN 0 THEN (n + 1) * 12.011::DOUBLE + 15.999 + (2 * n + 4) * 1.008 WHEN 1 THEN (n + 6) * 12.011::DOUBLE + (2 * n + 12) * 1.008
            WHEN 2 THEN (n + 6) * 12.011::DOUBLE + (2 * n + 6) * 1.008 WHEN 3 THEN (n + 1) * 12.011::DOUBLE + 14.007 + (2 * n + 5) * 1.008 ELSE 0 END AS mw,
        CASE WHEN kind IN (0, 3) THEN 1 ELSE 0 END AS polar FROM part_molecules)"""


def _parts(spark, sf_dir, compute):
    """id of every part, and what `compute` tells of its molecule."""
    carbons = F.expr("repeat('C', p_size)")
    text = F.element_at(F.array(*[F.concat(F.lit(k.split("{c}")[0]), carbons, F.lit(k.split("{c}")[1])) for k in _KINDS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return chemistry.of_texts(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("smiles")), "id", "smiles", compute)


@query("src07_molecules", f"WITH {_PART} SELECT id, ok, CAST(atoms AS INTEGER) AS atoms, CAST(bonds AS INTEGER) AS bonds FROM m")
def src07(spark, sf_dir):
    return _parts(spark, sf_dir, lambda parsed: parsed.select("text", "ok", F.size("atoms").alias("atoms"), F.size("bonds").alias("bonds")))


@query("rc10_rule_of_five", f"WITH {_PART} SELECT id, round(mw, 3) AS mw, CAST(polar AS INTEGER) AS hba, CAST(polar AS INTEGER) AS hbd, mw < 500 AS lipinski_ok FROM m")
def rc10(spark, sf_dir):
    return _parts(spark, sf_dir, lambda parsed: chemistry.properties(parsed, ["text"]).select("text", F.round("mw", 3).alias("mw"), "hba", "hbd", "lipinski_ok"))


@query("rc12_validity", f"WITH {_PART} SELECT id, ok AND mw < 500 AS overall_ok, CASE WHEN NOT ok THEN 'incomplete' WHEN mw < 500 THEN 'sascore_unavailable' ELSE 'lipinski_fail' END AS notes FROM m")
def rc12(spark, sf_dir):
    return _parts(spark, sf_dir, lambda parsed: chemistry.validity(parsed, ["text"]).select("text", "overall_ok", "notes"))


@query("sp01_scaffolds", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 'cyclohexane' WHEN 2 THEN 'benzene' WHEN 4 THEN NULL ELSE 'none' END AS core FROM part")
def sp01(spark, sf_dir):
    """Each molecule's core by its key; text that is no molecule has none (null)."""
    key = lambda smiles: F.lit(chemistry.scaffold(*chemistry.parse(smiles)))
    core = F.when(~F.col("ok"), None).when(F.col("scaffold") == key("C1CCCCC1"), "cyclohexane").when(F.col("scaffold") == key("c1ccccc1"), "benzene").when(F.col("scaffold") == "", "none").otherwise("other")
    return _parts(spark, sf_dir, lambda parsed: parsed.select("text", core.alias("core")))


@query("fn_run_tags", "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d_%H%M%S') AS tag, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def fn_run_tags(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", writers.tag_of(day).alias("tag"), F.year(day).alias("y"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("days"))


# Sources and sinks

_LABEL = "CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN 'n/a' WHEN p_size % 7 = 2 THEN ' 1.0 ' ELSE CAST(p_size % 2 AS VARCHAR) END"


@query("src03_tolerant_table", f"SELECT p_name AS smiles, CAST(TRY_CAST(TRY_CAST(nullif(trim({_LABEL}), '') AS DOUBLE) AS INTEGER) AS INTEGER) AS y FROM part WHERE TRY_CAST(nullif(trim({_LABEL}), '') AS DOUBLE) IS NOT NULL AND nullif(trim(p_name), '') IS NOT NULL")
def src03(spark, sf_dir):
    label = F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 7 == 1, "n/a").when(F.col("p_size") % 7 == 2, " 1.0 ").otherwise((F.col("p_size") % 2).cast("string"))
    return readers.labelled(read(spark, sf_dir, "part").select(F.col("p_name").alias("Drug"), label.alias("Y")))


@query("src05_assay_task", "SELECT p_name AS smiles, p_size % 2 AS y FROM part WHERE p_size % 5 > 1")
def src05(spark, sf_dir):
    value = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "NaN").otherwise((F.col("p_size") % 2).cast("string"))
    return readers.assay(read(spark, sf_dir, "part").select(F.col("p_name").alias("smiles"), value.alias("SR-p53")), "SR-p53")


_SYMBOLS = "['C', 'n', 'N', 'Xx', 'O', 'Cl']"


@query("src09_codes", f"SELECT p_partkey, CAST(CASE {_SYMBOLS}[p_size % 6 + 1] WHEN 'C' THEN 0 WHEN 'N' THEN 1 WHEN 'O' THEN 2 WHEN 'Cl' THEN 5 ELSE 8 END AS INTEGER) AS atom, CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS bond FROM part")
def src09(spark, sf_dir):
    symbol = F.element_at(F.array(*[F.lit(s) for s in ("C", "n", "N", "Xx", "O", "Cl")]), F.col("p_size") % 6 + 1)
    bond = F.element_at(F.array(*[F.lit(s) for s in ("SINGLE", "double", "3", "12")]), F.col("p_size") % 4 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", encoding.atom_code(symbol).alias("atom"), encoding.bond_code(bond).alias("bond"))


@query("src10_boolean_text", "SELECT vec_id, CAST(list_sum(list_transform(range(1, 13), lambda i: CAST(embedding[i] > 0 AS INTEGER))) AS BIGINT) AS ones, label AS y FROM embeddings")
def src10(spark, sf_dir):
    signs = F.array_join(F.transform(F.slice("embedding", 1, 12), lambda v: (v > 0).cast("int").cast("string")), " ")
    lines = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(signs, F.lit("  "), F.col("label").cast("string")).alias("value"))
    # The reader works on lines alone; the id is joined on again as the line's first number.
    parsed = readers.boolean_text(lines.select(F.concat(F.col("vec_id").cast("string"), F.lit(" "), F.col("value")).alias("value")))
    return parsed.select(F.col("x")[0].cast("long").alias("vec_id"), F.aggregate(F.slice("x", 2, 12), F.lit(0).cast("long"), lambda a, v: a + v).alias("ones"), "y")


@query("src12_signature", f"""{BASE}, h AS (SELECT sha256('{{"graph_id":' || graph_id || ',"u":' || u || ',"v":' || v || ',"bond_type":' || bond_type || '}}') AS h FROM bonds) SELECT count(*) AS n, sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 12) AS BIGINT))) AS signature FROM h""")
def src12(spark, sf_dir):
    return readers.signature(derived.bonds(spark, sf_dir), ["graph_id", "u", "v", "bond_type"])


def _coin_sql(i: str) -> str:
    return f"(({mix_sql('id', i, SEED)} // 8) % 2)"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id")


@query("src13_noisy_xor", f"WITH r AS (SELECT event_id AS id FROM events), c AS (SELECT id, CAST({_coin_sql('0')} AS INTEGER) AS x1, CAST({_coin_sql('1')} AS INTEGER) AS x2, {mix_sql('id', '2', SEED)} < {int(0.2 * 2147483647)} AS noise FROM r) SELECT id, x1, x2, CASE WHEN noise THEN CAST(x1 = x2 AS INTEGER) ELSE CAST(x1 <> x2 AS INTEGER) END AS y FROM c")
def src13_xor(spark, sf_dir):
    return readers.noisy_xor(spark, _events(spark, sf_dir), 0.2, SEED)


@query("src13_noisy_parity", f"WITH b AS (SELECT id, CAST(i AS INTEGER) AS i, {_coin_sql('i')} AS v FROM (SELECT event_id AS id FROM events) CROSS JOIN range(12) t(i)), p AS (SELECT id, sum(CASE WHEN i % 3 < 2 THEN v ELSE 0 END) % 2 AS clean, CAST(sum(v) AS BIGINT) AS ones, {mix_sql('id', '12', SEED)} < {int(0.2 * 2147483647)} AS noise FROM b GROUP BY id) SELECT id, ones, CAST(CASE WHEN noise THEN 1 - clean ELSE clean END AS INTEGER) AS y FROM p")
def src13_parity(spark, sf_dir):
    rows = readers.noisy_parity(spark, _events(spark, sf_dir), 12, 4, 0.2, SEED)
    return rows.select("id", F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("ones"), "y")


@query("src13_addition", f"WITH p AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM range(6) x(a) CROSS JOIN range(6) y(b) WHERE NOT (a = 3 AND b = 1)), r AS (SELECT event_id AS id FROM events) SELECT id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(a + b AS INTEGER) AS y FROM r JOIN p ON k = {mix_sql('id', '0', SEED)} % 35")
def src13_addition(spark, sf_dir):
    return readers.addition(spark, _events(spark, sf_dir), 6, SEED, (3, 1)).select("id", "a", "b", "y")


@query("snk07_node_text", f"{BASE}, {machine.ADJACENCY_SQL}, e AS (SELECT graph_id, src AS node_id, string_agg(CAST(dst AS VARCHAR) || ':' || CAST(bond_type AS VARCHAR), ' ' ORDER BY dst, bond_type) AS near FROM adjacent GROUP BY graph_id, src), l AS (SELECT n.graph_id, n.node_id, rtrim(CAST(n.node_id AS VARCHAR) || '(' || CAST(atom_type AS VARCHAR) || ') ' || coalesce(near, '')) AS line FROM nodes n LEFT JOIN e ON e.graph_id = n.graph_id AND e.node_id = n.node_id) SELECT graph_id, string_agg(line, chr(10) ORDER BY node_id) AS text FROM l GROUP BY graph_id")
def snk07(spark, sf_dir):
    return writers.node_text(derived.nodes(spark, sf_dir), _near(spark, sf_dir))


@query("snk08_scraped_curves", "SELECT CAST(l_linenumber AS INTEGER) AS seed, CAST(l_suppkey AS INTEGER) AS epoch, CAST(l_quantity AS DOUBLE) AS auroc FROM lineitem")
def snk08(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.format_string("[run] seed=%d epoch=%d auroc=%s", F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity").cast("string")).alias("value"))
    return writers.curves(lines)


@query("snk09_case_studies", f"{FIRED}, f AS (SELECT graph_id, class_sum, class_sum > 0 AS flipped FROM summed), s AS (SELECT * FROM f ORDER BY graph_id LIMIT 80) SELECT graph_id, class_sum, flipped FROM s WHERE flipped ORDER BY graph_id LIMIT 3")
def snk09(spark, sf_dir):
    return writers.case_studies(machine.predictions(spark, sf_dir).select("graph_id", "class_sum", (F.col("pred") == 1).alias("flipped")))


@query("stream_scores", f"{FIRED} SELECT graph_id, class_sum, CAST(class_sum > 0 AS INTEGER) AS pred FROM summed")
def stream_scores(spark, sf_dir):
    """The plan that streams use, on a batch: a graph is a row, and its score needs no shuffle of its own."""
    hv = machine.vectors(spark, sf_dir, 1, SPEC.features)
    x, _ = clauses.literal_inputs(F.col("hv"), SPEC, "complement")
    rows = hv.groupBy("graph_id").agg(F.collect_list(x).alias("nodes"))
    return scoring.score_stream(rows, clauses.model(machine.automata(spark), SPEC, INCLUDE), SPEC)


@query("smoke_run")
def smoke_run(spark, sf_dir):
    return smoke.run(spark, sf_dir)
