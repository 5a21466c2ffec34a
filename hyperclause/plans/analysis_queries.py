"""Queries of splits, metrics, explanations, alerts and the flat message machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import mix, mix_sql
from ..operators import clauses, encoding, explain, messages, metrics
from . import derived, machine
from .core_queries import BASE, FIRED, _FLAT, _flat
from .derived import read
from .machine import SEED, SPEC
from .registry import query

# Splits and subsets


@query("flt01_small_graphs", f"{BASE} SELECT graph_id, count(*) AS n FROM nodes GROUP BY graph_id HAVING count(*) <= 5")
def flt01(spark, sf_dir):
    return derived.nodes(spark, sf_dir).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 5")


@query("flt02_truncated_nodes", f"{BASE} SELECT graph_id, node_id, atom_type FROM nodes WHERE node_id < 4")
def flt02(spark, sf_dir):
    return derived.nodes(spark, sf_dir).where("node_id < 4")


@query("flt02_truncated_edges", f"{BASE}, {machine.ADJACENCY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY edge_id, src) AS r FROM adjacent WHERE src < 4 AND dst < 4) SELECT graph_id, src, dst, bond_type FROM r WHERE r <= 5")
def flt02_edges(spark, sf_dir):
    near = encoding.adjacency(derived.bonds(spark, sf_dir))
    return messages.truncated(derived.nodes(spark, sf_dir), near, 4, 5)[1].select("graph_id", "src", "dst", "bond_type")


@query("flt03_split_subset", f"{BASE}, r AS (SELECT graph_id, y, row_number() OVER (ORDER BY {mix_sql('graph_id', '1', SEED)}, graph_id) AS r, count(*) OVER () AS n FROM graphs) SELECT r.graph_id, y FROM r WHERE r > floor(n * 0.8) AND r <= floor(n * 0.8) + floor(n * 0.1)")
def flt03(spark, sf_dir):
    return metrics.random_split(derived.graphs(spark, sf_dir), "graph_id", SEED, 0.8, 0.1).where("split = 'valid'").select("graph_id", "y")


@query("flt04_predicted_positives", f"{FIRED} SELECT graph_id, class_sum FROM summed WHERE class_sum > 0 ORDER BY graph_id LIMIT 200")
def flt04(spark, sf_dir):
    return machine.predictions(spark, sf_dir).where("pred = 1").orderBy("graph_id").limit(200).select("graph_id", "class_sum")


@query("flt05_has_heteroatom", f"{BASE} SELECT graph_id, y FROM graphs WHERE graph_id IN (SELECT graph_id FROM nodes WHERE atom_type IN (1, 2, 3))")
def flt05(spark, sf_dir):
    hetero = derived.nodes(spark, sf_dir).where(F.col("atom_type").isin(1, 2, 3)).select("graph_id")
    return derived.graphs(spark, sf_dir).join(hetero, "graph_id", "left_semi")


@query("flt07_graph_subset", f"{BASE}, p AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS position, count(*) OVER () AS n FROM graphs), w(place, i) AS (VALUES (0, 5), (1, -1), (2, 0), (3, -7)) SELECT place AS new_position, graph_id FROM w JOIN p ON position = CASE WHEN i < 0 THEN n + i ELSE i END")
def flt07(spark, sf_dir):
    counted = messages.offsets(derived.graphs(spark, sf_dir).select("graph_id")).select("graph_id", F.col("first").alias("position"))
    ids = spark.createDataFrame([(0, 5), (1, -1), (2, 0), (3, -7)], "place int, index int")
    return messages.subset(counted, ids).select("new_position", "graph_id")


@query("flt08_subsample", f"{BASE} SELECT graph_id, y FROM graphs ORDER BY {mix_sql('graph_id', '1', SEED)}, graph_id LIMIT 500")
def flt08(spark, sf_dir):
    return metrics.subsample(derived.graphs(spark, sf_dir), "graph_id", SEED, 500)


@query("flt10_markers", "SELECT event_id, regexp_extract(event_type || '=' || CAST(user_id AS VARCHAR), '^([A-Za-z_]+)=(.*)$', 1) AS name, regexp_extract(event_type || '=' || CAST(user_id AS VARCHAR), '^([A-Za-z_]+)=(.*)$', 2) AS value FROM events")
def flt10(spark, sf_dir):
    line = F.concat(F.col("event_type"), F.lit("="), F.col("user_id").cast("string"))
    pattern = r"^([A-Za-z_]+)=(.*)$"
    return read(spark, sf_dir, "events").select("event_id", F.regexp_extract(line, pattern, 1).alias("name"), F.regexp_extract(line, pattern, 2).alias("value"))


_tie = mix_sql("ascii(g) * 256 + ascii(right(g, 1))", "length(g)", SEED)


@query(
    "sp02_group_split",
    f"""WITH RECURSIVE s AS (SELECT p_brand AS g, count(*) AS n FROM part GROUP BY p_brand),
    o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, {_tie}, g) AS r, CAST(floor(sum(n) OVER () * 0.8) AS BIGINT) AS a, CAST(floor(sum(n) OVER () * 0.1) AS BIGINT) AS b FROM s),
    fill AS (
        SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, '' AS g, '' AS split
        UNION ALL
        SELECT o.r, CASE WHEN x + n <= a THEN x + n ELSE x END, CASE WHEN x + n > a AND y + n <= b THEN y + n ELSE y END, o.g,
               CASE WHEN x + n <= a THEN 'train' WHEN y + n <= b THEN 'valid' ELSE 'test' END
        FROM fill JOIN o ON o.r = fill.r + 1)
    SELECT g AS p_brand, split FROM fill WHERE r > 0""",
)
def sp02(spark, sf_dir):
    return metrics.group_split(read(spark, sf_dir, "part"), "p_brand", SEED, 0.8, 0.1)


@query("sp03_random_split", f"{BASE}, r AS (SELECT graph_id, row_number() OVER (ORDER BY {mix_sql('graph_id', '1', SEED)}, graph_id) AS r, count(*) OVER () AS n FROM graphs) SELECT graph_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r")
def sp03(spark, sf_dir):
    return metrics.random_split(derived.graphs(spark, sf_dir), "graph_id", SEED, 0.8, 0.1).select("graph_id", "split")


@query(
    "sp04_stratified_holdout",
    f"""{BASE}, q AS (SELECT greatest(1, round_even(count(*) * 0.15, 0)) AS want, round_even(count(*) FILTER (WHERE y = 1) * 0.15, 0) AS p FROM graphs),
    r AS (SELECT graph_id, y, row_number() OVER (PARTITION BY y ORDER BY {mix_sql('graph_id', '1', SEED)}, graph_id) AS r FROM graphs)
    SELECT graph_id, y, CAST(r <= CASE WHEN y = 1 THEN least(p, want) ELSE greatest(0, want - p) END AS INTEGER) AS held FROM r CROSS JOIN q""",
)
def sp04(spark, sf_dir):
    return metrics.stratified_holdout(derived.graphs(spark, sf_dir), "graph_id", "y", 0.15, SEED).select("graph_id", "y", "held")


@query("sp05_inverse_frequency", f"{BASE} SELECT graph_id, y, round(1.0 / count(*) OVER (PARTITION BY y), 9) AS weight FROM graphs")
def sp05(spark, sf_dir):
    return metrics.inverse_frequency(derived.graphs(spark, sf_dir), "y").select("graph_id", "y", F.round("weight", 9).alias("weight"))


# Metrics


@query("agg01_class_balance", f"{BASE} SELECT count(*) AS total, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, (SELECT max(node_id) + 1 FROM nodes) AS largest FROM graphs")
def agg01(spark, sf_dir):
    largest = derived.nodes(spark, sf_dir).agg((F.max("node_id") + 1).alias("largest"))
    return metrics.class_balance(derived.graphs(spark, sf_dir), "y").join(F.broadcast(largest), F.lit(True))


@query("agg02_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def agg02(spark, sf_dir):
    return metrics.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


ALERTS = {"the": r"\bthe\b", "licence": "(?i)licen[cs]e", "shout": "!!", "german": "ung", "table": r" \| "}
_HITS = "hits AS (" + " UNION ALL ".join(f"SELECT doc_id AS item, '{name}' AS alert FROM documents WHERE regexp_matches(text, '{p}')" for name, p in ALERTS.items()) + ")"
#: What fires on a document: hashed words of its labels and numbers.
_DOC_FIRED = f"fired AS (SELECT doc_id AS item, CAST(c AS INTEGER) AS clause FROM documents CROSS JOIN range(12) t(c) WHERE {mix_sql('doc_id', 'c', 3)} % 3 = 0)"


def _hits(spark, sf_dir):
    return explain.alerts_in(read(spark, sf_dir, "documents"), "doc_id", "text", ALERTS)


@query("jn04_alert_hits", f"WITH {_HITS} SELECT item, alert FROM hits")
def jn04(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("agg03_alert_support", f"WITH {_HITS} SELECT alert, count(*) AS support FROM hits GROUP BY alert")
def agg03(spark, sf_dir):
    return explain.alert_support(_hits(spark, sf_dir))


@query(
    "agg04_alert_coverage",
    f"""WITH {_HITS}, {_DOC_FIRED}, s AS (SELECT alert, count(*) AS support FROM hits GROUP BY alert),
    t AS (SELECT alert, clause, count(*) AS together FROM hits JOIN fired USING (item) GROUP BY alert, clause),
    r AS (SELECT alert, clause, together, support, row_number() OVER (PARTITION BY alert ORDER BY clause) AS r FROM t JOIN s USING (alert) WHERE together >= greatest(1, floor(support * 0.3)))
    SELECT alert, clause, together, support FROM r WHERE r <= 5""",
)
def agg04(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("clause"))
    fired = docs.where(mix(F.col("item"), F.col("clause"), 3) % 3 == 0)
    return explain.alert_coverage(_hits(spark, sf_dir), fired, share=0.3)


@query("agg05_top_edits", "SELECT event_type, user_id % 13 AS place, count(*) AS n FROM events GROUP BY event_type, user_id % 13 ORDER BY n DESC, event_type, place LIMIT 10")
def agg05(spark, sf_dir):
    return metrics.top_counts(read(spark, sf_dir, "events").withColumn("place", F.col("user_id") % 13), ["event_type", "place"], 10)


@query("agg06_accuracy", f"{FIRED} SELECT round(avg(CAST((class_sum > 0) = (y = 1) AS INTEGER)), 9) AS accuracy FROM summed JOIN graphs USING (graph_id)")
def agg06(spark, sf_dir):
    scored = machine.predictions(spark, sf_dir).join(derived.graphs(spark, sf_dir), "graph_id")
    return metrics.accuracy(scored, "y", "pred").select(F.round("accuracy", 9).alias("accuracy"))


_AUROC = """ranked AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)),
    sums AS (SELECT lang, sum(CASE WHEN toxic = 1 THEN r ELSE 0 END) AS s, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS n FROM ranked GROUP BY lang)"""


def _labelled(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")


@query("agg07_auroc", f"WITH {_AUROC} SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (p * n) ELSE 0.5 END, 9) AS auroc FROM sums")
def agg07(spark, sf_dir):
    return metrics.auroc(_labelled(spark, sf_dir), ["lang"], "toxic", "n_chars").select("lang", F.round("auroc", 9).alias("auroc"))


@query("agg08_auroc_pairs", "WITH d AS (SELECT toxic, n_chars FROM documents JOIN labels USING (doc_id)) SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 9) AS auroc FROM d a JOIN d b ON a.toxic = 1 AND b.toxic = 0")
def agg08(spark, sf_dir):
    return metrics.auroc(_labelled(spark, sf_dir), [], "toxic", "n_chars", float("nan")).select(F.round("auroc", 9).alias("auroc"))


@query("agg09_margins", f"{FIRED} SELECT graph_id, class_sum AS margin FROM summed")
def agg09(spark, sf_dir):
    return metrics.margins(clauses.class_scores(machine.graph_fired(spark, sf_dir), SPEC), 1)


_MEMBERS = f"members AS (SELECT CAST(s AS INTEGER) AS seed, doc_id AS graph_id, {mix_sql('doc_id', 's', 5)} % 201 - 100 AS margin FROM documents CROSS JOIN range(42, 47) t(s))"


@query(
    "agg10_ensemble",
    f"WITH {_MEMBERS} SELECT graph_id, CAST(sum(margin) AS BIGINT) AS soft, CAST(sum(margin) > 0 AS INTEGER) AS soft_pred, count(*) FILTER (WHERE margin > 0) AS votes, CAST(2 * count(*) FILTER (WHERE margin > 0) > count(*) AS INTEGER) AS hard_pred FROM members GROUP BY graph_id",
)
def agg10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("graph_id"), F.explode(F.sequence(F.lit(42), F.lit(46))).alias("seed"))
    return metrics.ensemble(docs.withColumn("margin", mix(F.col("graph_id"), F.col("seed"), 5) % 201 - 100))


_points = ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (50, 90, 95, 99))


@query("agg11_percentiles", f"SELECT event_type, {_points}, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY event_type")
def agg11(spark, sf_dir):
    found = metrics.percentiles(read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("agg12_success_rate", "SELECT lang, count(*) FILTER (WHERE quality = 1) AS successes, count(*) AS total, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def agg12(spark, sf_dir):
    return metrics.rate(_labelled(spark, sf_dir), ["lang"], F.col("quality") == 1).withColumn("rate", F.round("rate", 9))


@query("agg13_spread", f"WITH {_MEMBERS}, m AS (SELECT seed, avg(margin) AS v FROM members GROUP BY seed) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd_sample, round(stddev_pop(v), 6) AS sd_population FROM m")
def agg13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(42), F.lit(46))).alias("seed"))
    means = docs.groupBy("seed").agg(F.avg(mix(F.col("doc_id"), F.col("seed"), 5) % 201 - 100).alias("v"))
    found = metrics.spread(means, [], "v")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("agg14_merged_artefacts", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def agg14(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("phase"))
    return metrics.merged(rows)


@query("agg15_fidelity", "WITH t AS (SELECT CAST(n_chars > 1500 AS INTEGER) AS student, quality AS teacher FROM documents JOIN labels USING (doc_id)) SELECT round(avg(CAST(student = teacher AS INTEGER)), 9) AS accuracy FROM t")
def agg15(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("student", (F.col("n_chars") > 1500).cast("int"))
    return metrics.accuracy(rows, "quality", "student").select(F.round("accuracy", 9).alias("accuracy"))


@query("jn11_metrics_by_seed", f"WITH {_MEMBERS}, d AS (SELECT seed, avg(margin) AS v FROM members JOIN documents ON doc_id = graph_id WHERE lang = 'en' GROUP BY seed), t AS (SELECT seed, avg(margin) AS v FROM members JOIN documents ON doc_id = graph_id WHERE lang <> 'en' GROUP BY seed) SELECT seed, round(t.v - d.v, 6) AS gain FROM d JOIN t USING (seed)")
def jn11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.sequence(F.lit(42), F.lit(46))).alias("seed")).withColumn("margin", mix(F.col("doc_id"), F.col("seed"), 5) % 201 - 100)
    means = lambda arm, name: docs.where(arm).groupBy("seed").agg(F.avg("margin").alias(name))
    return means("lang = 'en'", "d").join(means("lang <> 'en'", "t"), "seed").select("seed", F.round(F.col("t") - F.col("d"), 6).alias("gain"))


@query("tr17_best_epoch", f"WITH h AS (SELECT CAST(c_mktsegment AS VARCHAR) AS seed, c_custkey AS epoch, c_custkey * 7919 % 101 AS value FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY value DESC, epoch) AS r FROM h) SELECT seed, epoch, value FROM r WHERE r = 1")
def tr17(spark, sf_dir):
    history = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seed"), F.col("c_custkey").alias("epoch"), (F.col("c_custkey") * 7919 % 101).alias("value"))
    return metrics.best_epoch(history, ["seed"])


@query("win_prefix_offsets", f"{BASE}, c AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY graph_id) SELECT graph_id, n, CAST(coalesce(sum(n) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM c")
def win_offsets(spark, sf_dir):
    return messages.offsets(derived.nodes(spark, sf_dir))


@query("set_union_splits", f"{BASE} SELECT graph_id FROM graphs WHERE y = 1 UNION ALL SELECT graph_id FROM graphs WHERE y = 0")
def set_union(spark, sf_dir):
    g = derived.graphs(spark, sf_dir)
    return g.where("y = 1").select("graph_id").unionAll(g.where("y = 0").select("graph_id"))


@query("set_intersect_disjoint", f"{BASE} SELECT graph_id FROM graphs WHERE y = 1 INTERSECT SELECT graph_id FROM nodes WHERE atom_type = 0")
def set_intersect(spark, sf_dir):
    positive = derived.graphs(spark, sf_dir).where("y = 1").select("graph_id")
    return positive.intersect(derived.nodes(spark, sf_dir).where("atom_type = 0").select("graph_id"))


@query("set_except_chosen", f"{BASE} SELECT graph_id FROM graphs EXCEPT SELECT graph_id FROM nodes WHERE atom_type = 0")
def set_except(spark, sf_dir):
    return derived.graphs(spark, sf_dir).select("graph_id").exceptAll(derived.nodes(spark, sf_dir).where("atom_type = 0").select("graph_id").distinct()).distinct()


# Explanations


@query("exp02_contributions", f"{_FLAT}, v AS (SELECT vec_id, clause, CASE WHEN clause % 2 = 0 THEN ways ELSE -ways END AS contribution FROM tree WHERE ways <> 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY abs(contribution) DESC, clause) AS INTEGER) AS rank FROM v) SELECT vec_id, clause, CAST(contribution AS BIGINT) AS contribution, rank FROM r WHERE rank <= 3")
def exp02(spark, sf_dir):
    return explain.contributions(_flat(spark, sf_dir), "vec_id", 3)


@query("exp02_decisions", f"{_FLAT} SELECT vec_id, CAST(sign(sum(CASE WHEN clause % 2 = 0 THEN ways ELSE -ways END)) AS INTEGER) AS decision FROM tree GROUP BY vec_id")
def exp02_decisions(spark, sf_dir):
    return explain.decisions(_flat(spark, sf_dir), "vec_id")


@query("exp03_firing_clauses", f"{FIRED} SELECT graph_id, clause, clause % 2 AS voted_class, CASE WHEN clause % 2 = 0 THEN 1 ELSE -1 END AS sign, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS node_ids, count(*) AS clause_output FROM node_fired WHERE ways > 0 GROUP BY graph_id, clause")
def exp03(spark, sf_dir):
    rows = machine.fired(spark, sf_dir).select("graph_id", "node_id", F.posexplode_outer(bits.unpack(F.col("fired"), SPEC.clauses)).alias("clause", "output"))
    return explain.firing_clauses(rows, SPEC.classes).withColumn("node_ids", F.array_join(F.transform("node_ids", lambda n: n.cast("string")), ","))


def _tree_sql(empty: bool) -> str:
    """The nested lists of literal texts, as JSON text."""
    text = f"'\"' || CASE WHEN n >= {SPEC.leaf_and} THEN '~' ELSE '' END || 'X' || CAST(feature AS VARCHAR) || '=1\"'"
    levels = [f"t0 AS (SELECT clause, j, k, l, m, '[' || coalesce(string_agg({text}, ',' ORDER BY n) FILTER (WHERE state > {machine.INCLUDE}), '') || ']' AS t FROM ta GROUP BY clause, j, k, l, m)"]
    for i, (above, own) in enumerate((("clause, j, k, l", "m"), ("clause, j, k", "l"), ("clause, j", "k"), ("clause", "j"))):
        levels.append(f"t{i + 1} AS (SELECT {above}, '[' || string_agg(t, ',' ORDER BY {own}) || ']' AS t FROM t{i} {'' if empty or i else "WHERE t <> '[]'"} GROUP BY {above})")
    return f"WITH {machine.TABLE_AUTOMATA_SQL}, {', '.join(levels)} SELECT clause, t AS tree FROM t4"


@query("exp04_clause_literals", _tree_sql(True))
def exp04(spark, sf_dir):
    return explain.clause_literals(machine.table_automata(spark, sf_dir), SPEC, machine.INCLUDE, empty=True).select("clause", F.to_json("tree").alias("tree"))


@query("exp01_clause_trees", _tree_sql(False))
def exp01(spark, sf_dir):
    return explain.clause_literals(machine.table_automata(spark, sf_dir), SPEC, machine.INCLUDE).select("clause", F.to_json("tree").alias("tree"))


@query("exp01_literals_flat", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT clause, j, k, l, m, string_agg(CASE WHEN n >= {SPEC.leaf_and} THEN '~' ELSE '' END || 'X' || CAST(feature AS VARCHAR) || '=1', ' ' ORDER BY n) AS leaf FROM ta WHERE state > {machine.INCLUDE} GROUP BY clause, j, k, l, m")
def exp01_flat(spark, sf_dir):
    rows = clauses.included(machine.table_automata(spark, sf_dir), machine.INCLUDE).withColumn("text", explain.literal_text(F.col("feature"), F.col("n") >= SPEC.leaf_and))
    grouped = rows.groupBy("clause", "j", "k", "l", "m").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("texts"))
    return grouped.select("clause", "j", "k", "l", "m", F.array_join(F.transform("texts", lambda s: s["text"]), " ").alias("leaf"))


@query("exp06_parsed_literals", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT DISTINCT feature, CAST(n < {SPEC.leaf_and} AS INTEGER) AS polarity FROM ta")
def exp06(spark, sf_dir):
    texts = machine.table_automata(spark, sf_dir).select(explain.literal_text(F.col("feature"), F.col("n") >= SPEC.leaf_and).alias("text")).distinct()
    return texts.select(explain.parse_literal(F.col("text")).alias("p")).select("p.feature", "p.polarity")


@query("exp07_fired_leaves", f"{_FLAT} SELECT vec_id, clause, j, k, l, m, CAST((pos & ({(1 << SPEC.features) - 1} - x)) = 0 AND (neg & x) = 0 AS INTEGER) AS fired FROM input CROSS JOIN leaf WHERE pos > 0 OR neg > 0")
def exp07(spark, sf_dir):
    signs = F.transform(F.slice("embedding", 1, SPEC.features), lambda v: (v > 0).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", bits.pack(signs).getItem(0).alias("x"))
    return explain.fired_leaves(rows, machine.automata(spark), SPEC, machine.INCLUDE).select("vec_id", "clause", "j", "k", "l", "m", "fired")


# The flat message machine: size places of symbols, a message layer, two edge directions

SIZE, MESSAGES, HOT, CLAUSES = 32, 32, 2, 10
_place = lambda key, i, seed: f"({mix_sql(key, '0', seed)} % 32 + {i} * (({mix_sql(key, '1', seed)} % 16) * 2 + 1)) % 32"
_FLAT_MACHINE = f"""{BASE}, {machine.ADJACENCY_SQL},
    own AS (SELECT DISTINCT graph_id, node_id, {_place("atom_type", "i", SEED)} AS place FROM nodes CROSS JOIN range({HOT}) t(i)),
    own_all AS (SELECT graph_id, node_id, place FROM own UNION ALL
        SELECT n.graph_id, n.node_id, p.range + {SIZE} FROM nodes n CROSS JOIN range({SIZE}) p LEFT JOIN own o ON o.graph_id = n.graph_id AND o.node_id = n.node_id AND o.place = p.range WHERE o.place IS NULL),
    inc0 AS (SELECT CAST(c AS INTEGER) AS clause, p AS place FROM range({CLAUSES}) a(c) CROSS JOIN range({2 * SIZE}) b(p) WHERE c > 0 AND {mix_sql("c", "p", 11)} % 1000 < CASE WHEN p < {SIZE} THEN 20 ELSE 40 END),
    inc1 AS (SELECT CAST(c AS INTEGER) AS clause, p AS place FROM range({CLAUSES}) a(c) CROSS JOIN range({2 * MESSAGES}) b(p) WHERE c > 1 AND {mix_sql("c", "p", 12)} % 1000 < CASE WHEN p < {MESSAGES} THEN 10 ELSE 40 END),
    need0 AS (SELECT CAST(c AS INTEGER) AS clause, count(place) AS need FROM range({CLAUSES}) a(c) LEFT JOIN inc0 ON inc0.clause = c GROUP BY c),
    need1 AS (SELECT CAST(c AS INTEGER) AS clause, count(place) AS need FROM range({CLAUSES}) a(c) LEFT JOIN inc1 ON inc1.clause = c GROUP BY c),
    met0 AS (SELECT n.graph_id, n.node_id, need0.clause, need, count(o.place) AS met FROM nodes n CROSS JOIN need0 LEFT JOIN inc0 ON inc0.clause = need0.clause
        LEFT JOIN own_all o ON o.graph_id = n.graph_id AND o.node_id = n.node_id AND o.place = inc0.place GROUP BY n.graph_id, n.node_id, need0.clause, need),
    fired0 AS (SELECT graph_id, node_id, clause FROM met0 WHERE met = need),
    code AS (SELECT CAST(c AS INTEGER) AS clause, {mix_sql("c", "0", 13)} % {MESSAGES} AS code FROM range({CLAUSES}) t(c)),
    sent AS (SELECT DISTINCT a.graph_id, a.dst AS node_id, (code + bond_type) % {MESSAGES} AS place FROM fired0 f JOIN code USING (clause) JOIN adjacent a ON a.graph_id = f.graph_id AND a.src = f.node_id),
    sent_all AS (SELECT graph_id, node_id, place FROM sent UNION ALL
        SELECT n.graph_id, n.node_id, p.range + {MESSAGES} FROM nodes n CROSS JOIN range({MESSAGES}) p LEFT JOIN sent o ON o.graph_id = n.graph_id AND o.node_id = n.node_id AND o.place = p.range WHERE o.place IS NULL),
    met1 AS (SELECT n.graph_id, n.node_id, need1.clause, need, count(o.place) AS met FROM nodes n CROSS JOIN need1 LEFT JOIN inc1 ON inc1.clause = need1.clause
        LEFT JOIN sent_all o ON o.graph_id = n.graph_id AND o.node_id = n.node_id AND o.place = inc1.place GROUP BY n.graph_id, n.node_id, need1.clause, need),
    fired1 AS (SELECT graph_id, node_id, clause FROM met1 JOIN fired0 USING (graph_id, node_id, clause) WHERE met = need)"""


def _flat_machine(spark, sf_dir):
    nodes = derived.nodes(spark, sf_dir)
    vectors = nodes.withColumn("words", bits.places_words(bits.hot_places(F.col("atom_type"), HOT, SIZE, SEED), SIZE))
    every = spark.range(CLAUSES).select(F.col("id").cast("int").alias("clause"))

    def layer(size, first, seed, plain):
        p = F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))).alias("place")
        chance = F.when(F.col("place") < size, plain).otherwise(40)
        got = every.select("clause", p).where((F.col("clause") > first) & (mix(F.col("clause"), F.col("place"), seed) % 1000 < chance))
        return every.join(got, "clause", "left")

    codes = every.withColumn("code", mix(F.col("clause"), F.lit(0), 13) % MESSAGES)
    return vectors, encoding.adjacency(derived.bonds(spark, sf_dir)), [layer(SIZE, 0, 11, 20), layer(MESSAGES, 1, 12, 10)], codes


@query("cl13_flat_matches", f"{_FLAT_MACHINE} SELECT graph_id, node_id, clause FROM fired0")
def cl13(spark, sf_dir):
    vectors, _, includes, _ = _flat_machine(spark, sf_dir)
    return messages.matches(vectors, includes[0], SIZE)


@query("flt09_gated_matches", f"{_FLAT_MACHINE} SELECT graph_id, node_id, clause FROM fired0 JOIN nodes USING (graph_id, node_id) WHERE atom_type % 2 = clause % 2")
def flt09(spark, sf_dir):
    vectors, _, includes, _ = _flat_machine(spark, sf_dir)
    return messages.matches(vectors, includes[0], SIZE, F.col("atom_type") % 2 == F.col("clause") % 2)


@query("cl17_messages", f"{_FLAT_MACHINE} SELECT graph_id, node_id, CAST(place AS INTEGER) AS place FROM sent")
def cl17(spark, sf_dir):
    vectors, near, includes, codes = _flat_machine(spark, sf_dir)
    return messages.exchange(messages.gathered(vectors, near, includes[0], SIZE), codes, MESSAGES)


@query("cl18_packed_messages", f"{_FLAT_MACHINE} SELECT n.graph_id, n.node_id, CAST(coalesce(sum(CAST(1 AS BIGINT) << CAST(s.place AS INTEGER)), 0) AS BIGINT) AS word FROM nodes n LEFT JOIN sent s USING (graph_id, node_id) GROUP BY n.graph_id, n.node_id")
def cl18(spark, sf_dir):
    vectors, near, includes, codes = _flat_machine(spark, sf_dir)
    packed = messages.packed_inboxes(messages.gathered(vectors, near, includes[0], SIZE), codes, MESSAGES)
    return packed.select("graph_id", "node_id", F.col("words")[0].alias("word"))


@query("cl19_two_layers", f"{_FLAT_MACHINE} SELECT graph_id, node_id, clause FROM fired1")
def cl19(spark, sf_dir):
    vectors, near, includes, codes = _flat_machine(spark, sf_dir)
    return messages.layers(messages.gathered(vectors, near, includes[0], SIZE), includes[1:], codes, MESSAGES)


@query("cl21_graph_features", f"{_FLAT_MACHINE} SELECT g.graph_id, CAST(c AS INTEGER) AS clause, CAST(f.clause IS NOT NULL AS INTEGER) AS output FROM graphs g CROSS JOIN range({CLAUSES}) t(c) LEFT JOIN (SELECT DISTINCT graph_id, clause FROM fired0) f ON f.graph_id = g.graph_id AND f.clause = c")
def cl21(spark, sf_dir):
    vectors, _, includes, _ = _flat_machine(spark, sf_dir)
    return messages.to_features(messages.matches(vectors, includes[0], SIZE), derived.graphs(spark, sf_dir), CLAUSES)


@query("cl20_multi_output", f"{_FLAT_MACHINE}, s AS (SELECT graph_id, CAST(c AS INTEGER) AS class_id, sum({mix_sql('clause', 'c', 7)} % 21 - 10) AS score FROM (SELECT DISTINCT graph_id, clause FROM fired0) CROSS JOIN range(3) t(c) GROUP BY graph_id, c) SELECT graph_id, class_id, CAST(score >= 0 AS INTEGER) AS pred FROM s")
def cl20(spark, sf_dir):
    features = cl21(spark, sf_dir)
    weights = spark.range(CLAUSES).select(F.col("id").cast("int").alias("clause"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("class_id")).withColumn("weight", mix(F.col("clause"), F.col("class_id"), 7) % 21 - 10)
    return messages.multi_output(clauses.weighted_sums(features, weights))


def _part_includes_sql(size: int, seed: int) -> str:
    """A clause for each part, which includes up to four places."""
    return f"inc AS (SELECT DISTINCT CAST(p_partkey AS INTEGER) AS clause, {mix_sql('p_partkey', 'i + p_size * 8', seed)} % {2 * size} AS place FROM part CROSS JOIN range(4) t(i))"


def _part_includes(spark, sf_dir, size, seed):
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: mix(F.col("p_partkey"), i + F.col("p_size") * 8, seed) % (2 * size)))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("clause"), place.alias("place")).distinct()


@query("exp09_symbol_counts", f"WITH {_part_includes_sql(SIZE, 14)}, codes9 AS (SELECT DISTINCT CAST(s AS INTEGER) AS symbol, {_place('s', 'i', SEED)} AS place FROM range(9) a(s) CROSS JOIN range({HOT}) b(i)) SELECT clause, symbol, CAST(inc.place < {SIZE} AS INTEGER) AS polarity, count(*) AS n FROM inc JOIN codes9 ON codes9.place = inc.place % {SIZE} GROUP BY clause, symbol, inc.place < {SIZE}")
def exp09(spark, sf_dir):
    symbols = spark.range(9).select(F.col("id").cast("int").alias("symbol"), F.explode(bits.hot_bits(F.col("id"), HOT, SIZE, SEED)).alias("place")).distinct()
    return messages.symbol_counts(_part_includes(spark, sf_dir, SIZE, 14), symbols, SIZE)


@query("exp10_message_sources", f"WITH {_part_includes_sql(MESSAGES, 15)}, code AS (SELECT n_nationkey AS clause, {mix_sql('n_nationkey', '0', 13)} % {MESSAGES} AS code FROM nation) SELECT inc.clause, CAST(e AS INTEGER) AS edge_type, code.clause AS source, CAST(place < {MESSAGES} AS INTEGER) AS polarity, count(*) AS n FROM inc CROSS JOIN range(4) t(e) JOIN code ON code = (place % {MESSAGES} - e + {MESSAGES}) % {MESSAGES} GROUP BY inc.clause, e, code.clause, place < {MESSAGES}")
def exp10(spark, sf_dir):
    codes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("clause"), (mix(F.col("n_nationkey"), F.lit(0), 13) % MESSAGES).alias("code"))
    return messages.message_sources(_part_includes(spark, sf_dir, MESSAGES, 15), codes, 4, MESSAGES)


@query("src11_count_mismatches", f"{BASE}, d AS (SELECT graph_id, count(*) + CAST(graph_id % 5 = 0 AS INTEGER) AS nodes_declared, count(*) AS nodes_found FROM nodes GROUP BY graph_id), e AS (SELECT graph_id, count(*) AS n FROM bonds GROUP BY graph_id) SELECT graph_id, nodes_declared, coalesce(n, 0) AS edges_declared, nodes_found, coalesce(n, 0) AS edges_found FROM d LEFT JOIN e USING (graph_id) WHERE nodes_declared <> nodes_found")
def src11(spark, sf_dir):
    nodes, bonds = derived.nodes(spark, sf_dir), derived.bonds(spark, sf_dir)
    edges = bonds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges_declared"))
    declared = nodes.groupBy("graph_id").agg((F.count(F.lit(1)) + (F.col("graph_id") % 5 == 0).cast("int")).alias("nodes_declared"))
    return messages.reconciled(nodes, bonds, declared.join(edges, "graph_id", "left").fillna(0, ["edges_declared"]))


# Intermediate tables of the trees, and pairings


def _trace(spark, sf_dir):
    signs = F.transform(F.slice("embedding", 1, SPEC.features), lambda v: (v > 0).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", bits.pack(signs).getItem(0).alias("x"))
    return clauses.trace(rows, clauses.leaves(machine.automata(spark), SPEC, machine.INCLUDE))


@query("cl03_leaf_ors", f"{_FLAT} SELECT vec_id, clause, j, k, l, CAST(s AS BIGINT) AS v FROM hit")
def cl03(spark, sf_dir):
    return _trace(spark, sf_dir)[0].select("vec_id", "clause", "j", "k", "l", "v")


@query("cl04_inner_ands", f"{_FLAT} SELECT vec_id, clause, j, k, CAST(s AS BIGINT) AS v FROM conj")
def cl04(spark, sf_dir):
    return _trace(spark, sf_dir)[1].select("vec_id", "clause", "j", "k", "v")


@query("cl05_inner_ors", f"{_FLAT} SELECT vec_id, clause, j, CAST(s AS BIGINT) AS v FROM disj")
def cl05(spark, sf_dir):
    return _trace(spark, sf_dir)[2].select("vec_id", "clause", "j", "v")


@query("cl06_root_ands", f"{_FLAT} SELECT vec_id, clause, ways AS v FROM tree")
def cl06(spark, sf_dir):
    return _trace(spark, sf_dir)[3].select("vec_id", "clause", "v")


@query("jn01_literal_gather", f"WITH {machine.AUTOMATA_SQL} SELECT vec_id, clause, j, k, l, m, n, CAST(CASE WHEN n < {SPEC.leaf_and} THEN embedding[feature + 1] > 0 ELSE NOT embedding[feature + 1] > 0 END AS INTEGER) AS value FROM ta CROSS JOIN embeddings WHERE state > {machine.INCLUDE}")
def jn01(spark, sf_dir):
    literals = clauses.included(machine.automata(spark), machine.INCLUDE).select("clause", "j", "k", "l", "m", "n", "feature")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, SPEC.features)).alias("feature", "x"))
    positive = F.col("x") > 0
    value = F.when(F.col("n") < SPEC.leaf_and, positive).otherwise(~positive).cast("int")
    return rows.join(F.broadcast(literals), "feature").select("vec_id", "clause", "j", "k", "l", "m", "n", value.alias("value"))


@query("jn06_missing_bonds", f"{BASE} SELECT a.graph_id, a.node_id AS u, b.node_id AS v FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 2 WHERE NOT EXISTS (SELECT 1 FROM bonds x WHERE x.graph_id = a.graph_id AND x.u = a.node_id AND x.v = b.node_id)")
def jn06(spark, sf_dir):
    nodes, bonds = derived.nodes(spark, sf_dir), derived.bonds(spark, sf_dir)
    second = nodes.select("graph_id", (F.col("node_id") - 2).alias("u"), F.col("node_id").alias("v")).where("u >= 0")
    return second.join(bonds, ["graph_id", "u", "v"], "left_anti")


@query("exp05_firing_union", f"{FIRED} SELECT CAST(s AS INTEGER) AS member, graph_id, clause, count(*) AS clause_output FROM node_fired CROSS JOIN range(2) t(s) WHERE ways > s GROUP BY s, graph_id, clause")
def exp05(spark, sf_dir):
    """Two members: clauses that hold, and clauses that hold in more than one way; duplicates stay."""
    hv = machine.vectors(spark, sf_dir, 1, SPEC.features)
    x, nx = clauses.literal_inputs(F.col("hv"), SPEC, "complement")
    ways = F.transform("clauses", lambda c: clauses.multiplicity(c, F.col("x"), F.col("nx")))
    rows = clauses.by_input(hv.select("graph_id", x.alias("x"), nx.alias("nx")), clauses.model(machine.automata(spark), SPEC, machine.INCLUDE), SPEC, "complement", ways, "ways")
    return explain.firing_counts(rows, SPEC.clauses, 2)


@query("exp11_states_of_a_clause", f"WITH {machine.TABLE_AUTOMATA_SQL} SELECT j, k, l, m, n, state, CAST(state > {machine.INCLUDE} AS INTEGER) AS action FROM ta WHERE clause = 3")
def exp11(spark, sf_dir):
    return machine.table_automata(spark, sf_dir).where("clause = 3").select("j", "k", "l", "m", "n", "state", (F.col("state") > machine.INCLUDE).cast("int").alias("action"))


@query("enc15_pack_rows", "WITH b AS (SELECT vec_id, unnest(range(64)) AS bit, unnest(list_transform(embedding, lambda v: CAST(v > 0 AS BIGINT))) AS v FROM embeddings) SELECT vec_id, CAST(bit // 32 AS INTEGER) AS word, CAST(sum(v << (bit % 32)) AS BIGINT) AS bits FROM b GROUP BY vec_id, bit // 32")
def enc15(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda v: (v > 0).cast("int"))).alias("bit", "v"))
    return encoding.packed(rows, ["vec_id"], "bit", "v")


@query("enc18_complements", f"{BASE}, own AS (SELECT DISTINCT graph_id, node_id, {_place('atom_type', 'i', SEED)} AS place FROM nodes CROSS JOIN range({HOT}) t(i)) SELECT n.graph_id, n.node_id, CAST(count(DISTINCT o.place) AS BIGINT) AS plain, CAST({SIZE} - count(DISTINCT o.place) AS BIGINT) AS negated FROM nodes n LEFT JOIN own o ON o.graph_id = n.graph_id AND o.node_id = n.node_id GROUP BY n.graph_id, n.node_id")
def enc18(spark, sf_dir):
    count = lambda words: F.bit_count(words[0]).cast("long")  # noqa: E731  SIZE bits are one word
    return _flat_machine(spark, sf_dir)[0].select("graph_id", "node_id", count(F.col("words")).alias("plain"), count(bits.inverted(F.col("words"), SIZE)).alias("negated"))


@query("enc23_one_hot_features", f"{BASE} SELECT graph_id, node_id, CAST(CAST(1 AS BIGINT) << atom_type AS BIGINT) AS x FROM nodes")
def enc23(spark, sf_dir):
    features, _ = encoding.one_hot_features(derived.nodes(spark, sf_dir), encoding.adjacency(derived.bonds(spark, sf_dir)), derived.ATOMS, derived.BONDS)
    return features.select("graph_id", "node_id", bits.pack(F.col("x")).getItem(0).alias("x"))
