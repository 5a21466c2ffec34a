"""Encoders, clause machines, metrics, search, training, molecules and files: golden cases and plain-Python oracles."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperclause.functions import bits
from hyperclause.operators import chemistry, clauses, encoding, explain, metrics, recourse, training
from hyperclause.sources import readers, writers
from hyperclause.streaming import scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(values):
    return F.array(*[F.lit(v) for v in values])


def test_bit_vectors(spark):
    a, b = [1, 0, 1, 1] * 10, [0, 1, 1, 0] * 10
    pack = lambda v: bits.pack(lit(v))
    assert one(spark, bits.unpack(pack(a), 40)) == a
    assert one(spark, bits.bind(bits.bind(pack(a), pack(b)), pack(b))) == one(spark, pack(a))
    assert one(spark, bits.similarity(pack(a), pack(b), 40)) == sum(x == y for x, y in zip(a, b)) / 40
    for k in (0, 1, 7, 39, 41):
        assert one(spark, bits.permute(lit(a), k)) == list(np.roll(a, k))
    long = [random.Random(1).randrange(2) for _ in range(96)]
    for k in (0, 1, 31, 32, 50, 95):
        assert one(spark, bits.unpack(bits.permute_words(pack(long), F.lit(k)), 96)) == list(np.roll(long, k))
    assert one(spark, bits.thermometer(F.lit(2.0), 4, 0.0, 4.0)) == [1, 0, 0, 0]
    assert one(spark, bits.thermometer_int(F.lit(2), 4)) == [1, 1, 0, 0]
    assert one(spark, bits.one_hot(F.lit(9), 4)) == [0, 0, 0, 0]
    assert one(spark, bits.pack(F.array().cast("array<int>"))) == []
    with pytest.raises(ValueError):
        bits.thermometer(F.lit(1.0), 4, 1.0, 1.0)
    with pytest.raises(Exception, match="different sizes"):
        one(spark, bits.bind(pack(a), pack([1])))


@pytest.mark.parametrize("rows,want", [(["1100", "1010", "1001"], "1000"), (["1010", "0101"], "1010"), (["0110"], "0110")])
def test_majority(spark, rows, want):
    df = spark.createDataFrame([(0, i, [int(c) for c in r]) for i, r in enumerate(rows)], "g int, i int, b array<int>").withColumn("hv", bits.pack(F.col("b")))
    got = encoding.majority(df, ["g"], "hv", F.col("i") == 0, 4).select(bits.unpack(F.col("hv"), 4).alias("v")).first().v
    assert got == [int(c) for c in want]


def graph(spark, rows):
    return encoding.from_arrays(spark.createDataFrame(rows, "graph_id long, atom_types array<string>, edges array<struct<u: int, v: int, bond: string>>"))


def test_encoder(spark):
    book = encoding.codebook(spark, 9, 4, 3, 256, 0.1, 5)
    nodes, bonds = graph(spark, [
        (0, ["C", "C", "O"], [(0, 1, "single"), (1, 2, "single")]),
        (1, ["C", "C", "O"], [(0, 1, "single"), (1, 2, "double")]),
        (2, ["O", "C", "C"], [(2, 1, "SINGLE"), (1, 0, "1")]),
    ])
    near = encoding.adjacency(bonds.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "bond_type"))
    hv = {(r.graph_id, r.node_id): r.hv for r in encoding.node_vectors(nodes, near, book, 2, 256).collect()}
    assert [hv[0, i] for i in (0, 1, 2)] == [hv[2, i] for i in (2, 1, 0)]
    assert hv[0, 2] != hv[1, 2]
    alone = {(r.graph_id, r.node_id): r.hv for r in encoding.node_vectors(nodes, near, book, 0, 256).collect()}
    codes = {r.code: r.words for r in book.where("kind = 'atom'").collect()}
    assert alone[0, 0] == codes[0] and alone[0, 2] == codes[2]
    assert {r.n for r in book.select(F.aggregate("bits", F.lit(0), lambda a, b: a + b).alias("n")).collect()} == {26}
    edges = {(r.graph_id, r.src, r.dst): r.hv for r in encoding.edge_vectors(nodes, near, book).collect()}
    assert all(edges[g, u, v] == edges[g, v, u] for g, u, v in edges)
    with pytest.raises(ValueError):
        encoding.neighbourhoods(nodes, near, book, -1)
    with pytest.raises(Exception, match="unknown bond"):
        graph(spark, [(0, ["C", "C"], [(0, 1, "odd")])])[1].collect()
    with pytest.raises(Exception, match="outside"):
        graph(spark, [(0, ["C", "C"], [(0, 5, "single")])])[1].collect()


def tree_value(state, x, spec, threshold, negated):
    """Ways in which a clause holds, by definition."""
    total = 1
    for j in range(spec.root):
        or_ = 0
        for k in range(spec.inner_or):
            and_ = 1
            for l in range(spec.inner_and):  # noqa: E741
                leaves = 0
                for m in range(spec.leaf_or):
                    base = j * spec.inner_and * spec.leaf_and + l * spec.leaf_and
                    values = [x[base + n] for n in range(spec.leaf_and)] + [negated[base + n] for n in range(spec.leaf_and)]
                    leaves += all(v for v, s in zip(values, state[j][k][l][m]) if s > threshold)
                and_ *= leaves
            or_ += and_
        total *= or_
    return total


@pytest.mark.parametrize("spec", [clauses.Spec(), clauses.Spec(clauses=34, root=3, inner_or=1, leaf_or=2, leaf_and=3)])
def test_clause_trees(spark, spec):
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 3)
    states = np.zeros((spec.clauses, spec.root, spec.inner_or, spec.inner_and, spec.leaf_or, 2 * spec.leaf_and), int)
    for r in ta.collect():
        states[r.clause, r.j, r.k, r.l, r.m, r.n] = r.state
    rng = random.Random(2)
    rows = [[rng.randrange(2) for _ in range(2 * spec.features)] for _ in range(25)]
    df = spark.createDataFrame([(i // 3, i, r) for i, r in enumerate(rows)], "graph_id long, node_id int, b array<int>").withColumn("hv", bits.pack(F.col("b")))
    model = clauses.model(ta, spec, 100)
    for negation in ("complement", "offset"):
        x, nx = clauses.literal_inputs(F.col("hv"), spec, negation)
        held = clauses.with_model(df.select("node_id", x.alias("x"), nx.alias("nx")), model)
        ways = {r.node_id: r.w for r in held.select("node_id", F.transform("clauses", lambda c: clauses.multiplicity(c, F.col("x"), F.col("nx"))).alias("w")).collect()}
        fired = {r.node_id: r.f for r in clauses.fired_words(df, model, spec, negation).select("node_id", bits.unpack(F.col("fired"), spec.clauses).alias("f")).collect()}
        for i, r in enumerate(rows):
            own = r[: spec.features]
            negated = [1 - v for v in own] if negation == "complement" else r[spec.features :]
            want = [tree_value(states[c], own, spec, 100, negated) for c in range(spec.clauses)]
            assert ways[i] == want and fired[i] == [int(w > 0) for w in want]
    words = clauses.graph_clauses(clauses.fired_words(df, model, spec))
    sums = {r.graph_id: r.s for r in words.select("graph_id", clauses.class_sum(F.col("fired"), spec).alias("s")).collect()}
    scores = {(r.graph_id, r.class_id): r.score for r in clauses.class_scores(words, spec).collect()}
    pred = {r.graph_id: r.pred for r in clauses.predict(clauses.class_scores(words, spec)).collect()}
    for g in sums:
        own = [any(tree_value(states[c], r[: spec.features], spec, 100, [1 - v for v in r[: spec.features]]) for r in rows[3 * g : 3 * g + 3]) for c in range(spec.clauses)]
        assert sums[g] == sum((1 if c % 2 == 0 else -1) * v for c, v in enumerate(own)) == scores[g, 1]
        assert scores[g, 0] == 0 and pred[g] == int(sums[g] > 0)


def test_wrapping(spark):
    spec = clauses.Spec(clauses=2, root=2, inner_or=1, inner_and=8, leaf_or=15, leaf_and=1)
    model = clauses.model(clauses.central_states(clauses.addresses(spark, spec), spec), spec, 100)
    held = clauses.with_model(spark.range(1).select(F.lit(0).cast("long").alias("x")), model)
    exact, wrapped = (held.select(clauses.multiplicity(F.get("clauses", 0), F.col("x"), F.col("x"), o).alias("v")).first().v for o in ("exact", "wrap32"))
    wrap = lambda v: (v + 2**31) % 2**32 - 2**31
    assert wrapped == wrap(wrap(15**8) ** 2)
    assert exact == 15**16 != wrapped


@pytest.mark.parametrize("bad", [{"clauses": 3}, {"clauses": 0}, {"classes": 0}, {"s": 1.0}, {"threshold": 0}, {"states": 1}, {"leaf_or": 0}, {"root": 8, "inner_and": 8, "leaf_and": 2}])
def test_specs(bad):
    with pytest.raises(ValueError):
        clauses.Spec(**bad)
    assert clauses.Spec(leaf_or=4).literals == 128


def test_firing_clauses(spark):
    rows = [(0, n, c, int((c, n) in {(0, 1), (0, 3), (2, 2)})) for c in range(4) for n in range(4)]
    got = explain.firing_clauses(spark.createDataFrame(rows, "graph_id int, node_id int, clause int, output int"), 2).orderBy("clause").collect()
    assert [(r.clause, r.voted_class, r.sign, r.node_ids, r.clause_output) for r in got] == [(0, 0, 1, [1, 3], 2), (2, 0, 1, [2], 1)]
    parsed = spark.createDataFrame([("X12=1",), (" ~X3=1",)], "t string").select(explain.parse_literal(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in parsed] == [(12, 1), (3, 0)]
    with pytest.raises(Exception, match="no literal"):
        one(spark, explain.parse_literal(F.lit("Y1=1")))


def test_auroc(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(2), rng.randrange(6)) for _ in range(80)] + [(9, 1, 3)]
    df = spark.createDataFrame(rows, "g int, y int, s int")
    got = {r.g: r.auroc for r in metrics.auroc(df, ["g"], "y", "s").collect()}
    for g in {r[0] for r in rows}:
        pos, neg = ([s for k, y, s in rows if k == g and y == v] for v in (1, 0))
        pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)]
        assert got[g] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.5)


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"), F.concat(F.lit("g"), F.floor(F.sqrt("id")).cast("string")).alias("grp"))
    counts = {n: {r.split: r["count"] for r in metrics.random_split(df.repartition(n), "id", 1, 0.8, 0.1).groupBy("split").count().collect()} for n in (1, 4)}
    assert counts[1] == counts[4] == {"train": 800, "valid": 100, "test": 100}
    held = metrics.stratified_holdout(df, "id", "y", 0.15, 1).where("held = 1")
    assert {r.y: r["count"] for r in held.groupBy("y").count().collect()} == {1: 30, 0: 120}
    groups = metrics.group_split(df, "grp", 1, 0.8, 0.1).collect()
    assert len(groups) == len({r.grp for r in groups}) and {r.split for r in groups} >= {"train", "valid"}
    assert metrics.accuracy(df.where("id < 0"), "y", "y").first().accuracy != metrics.accuracy(df.where("id < 0"), "y", "y").first().accuracy


def test_search(spark):
    """The model is 1 while bond (0, 1) exists; another edit does nothing."""
    nodes = spark.createDataFrame([(0, n, 0) for n in range(3)] + [(1, n, 0) for n in range(3)], "graph_id long, node_id int, atom_type int")
    bonds = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 0), (1, 1, 2, 0), (1, 0, 1, 0)], "graph_id long, u int, v int, bond_type int")
    edits = spark.createDataFrame([(0, 1, "remove_bond", 1, 2, None), (0, 2, "remove_bond", 0, 1, None), (0, 3, "remove_bond", 0, 2, None), (1, 1, "remove_bond", 1, 2, None)], "graph_id long, ordinal int, op string, i int, j int, new_value int")

    def score(n, b):
        hit = b.where("u = 0 and v = 1").select("graph_id").distinct().withColumn("hit", F.lit(1))
        return n.select("graph_id").distinct().join(hit, "graph_id", "left").select("graph_id", F.when(F.col("hit") == 1, 5).otherwise(-5).alias("class_sum"))

    state = spark.createDataFrame([(0, 1, 5), (1, 1, 5)], "graph_id long, target int, margin int")
    fixed = lambda df: df.checkpoint()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = recourse.search(nodes, bonds, edits, state, score, fixed).collect()
    assert [(r.graph_id, r.step, r.op, r.i, r.j) for r in got] == [(0, 1, "remove_bond", 0, 1)]
    assert recourse.search(nodes, bonds, edits, state, score, fixed, max_flips=0).count() == 0
    none = recourse.search(nodes, bonds, edits, state, score, fixed, valid=lambda n, b: n.where(F.lit(False)).select("graph_id"))
    assert none.count() == 0
    added = spark.createDataFrame([(0, 1, "add_bond", 2, 0, 1), (0, 2, "add_bond", 0, 1, 1), (0, 3, "swap_atom", 1, None, 4)], edits.schema)
    usable = recourse.applicable(added, bonds)
    assert sorted(r.ordinal for r in usable.collect()) == [1, 3]
    atoms, left = recourse.apply_edits(nodes, bonds, usable)
    assert left.where("ordinal = 1").count() == 3 and atoms.where("ordinal = 3 and atom_type = 4").first().node_id == 1


@pytest.mark.parametrize("name,rule,floor", [("linear", lambda x: x[:, 0], 0.9), ("xor", lambda x: x[:, 0] ^ x[:, 1], 0.85)])
def test_machines_learn(name, rule, floor):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (700, 4))
    y = rule(x)
    spec = clauses.Spec(clauses=20, threshold=15, s=3.9, root=1, inner_or=2, inner_and=2, leaf_or=2, leaf_and=2)
    x8 = x.astype(bool)
    machine = training.Machine(spec, 5).fit(x8[:500], y[:500], 12)
    assert np.mean([(machine.score(r) > 0) == t for r, t in zip(x8[500:], y[500:])]) > floor
    assert machine.state.min() >= 1 and machine.state.max() <= 2 * spec.states


def test_balanced_start():
    m = training.Machine(clauses.Spec(), 4)
    plain, negated = np.split(m.state, 2, axis=-1)
    assert set(np.unique(m.state)) == {100, 101} and ((plain + negated) == 201).all()


def test_graph_training_is_repeatable():
    rng = np.random.default_rng(0)
    spec = clauses.Spec(clauses=10, threshold=8, root=1, inner_or=1, inner_and=2, leaf_or=2, leaf_and=2)
    graphs = [rng.integers(0, 2, (rng.integers(2, 5), spec.features)).astype(bool) for _ in range(80)]
    y = np.array([int(g[:, 0].any()) for g in graphs])
    one, two = (training.graph_fit(training.Machine(spec, 3, boost=True), graphs, y, 2).state for _ in range(2))
    assert (one == two).all()


def test_ensemble_states_score_alike(spark):
    """States trained in tasks give the relational evaluator the same votes."""
    rng = np.random.default_rng(1)
    spec = clauses.Spec(clauses=4, threshold=5, root=1, inner_or=2, inner_and=2, leaf_or=2, leaf_and=1)
    x = rng.integers(0, 2, (60, spec.features))
    rows = spark.createDataFrame([(i, "train" if i < 45 else "valid", int(r[0]), r.tolist()) for i, r in enumerate(x)], "id long, split string, y int, bits array<int>")
    history = training.train_ensemble(rows, spec, [7, 8], 2)
    ta = training.states_table(history.where("epoch = 2 and seed = 7"), spec).drop("seed")
    again = training.Machine(spec, 7)
    again.fit(x[:45].astype(bool), x[:45, 0], 1).fit(x[:45].astype(bool), x[:45, 0], 1)
    fired = clauses.fired_words(rows.select(F.col("id").alias("graph_id"), F.lit(0).alias("node_id"), bits.pack(F.col("bits")).alias("hv")), clauses.model(ta, spec, spec.states), spec)
    got = {r.graph_id: r.f for r in fired.select("graph_id", bits.unpack(F.col("fired"), spec.clauses).alias("f")).collect()}
    for i, r in enumerate(x):
        assert got[i] == [int(v > 0) for v in again.evaluate(again.literals(r.astype(bool)))[-1]]


def test_multiclass_learns():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (500, 4)).astype(bool)
    y = x[:, 0].astype(int) + x[:, 1]
    spec = clauses.Spec(clauses=20, threshold=15, root=1, inner_or=2, inner_and=2, leaf_or=2, leaf_and=2, classes=3)
    model = training.MultiClass(spec, 2).fit(x[:400], y[:400], 8)
    assert (model.predict(x[400:]) == y[400:]).mean() > 0.8


def test_molecules(spark):
    atoms, bonds = chemistry.parse("CC(=O)Oc1ccccc1C(=O)O")
    assert len(atoms) == 13 and sum(a[3] for a in atoms) == 8
    keys = {chemistry.scaffold(*chemistry.parse(s)) for s in ("C1CCCCC1CC", "CCC1CCCCC1", "C2CCCCC2")}
    assert len(keys) == 1 and chemistry.scaffold(*chemistry.parse("c1ccccc1")) not in keys and chemistry.scaffold(*chemistry.parse("CCO")) == ""
    for bad in ("", None, "C(", "C1CC", "C(C)(C)(C)(C)C", "hello world"):
        with pytest.raises(ValueError):
            chemistry.parse(bad)
    parsed = chemistry.molecules(spark.createDataFrame([(1, "CCO"), (2, None)], "id long, smiles string"), "id", "smiles")
    got = {r.id: r for r in chemistry.validity(parsed).collect()}
    assert got[1].overall_ok and got[1].sa_score is None and not got[2].overall_ok


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Drug_ID,Drug,Y\n1,CCO,1\n2,,0\n3,CC,x\n4,C,0.0\n")
    assert [tuple(r) for r in readers.molecules(spark, str(tmp_path / "t.csv")).collect()] == [("CCO", 1), ("C", 0)]
    assert readers.first_source(spark, [("a", str(tmp_path / "none.csv")), ("b", str(tmp_path / "t.csv"))])[0] == "b"
    rules = [{"kazius_id": i, "name": f"n{i}", "smarts": "C", "tier": "a"} for i in range(8)]
    (tmp_path / "r.yaml").write_text(json.dumps(rules))
    assert readers.rules(spark, str(tmp_path / "r.yaml")).count() == 8
    (tmp_path / "r.yaml").write_text(json.dumps(rules[:7] + rules[:1]))
    with pytest.raises(ValueError):
        readers.rules(spark, str(tmp_path / "r.yaml"))
    with pytest.raises(ValueError):
        writers.write_json(spark.range(1), str(tmp_path), "../out")
    assert spark.read.json(writers.write_json(spark.range(3), str(tmp_path), "out")).count() == 3
    assert writers.markdown(spark.range(40), "Rows").count("\n") == 29
    graphs, nodes, bonds = readers.random_graphs(spark, 50, 9, 4, 3)
    assert graphs.count() == 50 and {r.y for r in graphs.collect()} == {0, 1}
    with pytest.raises(ValueError):
        readers.assay(spark.range(1), "none")


def test_stream(spark, tmp_path):
    spec = clauses.Spec(clauses=4)
    model = clauses.model(clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 3), spec, 100)
    rows = spark.range(20).select(F.col("id").alias("graph_id"), F.array(F.col("id") * 7 % 256, F.col("id") * 31 % 256).alias("nodes"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    want = sorted(tuple(r) for r in scoring.score_stream(rows, model, spec).collect())
    assert len(want) == 20
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scoring.score_stream(stream, model, spec).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("select * from scored").collect()) == want
    rates = scoring.windowed_rates(scoring.score_stream(rows, model, spec), "ts", "5 minutes", "10 minutes")
    assert sum(r.n for r in rates.collect()) == 20


def test_flat_machine_learns():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (900, 6))
    y = x[:, 0] ^ x[:, 1]
    machine = training.FlatMachine(6, 20, 2, 15, 3.9, seed=2, most=4).fit(x[:700], y[:700], 8)
    assert (machine.predict(x[700:]) == y[700:]).mean() > 0.95
    assert ((machine.state >= machine.states).sum(axis=1) <= 4).all()
    assert machine.transform(x[:5]).shape == (5, 20)
    several = training.FlatMachine(6, 40, 2, 15, 3.9, seed=3).fit_outputs(x[:700], np.stack([x[:, 0], 1 - x[:, 2]], axis=1)[:700], 5)
    sums = np.stack([several.sums(r) for r in x[700:]]) >= 0
    assert (sums == np.stack([x[700:, 0], 1 - x[700:, 2]], axis=1)).mean() > 0.95


def test_load_and_snapshots(spark, tmp_path):
    lines = ["Drug,Y"] + [f"{'C' * (i + 1)},{i % 2}" for i in range(20)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows, meta = readers.load(spark, [("cache", str(tmp_path / "t.csv"))], 3)
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 16, "valid": 2, "test": 2}
    assert tuple(meta.first()) == (20, 10, 10, "cache")
    spec = clauses.Spec()
    ta = clauses.hashed_states(clauses.addresses(spark, spec), 1, 150, 3)
    writers.save_automata(ta, str(tmp_path / "ta"))
    assert sorted(map(tuple, writers.load_automata(spark, str(tmp_path / "ta")).collect())) == sorted(map(tuple, ta.collect()))


def test_distillation_follows_the_teacher(spark):
    rng = np.random.default_rng(1)
    spec = clauses.Spec(clauses=10, threshold=8, root=1, inner_or=1, inner_and=2, leaf_or=2, leaf_and=2)
    x = rng.integers(0, 2, (120, spec.features))
    rows = spark.createDataFrame([(i, "train" if i < 100 else "valid", r.tolist()) for i, r in enumerate(x)], "id long, split string, bits array<int>")
    teacher = spark.createDataFrame([(i, int(r[0])) for i, r in enumerate(x)], "graph_id long, hard int")
    best = metrics.best_epoch(training.distill(rows.withColumn("y", F.lit(0)), teacher, spec, [1, 2], 6).select("seed", "epoch", F.col("valid_auroc").alias("value")), ["seed"])
    assert {r.seed for r in best.collect()} == {1, 2} and min(r.value for r in best.collect()) > 0.8
