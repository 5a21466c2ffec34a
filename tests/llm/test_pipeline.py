"""The pipeline keeps clean documents, and each stage's decisions take effect."""

import pathlib
import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    words = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, prose(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        text = " ".join(w.upper() + "&&&" for w in prose(60).split()) if bad else prose(rng.randrange(40, 90))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    docs.append((200, docs[1][1], "en", "s", 0))  # an exact copy
    docs.append((201, docs[7][1] + " extra", "en", "s", 0))
    docs.append((202, prose(30) + " " + bench[2][1] + " " + prose(30), "en", "s", 0))
    docs.append(docs[2])  # a repeated row
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "12 34 !!", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        kept[name] = sorted(r.doc_id for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    clean = {i for i in range(120) if i % 6}
    assert clean <= set(kept["quality"]) and not {i for i in range(120) if i % 6 == 0} & set(kept["quality"])
    assert not {300, 301, 302} & set(kept["language"]) and clean <= set(kept["language"])
    assert clean <= set(kept["near_duplicates"]) and 200 not in kept["near_duplicates"]
    assert kept["near_duplicates"].count(2) == 1 and 202 in kept["near_duplicates"]
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {202}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in pieces.collect()} == set(kept["decontamination"])


def test_run_matches_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() > 0 and "ids" in got.columns


def test_empty_table(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go(spark, tables):
    """A near copy, with a word appended, leaves with the exact one."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 300")
    left = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, tables).select("doc_id").collect()}
    assert left == {*range(120), 202}


def test_near_copies_are_told_by_row(spark, tables):
    """Rows that share an id are decided one by one: by their texts, not by the id."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    a, b, c, d, e, f = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(6))
    rows = [(1, a, 0), (1, b, 1), (2, c, 2), (3, c, 3), (2, d, 4), (0, d, 5), (4, e, 6), (4, e, 7), (4, e + " more", 8), (5, e, 9), (6, f, 10), (6, f, 11), (None, f, 12), (7, None, 13), (7, "", 14), (7, a + " x", 15)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, n) for i, t, n in rows], "doc_id long, text string, lang string, source string, set long, alike long").repartition(3)
    left = {r["set"]: (r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, tables).collect()}
    assert all(left[n] == (rows[n][0], rows[n][1]) for n in left)
    assert {0, 1, 2, 5, 12} <= set(left)  # unlike texts of one id, the least of their groups, and a row without an id
    assert not {3, 4, 9, 15} & set(left)  # copies of a row with a lesser id, also where that id has another row
    assert len({6, 7, 8} & set(left)) == len({10, 11} & set(left)) == len({13, 14} & set(left)) == 1
    assert len(left) == 8


def test_columns_of_any_name_stay(spark, tables):
    """Columns named like what the stages compute keep their values, as do very long and repeated texts."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 20 or doc_id = 202")
    for n, name in enumerate(["score", "Score_", "lang_pred", "passages", "component_id", "set", "keys", "rows", "__id", "y", "a.b", "c`d"]):
        docs = docs.withColumn(name, docs.doc_id * 100 + n)
    one = docs.where("doc_id = 1")
    docs = docs.unionByName(one).unionByName(one.selectExpr("500 doc_id", "repeat(text || ' ', 2000) text", "* except (doc_id, text)").select(*[f"`{c.replace('`', '``')}`" for c in docs.columns]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows, name
        assert all(list(r)[5:] == [(1 if r.doc_id == 500 else r.doc_id) * 100 + n for n in range(12)] for r in rows)


def test_what_a_stage_wrote_goes(spark, tables):
    from hyperclause.llm._common import shared_folder

    corpus_pipeline.run(spark, tables).count()
    folder = shared_folder(spark).removeprefix("file:")
    assert all([p.name for p in run.iterdir()] == ["4-packing"] for run in pathlib.Path(folder).glob("pipeline-*"))
