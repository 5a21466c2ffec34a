"""The runnable jobs: over growing input, broken off, run again, and held against plain Python."""

import json
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import alert_screen, labelled_sets

ROOT = Path(__file__).parent.parent
DOCUMENTS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
RULES = [{"name": "b", "pattern": "b", "tier": "letters"}, {"name": "two", "pattern": "[0-9]{2}", "tier": "digits"}]


def put(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# Alerts


def plain_screen(documents, labels):
    """kind, alert, part, documents and total, from all documents at once."""
    out, hits = Counter(), [(d, s, r["name"]) for d, t, _, s in documents for r in RULES if t is not None and re.search(r["pattern"], t)]
    seen = Counter(s for _, _, _, s in documents)
    once = {h for h in hits if h[0] is not None}
    for alert, source in {(a, s) for _, s, a in once}:
        out["source", alert, "null" if source is None else source, len({d for d, s, a in once if (a, s) == (alert, source)}), seen[source]] += 1
    known = {(d, f"quality={q}") for d, q, _ in labels if q is not None} | {(d, f"toxic={t}") for d, _, t in labels if t is not None}
    for alert in {a for _, _, a in once}:
        ids = {d for d, _, a in once if a == alert}
        for part in {p for d, p in known if d in ids}:
            out["label", alert, part, len({d for d, p in known if p == part and d in ids}), len(ids)] += 1
    return out, Counter(("hit", a, s) for _, s, a in hits)


def screened(spark, output):
    got = alert_screen.read(spark, output)
    reports = Counter((r.kind, r.alert, r.part, r.documents, r.total) for r in got.where("kind <> 'hit'").collect())
    return reports, Counter(("hit", r.alert, r.part) for r in got.where("kind = 'hit'").collect())


FIRST = [(1, "a b", "en", "x"), (2, "12 b", "en", "x"), (3, None, "en", None), (4, "", "de", None), (None, "b", None, "y")]
SECOND = [(5, "b\n99", "en", "x"), (2, "12 b", "en", "x"), (6, "b", None, None), (7, "long " * 100_000 + "77", "en", "z")]
KNOWN = [(1, 1, 0), (2, 0, None), (2, 0, 1), (5, 1, 1), (9, 1, 1), (None, 1, 1)]


def test_screen_takes_only_what_is_new(spark, tmp_path):
    documents, labels, output = (str(tmp_path / n) for n in ("documents.parquet", "labels.parquet", "out"))
    put(spark, FIRST, DOCUMENTS, documents)
    put(spark, KNOWN[:4], LABELS, labels)
    one = alert_screen.run(spark, documents, labels, output, RULES)
    assert one["documents"] == len(FIRST) and screened(spark, output) == plain_screen(FIRST, KNOWN[:4])
    again = alert_screen.run(spark, documents, labels, output, RULES)
    assert again["documents"] == again["hits"] == 0 and screened(spark, output) == plain_screen(FIRST, KNOWN[:4])
    before = {p: p.stat().st_mtime_ns for p in Path(output, "hits").rglob("*.parquet")}
    put(spark, SECOND, DOCUMENTS, documents)
    put(spark, KNOWN[4:], LABELS, labels)  # labels may come later
    two = alert_screen.run(spark, documents, labels, output, RULES)
    assert two["documents"] == len(SECOND) and screened(spark, output) == plain_screen(FIRST + SECOND, KNOWN)
    assert before.items() <= {p: p.stat().st_mtime_ns for p in Path(output, "hits").rglob("*.parquet")}.items()  # what was there stays
    assert sorted(os.listdir(f"{output}/hits/batch=1")) and not spark.streams.active


def test_screen_goes_on_after_a_broken_batch(spark, tmp_path, monkeypatch):
    """A batch that broke off after its hits were written is written again, not added to."""
    documents, labels, output = (str(tmp_path / n) for n in ("documents.parquet", "labels.parquet", "out"))
    put(spark, FIRST, DOCUMENTS, documents)
    put(spark, KNOWN, LABELS, labels)
    with monkeypatch.context() as m:
        m.setattr(alert_screen.log, "info", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            alert_screen.run(spark, documents, labels, output, RULES)
    put(spark, SECOND, DOCUMENTS, documents)
    alert_screen.run(spark, documents, labels, output, RULES, files_per_batch=1)
    assert screened(spark, output) == plain_screen(FIRST + SECOND, KNOWN)


def test_screen_of_an_empty_table_and_one_file(spark, tmp_path):
    documents, labels, output = (str(tmp_path / n) for n in ("documents.parquet", "labels.parquet", "out"))
    put(spark, [], DOCUMENTS, documents)
    put(spark, [], LABELS, labels)
    assert alert_screen.run(spark, documents, labels, output, RULES) == {"documents": 0, "hits": 0, "report": 0}
    put(spark, FIRST, DOCUMENTS, str(tmp_path / "folder"))
    (file,) = [p for p in (tmp_path / "folder").iterdir() if p.suffix == ".parquet"]
    assert alert_screen.run(spark, str(file), labels, f"{output}-2", RULES)["documents"] == len(FIRST)
    with pytest.raises(ValueError):
        alert_screen.run(spark, documents, labels, f"{output}-3", [RULES[0], RULES[0]])


def test_screen_of_molecules(spark, tmp_path):
    """Structures in texts that are molecules, beside expressions in texts; and rules that change."""
    documents, labels, output = (str(tmp_path / n) for n in ("documents.parquet", "labels.parquet", "out"))
    put(spark, [(1, "Nc1ccccc1", "en", "x"), (2, "CC(=O)Nc1ccccc1", "en", "y"), (3, "no molecule", "en", "x"), (4, None, "en", "x")], DOCUMENTS, documents)
    put(spark, [(1, 0, 1), (2, 1, 0)], LABELS, labels)
    rules = [{"name": "amine", "pattern": "[NX3;H2]-a", "tier": "toxic", "structure": True}, {"name": "ring", "pattern": "a", "tier": "shape", "structure": True}, {"name": "no", "pattern": "no", "tier": "text"}]
    alert_screen.run(spark, documents, labels, output, rules)
    got = alert_screen.read(spark, output)
    assert {(r.doc_id, r.alert, r.tier, r.part) for r in got.where("kind = 'hit'").collect()} == {(1, "amine", "toxic", "x"), (1, "ring", "shape", "x"), (2, "ring", "shape", "y"), (3, "no", "text", "x")}
    assert {(r.alert, r.part, r.documents, r.total) for r in got.where("kind = 'label' and alert = 'ring'").collect()} == {("ring", p, 1, 2) for p in ("quality=0", "quality=1", "toxic=0", "toxic=1")}
    alert_screen.run(spark, documents, labels, output, rules[::-1])  # the order of rules doesn't matter
    for bad in (rules[:2], [{**rules[0], "pattern": "[NX3"}], []):
        with pytest.raises(ValueError):
            alert_screen.run(spark, documents, labels, output, bad)


# Labelled sets


def corpus():
    texts = [f"Text  number {k}." for k in range(60)]
    rows = [(k, texts[k], "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, f" text NUMBER\t{k % 7}. ", None, None) for k in range(40)]  # copies but for case and white space
    rows += [(200, None, "en", "s"), (201, " \t ", "en", "s"), (300, "kept apart", "en", "s"), (301, "Kept apart", "en", "s"), (302, "unlabelled", "en", "s"), (None, "no id", "en", "s")]
    return rows


def known():
    return [(k, (k % 7) % 2 if k < 7 else k % 2, 0) for k in range(60)] + [(100 + k, (k % 7) % 2, None) for k in range(40)] + [(200, 1, 0), (201, 1, 0), (300, 0, 0), (301, 1, 0), (None, 1, 1), (8, 7, 0), (9, 0, 0)]


def test_labelled_sets(spark, tmp_path):
    documents, labels, output = (str(tmp_path / n) for n in ("documents.parquet", "labels.parquet", "out"))
    put(spark, [(*r, 1, 2) for r in corpus()], DOCUMENTS + ", y int, copies int", documents)  # extra columns with clashing names
    put(spark, [(*r, "x") for r in known()], LABELS + ", text string", labels)
    counts = labelled_sets.run(spark, documents, labels, output)
    got = labelled_sets.read(spark, output).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip().lower()
    y = {}
    for d, q, _ in known():
        if d is not None and q in (0, 1):
            y[d] = max(q, y.get(d, 0))
    texts = {d: t for d, t, _, _ in corpus() if d in y and t and t.strip()}
    assert {r.doc_id: (r.text, r.y) for r in got} == {d: (t, y[d]) for d, t in texts.items()} and len(got) == len(texts)
    groups = Counter(key(t) for t in texts.values())
    for r in got:
        same = [d for d, t in texts.items() if key(t) == key(r.text)]
        assert r.copies == groups[key(r.text)] and r.first == (r.doc_id == min(same))
        assert (r.split == "conflict") == (len({y[d] for d in same}) > 1)
    sets = {}
    for r in got:
        sets.setdefault(key(r.text), set()).add(r.split)
    assert all(len(s) == 1 for s in sets.values())  # no group leaks
    train = [r for r in got if r.split == "train"]
    agreed = sum(r.split != "conflict" for r in got)
    assert 0 < len(train) <= 0.8 * agreed and {r.split for r in got} == {"train", "valid", "test", "conflict"}
    per = Counter(r.y for r in train)
    assert all(abs(r.weight - 1 / per[r.y]) < 1e-12 for r in train) and all(r.weight is None for r in got if r.split != "train")
    assert sum(v for k, v in counts.items() if "/" in k) == len(got) and counts["documents"] == len(corpus())
    once = rows_of(labelled_sets.read(spark, output))
    labelled_sets.run(spark, documents, labels, output)
    assert rows_of(labelled_sets.read(spark, output)) == once
    put(spark, corpus()[:10], DOCUMENTS, str(tmp_path / "less"))  # a run over other input leaves nothing of the last
    labelled_sets.run(spark, str(tmp_path / "less"), labels, output)
    assert {r.doc_id for r in labelled_sets.read(spark, output).collect()} == set(range(10))


def test_labelled_sets_of_empty_tables(spark, tmp_path):
    put(spark, [], DOCUMENTS, str(tmp_path / "d"))
    put(spark, [], LABELS, str(tmp_path / "l"))
    assert labelled_sets.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o")) == {"documents": 0, "labels": 0}
    assert labelled_sets.read(spark, str(tmp_path / "o")).count() == 0


@pytest.mark.parametrize("job", ["labelled_sets", "alert_screen"])
def test_command_line(spark, tmp_path, job):
    put(spark, FIRST, DOCUMENTS, str(tmp_path / "d"))
    put(spark, KNOWN, LABELS, str(tmp_path / "l"))
    config = json.loads((ROOT / "jobs" / f"{job}.json").read_text()) | {"documents": str(tmp_path / "d"), "labels": "none", "output": str(tmp_path / "o")}
    config |= {"rules": RULES} if "rules" in config else {}
    (tmp_path / "config.json").write_text(json.dumps(config))
    asked = [sys.executable, "-m", f"jobs.{job}", "--config", str(tmp_path / "config.json"), "--labels", str(tmp_path / "l")]
    done = subprocess.run(asked, cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    module = {"labelled_sets": labelled_sets, "alert_screen": alert_screen}[job]
    assert module.read(spark, str(tmp_path / "o")).count() > 0
