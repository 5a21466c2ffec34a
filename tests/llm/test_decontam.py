"""Edited benchmark passages are found, by exact edit distances."""

import random
import re

import numpy as np
import pytest

from hyperclause.llm import decontam


def distances(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d


def test_edit_distances():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        t = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 20))]
        p, q = np.array(a, np.uint64), np.array(t, np.uint64)
        assert [s for _, s in decontam._ends(p, q, False)] == distances(a, t)[1:]
        best = min((min(distances(a, t[s:e])[-1] for s in range(e + 1)), e) for e in range(1, len(t) + 1))
        start, end, edits = decontam.best_match(p, q, len(a))
        assert (edits, end) == best and distances(a, t[start:end])[-1] == edits


@pytest.mark.parametrize("batch", [200, 1_000_000])
def test_planted_passages(spark, monkeypatch, batch):
    monkeypatch.setattr(decontam, "BATCH_WORDS", batch)
    rng = random.Random(8)
    common = "the of and to in is that for it with".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abdeilnorstu") for _ in range(rng.randrange(4, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(40)]
    docs, want = [], {}
    for i, text in items:
        for rate in (0.0, 0.1, 0.18):
            w = text.split()
            for _ in range(int(rate * len(w))):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            shown = " ".join(w).upper() if rate == 0 else ", ".join(w)
            want[len(docs), i] = rate
            docs.append((len(docs), " ".join([*(word() for _ in range(30)), shown, *(word() for _ in range(rng.choice([0, 25])))])))
    clean = len(docs)
    docs += [(clean + k, " ".join(word() for _ in range(60))) for k in range(60)] + [(9000, None), (9001, ""), (None, items[0][1]), (9002, " ".join(common) * 3000)]
    rows = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, words int").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "the of"), (None, "a b"), items[3]], "item_id long, text string")
    got = decontam.contamination(rows, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert (None, 0) in pairs and all(k in pairs for k, rate in want.items() if rate < 0.1)
    assert sum(k in pairs for k in want) / len(want) >= 0.95
    assert pairs - {(None, 0)} <= set(want)
    tokens = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    texts = dict(items)
    for r in got:
        own = re.findall(r"\w+", texts[r.item_id].lower())
        assert distances(own, tokens[r.doc_id][r.first_word : r.first_word + r.words])[-1] == r.edits <= decontam.allowed(len(own))
    left = decontam.decontaminated(rows, bench)
    assert left.columns == rows.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in docs if d is not None} - {d for d, _ in pairs if d is not None})


def test_no_rows(spark):
    docs, bench = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert decontam.contamination(docs.where("doc_id > 1"), bench).count() == 0
    assert decontam.contamination(docs, bench.where("item_id > 1")).count() == 0
    assert decontam.decontaminated(docs, bench.where("item_id > 1")).count() == 1


def test_neighbouring_copies():
    """Every text of a group of copies is reported, and every copy within a text."""
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(59)]
    near = [[*item[:k], "other", *item[k + 1 :]] for k in range(3, 57, 3)]
    texts = [*[item] * 40, *near, item[:25], ["a", "b"], near[4] + item + ["x"] + near[9], item]
    raw = [" ".join(t).encode() for t in texts]
    hashes, _, _, places = decontam.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    shorter = [f"v{k}" for k in range(300)]  # its gap is wider
    for rows in ([(7, " ".join(item))], [(7, " ".join(item)), (8, " ".join(shorter))]):
        got = sorted(decontam.Items(rows).search(hashes, places))
        assert got == sorted([(t, 7, 0, 59, int(t >= 40)) for t in range(58)] + [(60, 7, 0, 59, 1), (60, 7, 59, 59, 0), (60, 7, 119, 59, 1), (61, 7, 0, 59, 0)])


def test_all_matches():
    p = np.arange(1, 11, dtype=np.uint64)
    cut = np.delete(p, 0)
    assert list(decontam.matches(p, np.concatenate([cut, p, p[:5], cut]), 2)) == [(0, 9, 1), (9, 19, 0), (24, 33, 1)]
    assert list(decontam.matches(p, p[:7], 2)) == [] and list(decontam.matches(np.array([5, 5], np.uint64), np.full(5, 5, np.uint64), 0)) == [(0, 2, 0), (2, 4, 0)]


def test_short_items_and_scripts_without_spaces(spark):
    han = "".join(chr(0x4E00 + 37 * k) for k in range(40))
    thai = "".join(chr(0xE01 + k % 40) for k in range(30))
    items = [(1, "one two Three four five"), (2, "of the"), (3, "word"), (4, han), (5, thai), (6, "\U00020001\U00020002\U00020003x"), (7, "")]
    docs = ["a one, two three FOUR five b", "one two x four five", "and of the and", "Of the!", "WORD.", "word word", "一" + han[:20] + "，" + han[20:] + "丁 end", han[:10] + "乙乙" + han[12:], han[:20], "see " + thai, "\U00020001\U00020002\U00020003X", ""]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontam.contamination(rows, bench).collect()}
    assert got == {(0, 1, 1, 5, 0), (3, 2, 0, 2, 0), (4, 3, 0, 1, 0), (6, 4, 1, 40, 0), (7, 4, 0, 40, 2), (9, 5, 1, 30, 0), (10, 6, 0, 4, 0)}
    assert {r.doc_id for r in decontam.decontaminated(rows, bench).collect()} == {1, 2, 5, 8, 11}


def test_windows_that_match_are_found():
    """Against the edit distance of every stretch of every text: no pair beyond, all equal ones, and 0.95 of the others."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(rng.choice([5, 9, 14, 20, 30]))) for k in range(25)]
    texts = []
    for _ in range(120):
        own = list(rng.choice(items)[1])
        for _ in range(rng.randrange(len(own) // 3)):
            k = rng.randrange(len(own))
            own[k : k + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        texts.append(prose(rng.randrange(8)) + own + prose(rng.randrange(8)))
    raw = [" ".join(t).encode() for t in texts]
    hashes, _, _, places = decontam.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = {(t, i) for t, i, *_ in decontam.Items([(i, " ".join(x)) for i, x in items]).search(hashes, places)}
    least = {(t, i): min(min(distances(x, w[a:])) for a in range(len(w))) for t, w in enumerate(texts) for i, x in items}
    want = {k for k, d in least.items() if d <= decontam.allowed(len(items[k[1]][1]))}
    assert got <= want and {k for k in want if least[k] == 0} <= got
    assert len(want) > 60 and len(got) >= 0.95 * len(want)


def test_batches_count_characters_of_scripts_without_spaces(spark):
    """What is collected and broadcast at once stays within about BATCH_WORDS words, however they are written."""
    items = spark.range(3000).selectExpr("id as item_id", "repeat('字句', 1000) || id as text")
    sizes = [sum(len(decontam.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for _, t in part[:1]) * len(part) for part in decontam.batches_of(items)]
    assert len(sizes) >= 6 and max(sizes) < 1.2 * decontam.BATCH_WORDS and sum(sizes) > 6_000_000
