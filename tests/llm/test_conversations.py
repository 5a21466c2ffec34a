"""Repair of conversations, held against a search over all edits of each conversation as a whole."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from hyperclause.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_repair(rows):
    """By a shortest-path search over (place, state) that carries the audit: least cost, then least audit."""
    seen, blank, duplicate, truncated, told = set(), 0, 0, 0, []
    for _, role, text in rows:
        shown = BLANK.findall(text)
        must = cut = False
        if not shown:
            blank, must = blank + 1, True
        elif (role, text) in seen:
            duplicate, must = duplicate + 1, True
        elif shown[-1] not in ".!?":
            truncated, cut = truncated + 1, True
        seen.add((role, text))
        told.append((role, text, must, cut))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            break
        done.add((i, state))
        for nxt in follow[state]:
            if nxt != "s":
                heappush(heap, (cost + 2, audit + "I", i, nxt, (*made, f"{full[nxt]}:")))
        if i < len(rows):
            role, text, must, cut = told[i]
            heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if not must:
                for nxt in follow[state]:
                    if role[:1] == nxt:
                        heappush(heap, (cost + cut, audit + "K", i + 1, nxt, (*made, f"{role}:{text}")))
                    if nxt != "s":
                        heappush(heap, (cost + 2 + cut, audit + "R", i + 1, nxt, (*made, f"{full[nxt]}:{text}")))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def random_rows(seed, convs, most):
    r = random.Random(seed)
    texts = ["", " \t", "Yes.", "No", "Why?", "a.b", "é!", "Well.\n", "x"]
    return [(r.choice([c, c, None]) if c == 0 else c, r.choice([None, t, t, t + 3, 0]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([*texts, None])) for c in range(convs) for t in range(r.randint(1, most))]


def found(df):
    columns = ["conv_id", *conversations.SUMMARY]
    assert set(columns) == set(df.columns)
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def held(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return conversations.repair(conversations.damage(df))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = random_rows(seed, 150, 9)
    assert found(held(spark, rows)) == {c: plain_repair(r) for c, r in plain_damage(rows).items()}


def test_conversations_over_many_ranges(spark):
    """One conversation with most of the rows, cut in many ranges, is as if it lay in one."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "tool"]), f"{r.randint(0, 400)}{r.choice('.?x')}") for t in range(1500)] + random_rows(3, 20, 5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(held(spark, rows, 8))
        texts = conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA)), turns=True).where("conv_id = 7").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert [t.position for t in texts] == list(range(len(texts)))
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in texts).encode()).hexdigest() == got[7][-1]


def test_layers_hold_all_costs_within_their_span():
    """What a word leaves out above its layers never matters: costs of states differ by at most SPAN."""
    r = random.Random(1)
    for _ in range(300):
        word = conversations.END
        for _ in range(40):
            word = conversations.before(word, r.choice(["s", "u", "a", "t", ""]), r.random() < 0.2, r.random() < 0.3)
            costs = conversations.costs_of(word)
            assert None not in costs and max(costs) - min(costs) <= conversations.SPAN and min(costs) == word[0]


def test_edge_cases(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4 and c != dropped)
    long = "word " * 200_000 + "."
    rows = [(dropped, 0, "user", "Hi."), (kept, 0, "user", long), (kept, None, None, None), (None, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", Copies int, digest int")  # extra columns with clashing names
    got = found(conversations.repair(conversations.damage(df)))
    assert got == {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found(conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA)))) == {}
    extremes = [(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Ho.")]
    assert found(held(spark, extremes))[1][0] in (0, -2)  # 2^64 - 2 modulo 2^64, or one of both was dropped
