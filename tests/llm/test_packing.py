"""Packed pieces are an exact round trip of the library's ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hyperclause.llm import packing
from hyperclause.llm._bpe import load

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_the_librarys():
    rng = random.Random(3)
    alphabet = "aAbeEIİß'’stdrvml \n\t.,!?<|>0129éÉñ \u0085\x1cćΣς中😀ﬁªº²½_-— ​ʰŉ"
    texts = ["", "a", "don't", "'S'really", "''s", "<|endoftext|>", "a<|startoftext|> b", "we'll they've 'd", "x" * 100, "é" * 60 + " z", ".'s", "'re"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for k in range(0, len(texts), 41):
        part = texts[k : k + 41]
        ids, offsets = load(PATH).encode(part, 2)
        for i, t in enumerate(part):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(t), t


def test_assignment_fills_sequences():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 300, 400), [5000, 4096, 8192, 1]])
    pieces, count = packing.assign(lengths, 4096)
    assert count == -(-int(lengths.sum()) // 4096)
    covered = {d: [] for d in range(len(lengths))}
    room = {}
    for d, start, size, where, offset in pieces:
        covered[d].append((start, size))
        room.setdefault(where, []).append((offset, size))
    for d, parts in covered.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at and size > 0
            at += size
        assert at == lengths[d]
    for parts in room.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 4096
    assert count * 4096 - int(lengths.sum()) < 4096


def cheapest(lengths, capacity):
    """Each descending document to the sequence of least cost with room, cut where none has: step by step."""
    count = -(-sum(lengths) // capacity)
    held, left, pieces, fresh = [[] for _ in range(count)], [], [], 0
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start = 0
        while lengths[d] - start >= capacity:
            held[fresh].append(capacity)
            pieces.append((d, start, capacity, fresh))
            start, fresh = start + capacity, fresh + 1
        if start < lengths[d]:
            left.append((lengths[d] - start, d, start))
    while left:
        size, d, start = min(left, key=lambda x: (-x[0], x[1], x[2]))
        left.remove((size, d, start))
        cost = lambda k: sum(n + n * n / 2048 for n in held[k])
        room = [capacity - sum(x) for x in held]
        fits = [k for k in range(count) if room[k] >= size] or [k for k in range(count) if room[k] > 0]
        k = min(fits, key=lambda k: (cost(k), k))
        part = min(size, room[k])
        held[k].append(part)
        pieces.append((d, start, part, k))
        if part < size:
            left.append((size - part, d, start + part))
    return pieces


def test_documents_go_to_the_cheapest_sequence():
    rng = np.random.default_rng(7)
    for _ in range(40):
        lengths = rng.integers(1, rng.choice([20, 90, 300]), rng.integers(1, 60))
        pieces, _ = packing.assign(lengths, 64)
        assert [x[:4] for x in pieces] == cheapest(lengths.tolist(), 64)


@pytest.mark.parametrize("group", [64, 2 << 20])
def test_round_trip(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    texts = ["Hello world", "", None, "a " * 9000, "same", "same", "É’s 12"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(2)
    got = packing.pack(df, PATH).collect()
    found = {i: [] for i in range(len(texts))}
    for r in got:
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        assert r.doc_tokens == len(ids_of(texts[r.doc_id]))
    for i, parts in found.items():
        joined = []
        for start, ids in sorted(parts):
            assert start == len(joined)
            joined += ids
        assert joined == ids_of(texts[i])
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(df.where("doc_id < 0"), PATH).count() == 0
