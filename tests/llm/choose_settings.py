"""Scores of settings of the quality and toxicity classifiers on a validation fold: python -m tests.llm.choose_settings SF_DIR [quality] [toxic].

Only learnable rows are read (those of the held-out folds are dropped at once). Every fifth of these, by another hash, is
the validation fold; the others are learned from. Run by hand; the settings chosen stand in the modules.
"""

from __future__ import annotations

import sys
import zlib
from concurrent.futures import ProcessPoolExecutor
from itertools import product

import numpy as np
import pyarrow.parquet as pq

from hyperclause.llm import quality, toxicity
from hyperclause.llm._common import slices, utf8


def rows(folder: str, label: str, folds: int, held: int, most: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """ids, labels and texts of about `most` learnable documents, and as many as a quarter of that to validate."""
    known = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    fold = lambda i: zlib.crc32(str(i).encode())
    y = {i: v for i, v in zip(known["doc_id"], known[label]) if i is not None and v in (0, 1) and fold(i) % folds != held}
    wanted = set(sorted(y, key=lambda i: zlib.crc32(f"{i} sample".encode()))[: most * 5 // 4])
    ids, texts = [], []
    for batch in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_batches():
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i in wanted:
                wanted.discard(i)
                ids.append(i)
                texts.append((t or "").encode())
    return np.array(ids), np.array([y[i] for i in ids]), texts


def report(p: np.ndarray, y: np.ndarray) -> str:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    loss = -np.mean(np.where(y == 1, np.log(q), np.log(1 - q)))
    return f"log loss {loss:.5f}, at 0.7: {int(((p >= 0.7) & (y == 1)).sum())} of {int((y == 1).sum())} of label 1, {int(((p >= 0.7) & (y == 0)).sum())} of {int((y == 0).sum())} of label 0"


def of_quality(setting: dict) -> str:
    x, y, check = held["x"], held["y"], held["check"]
    projection, bias = quality.fit([x[i] for i in np.flatnonzero(~check)], y[~check], 11, **setting)
    prior = setting["prior"]
    p = np.array([1 / (1 + np.exp(-np.clip((projection[i] * n).sum() / (n.sum() + prior) + bias, -500, 500))) for i, n in (x[k] for k in np.flatnonzero(check))])
    return f"{setting}: {report(p, y[check])}"


def of_toxicity(setting: dict) -> str:
    x, y, check = held["x"], held["y"], held["check"]
    weights, bias = toxicity.fit([x[i] for i in np.flatnonzero(~check)], y[~check], 13, **setting)
    p = np.array([1 / (1 + np.exp(-np.clip(weights[x[k]].sum() + bias, -500, 500))) for k in np.flatnonzero(check)])
    return f"{setting}: {report(p, y[check])}"


held: dict = {}


def main(folder: str, *only: str) -> None:
    grids = {
        "quality": (4, 2, quality.SAMPLE, of_quality, [dict(epochs=e, start=r, prior=p) for e, r, p in product((5, 10), (2.0, 4.0, 8.0), (0, 30, 100, 300))]),
        "toxic": (3, 1, toxicity.SAMPLE, of_toxicity, [dict(alpha=a, l1=l, l2=m, epochs=e) for a, l, m, e in product((3.0, 10.0), (3.0, 6.0, 8.0, 10.0, 15.0), (0.1, 0.3, 1.0), (10,))]),
    }
    for label, (folds, fold, most, score, grid) in grids.items():
        if only and label not in only:
            continue
        ids, y, texts = rows(folder, label, folds, fold, most)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        x: list = []
        for a, b in slices(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if label == "quality":
                x += list(quality.counted(part, cuts))
            else:
                index, owner = toxicity.features(part, cuts)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                x += [index[i:j].astype(np.int32) for i, j in zip(at[:-1], at[1:])]
        held.update(x=x, y=y, check=np.array([zlib.crc32(f"{i} validate".encode()) % 5 == 0 for i in ids]))
        with ProcessPoolExecutor(8) as pool:
            for line in pool.map(score, grid):
                print(label, line, flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
