"""Benchmark passages in documents, up to a share of edited words.

Texts and items are sequences of words (runs of letters and digits, A-Z lower-cased). A passage of a document matches an
item of n words if their word edit distance is at most EDITS * n. Windows of the size of an item are embedded by random
walks that keep or advance the place in the window depending on the word there (CGK), which turns a small edit distance
into a small Hamming distance; each walk is sampled at few places, several times, and windows meet items whose samples
are equal. WALKS times SAMPLES chances give the recall. What meets is verified by the exact edit distance.

Only windows that can match are embedded. A window that matches an item keeps all but EDITS * n of its words, so it
must hold that many words that occur in items at all, and enough of the words that occur in few items. Both conditions
are necessary for a match, so they lose none.

The items are broadcast in batches of BATCH_WORDS words at most, a pass over the documents for each batch.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_TABLE, WORD_TABLE, annotated, column, mixed, ragged, run_hashes, text_slices, unused, words

EDITS = 0.2
#: Items of fewer words must match word by word; those of even fewer are phrases of any text, so a text must equal them.
LEAST_WORDS, LEAST_PASSAGE = 8, 3
WALKS, SAMPLES, PLACES = 3, 10, 3
#: A word that at most so many items hold counts as rare.
RARE = 4
BATCH_WORDS = 1_000_000
SEED = 17


def allowed(n: int) -> int:
    return int(EDITS * n + 1e-9) if n >= LEAST_WORDS else 0


#: Code points (first, last) of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, Tai, kana and Han.
UNSPACED = [(0xE00, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
#: Their punctuation, which separates words.
MARKS = [(0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x3036, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the characters of UNSPACED, and the bytes of MARKS."""
    heads = np.flatnonzero(data >= 0xE0)
    if not len(heads):
        return heads, heads, heads
    size = np.where(data[heads] >= 0xF0, 4, 3)
    code = (data[heads] & np.where(size == 4, 0x07, 0x0F)).astype(np.int64)
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | data[np.minimum(heads + k, len(data) - 1)] & 0x3F, code)

    def among(ranges: list[tuple[int, int]]) -> np.ndarray:
        first, last = np.array(ranges).T
        at = np.searchsorted(first, code, "right") - 1
        return (at >= 0) & (code <= last[at])

    mark = among(MARKS)
    own = among(UNSPACED) & ~mark
    return heads[own], (heads + size)[own], ragged(heads[mark], size[mark])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (never 0), their starts and ends in the data, and each text's place among them."""
    data = LOWER_TABLE[data]
    inside = WORD_TABLE[data]
    first, last, marks = _unspaced(data)
    inside[marks] = False
    starts, ends, _ = words(data, np.unique(np.concatenate([offsets, first, last])) if len(first) else offsets, inside)
    places = np.searchsorted(starts, offsets)
    return np.maximum(run_hashes(data, starts, ends), 1), starts, ends, places


def walk(symbols: np.ndarray, starts: np.ndarray, n: int, steps: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What the walk over each window of n symbols shows at the given places: one row for each window.

    steps: an odd multiplier for each of the 3 n steps, whose product with a symbol decides whether to go on."""
    out = np.zeros((len(starts), len(places)), np.uint64)
    where, at, end = {int(j): k for k, j in enumerate(places)}, starts.copy(), starts + n
    for j in range(int(places.max()) + 1):
        inside = at < end
        symbol = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.uint64(0))
        if j in where:
            out[:, where[j]] = symbol
        at += ((symbol * steps[j]) >> np.uint64(63)).astype(np.int64)
    return out


class Size:
    """The items of one length: the conditions on windows and the sampled walks."""

    def __init__(self, n: int, items: list[tuple[int, np.ndarray]], rarity: Counter) -> None:
        rng = np.random.default_rng([SEED, n])
        self.n, self.keep = n, n - allowed(n)
        self.rare = max(0, min(sum(rarity[h] <= RARE for h in h_.tolist()) for _, h_ in items) - allowed(n))
        self.items = items
        symbols = np.concatenate([h for _, h in items])
        starts = np.arange(len(items)) * n
        self.walks, self.whole = [], None
        if not allowed(n):  # equal windows are all there is to find
            signature = self.sums(symbols, starts)
            order = np.argsort(signature, kind="stable")
            self.whole = signature[order], order
        for _ in range(WALKS if allowed(n) else 0):
            steps = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            # Walks are alike at their beginning for longer than at their end; the end may be padding, so the first 2 n.
            samples = np.stack([rng.choice(2 * n, PLACES, replace=False) for _ in range(SAMPLES)])
            places = np.unique(samples)
            factors = rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            line = (steps, places, np.searchsorted(places, samples), factors)
            tables = []
            for signature in self.signatures(symbols, starts, line).T:
                order = np.argsort(signature, kind="stable")
                tables.append((signature[order], order))
            self.walks.append((line, tables))

    def signatures(self, symbols: np.ndarray, starts: np.ndarray, line: tuple) -> np.ndarray:
        steps, places, samples, factors = line
        shown = walk(symbols, starts, self.n, steps, places)
        return np.stack([mixed((shown[:, s] * factors).sum(axis=1, dtype=np.uint64)) for s in samples], axis=1)

    def sums(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of each whole window."""
        total = np.zeros(len(starts), np.uint64)
        for k in range(self.n):
            total = mixed(total + symbols[starts + k])
        return total

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pairs (item, start) that agree in a sample of a walk, or as a whole where no edit is allowed; each once, in order."""
        found = []
        for a in range(0, len(starts), 1 << 16):
            part = starts[a : a + (1 << 16)]
            tests = [(self.sums(symbols, part)[None], [self.whole])] if self.whole else ((self.signatures(symbols, part, line).T, tables) for line, tables in self.walks)
            for signatures, tables in tests:
                for signature, (known, order) in zip(signatures, tables):
                    low, high = np.searchsorted(known, signature, "left"), np.searchsorted(known, signature, "right")
                    hit = np.flatnonzero(high > low)
                    if len(hit):
                        count = high[hit] - low[hit]
                        found.append(np.stack([order[ragged(low[hit], count)], np.repeat(part[hit], count)], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


class Items:
    """A batch of benchmark items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        texts = [(text or "").encode() for _, text in rows]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, _, _, places = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
        by_size, rarity = defaultdict(list), Counter()
        for k, (item, _) in enumerate(rows):
            own = hashes[places[k] : places[k + 1]]
            if len(own):
                by_size[len(own)].append((item, own))
                rarity.update(set(own.tolist()))
        self.vocabulary = np.array(sorted(rarity), np.uint64)
        self.is_rare = np.array([rarity[h] <= RARE for h in sorted(rarity)], bool)
        self.sizes = [Size(n, items, rarity) for n, items in sorted(by_size.items())]
        for size in self.sizes:  # which words of the vocabulary are rare ones of items of this size
            size.own = np.isin(self.vocabulary, np.concatenate([h for _, h in size.items])) & self.is_rare
        self.gap = max([allowed(s.n) for s in self.sizes], default=0) + 1
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def marks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Running counts of the words that occur in items, and of the rare ones; the places of the rare ones, and which
        word of the vocabulary each is."""
        maybe = np.flatnonzero(self.first[(symbols >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, symbols[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == symbols[maybe]
        known, rare = np.zeros(len(symbols) + 1, np.int32), np.zeros(len(symbols) + 1, np.int32)
        known[1:][maybe[hit]] = 1
        rare[1:][maybe[hit]] = self.is_rare[at[hit]]
        which = self.is_rare[at] & hit
        return np.cumsum(known, dtype=np.int32), np.cumsum(rare, dtype=np.int32), maybe[which], at[which]

    def search(self, hashes: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Matches (text, item, first word, words, edits) in texts given by their words' hashes."""
        if not self.sizes or not len(hashes):
            return []
        # Texts one after another with gaps that no matching window can span.
        text = np.repeat(np.arange(len(places) - 1), np.diff(places))
        spot = np.arange(len(hashes)) + (text + 1) * self.gap
        symbols = np.zeros(len(hashes) + len(places) * self.gap, np.uint64)
        symbols[spot] = hashes
        known, rare, rare_at, rare_word = self.marks(symbols)
        found = []
        for size in self.sizes:
            n = size.n
            if len(symbols) < n:
                continue
            fits = known[n:] - known[:-n] >= size.keep
            if size.rare:
                fits &= rare[n:] - rare[:-n] >= size.rare
            starts = np.flatnonzero(fits)
            if n < LEAST_PASSAGE:
                alone = np.isin(starts, spot[places[:-1][np.diff(places) == n]])
                starts = starts[alone]
            if size.rare and len(starts):
                own = rare_at[size.own[rare_word]]
                starts = starts[np.searchsorted(own, starts + n) - np.searchsorted(own, starts) >= size.rare]
            if not len(starts):
                continue
            pairs = size.candidates(symbols, starts)
            k = allowed(n)
            a = 0
            while a < len(pairs):  # neighbouring windows of an item are one region
                b = a + 1
                while b < len(pairs) and pairs[b, 0] == pairs[a, 0] and pairs[b, 1] - pairs[b - 1, 1] < n:
                    b += 1
                item, own = size.items[pairs[a, 0]]
                low, high = max(0, int(pairs[a, 1]) - k), min(len(symbols), int(pairs[b - 1, 1]) + n + k)
                # A region may run over the bounds of texts; each text's share of its words is searched by itself.
                first, last = np.searchsorted(spot, [low, high])
                for t in range(int(text[first]), int(text[last - 1]) + 1) if last > first else ():
                    base = int(max(first, places[t]))
                    for start, end, edits in matches(own, hashes[base : int(min(last, places[t + 1]))], k):
                        found.append((t, item, base + start - int(places[t]), end - start, edits))
                a = b
        return found


def _ends(pattern: np.ndarray, text: np.ndarray, free: bool) -> Iterator[tuple[int, int]]:
    """After each symbol of the text: how many symbols were read, and the least edit distance of the pattern to a stretch
    that ends there (free: starting anywhere; else: at the first). Bit-parallel, one step a symbol."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, h in enumerate(pattern.tolist()):
        masks[h] = masks.get(h, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for j, h in enumerate(map(int, text), 1):
        eq = masks.get(h, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus = full & (plus << 1) | (0 if free else 1)
        minus = full & (minus << 1)
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        yield j, score


def best_match(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the stretch nearest to the pattern, the first of several, if within `most` edits."""
    end, edits = min(_ends(pattern, text, True), key=lambda x: (x[1], x[0]), default=(0, most + 1))
    return None if edits > most else (end - _reach(pattern, text[:end], edits), end, edits)


def _reach(pattern: np.ndarray, text: np.ndarray, edits: int) -> int:
    """The length of the shortest stretch at the end of the text that is so many edits from the pattern."""
    return next(j for j, score in _ends(pattern[::-1], text[::-1], False) if score == edits)


def matches(pattern: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the stretches within `most` edits of the pattern, in order and without overlap: of stretches
    that overlap the nearest, the first of several. The search goes on before and after each."""
    least, at = len(pattern) - most, 0
    while len(text) - at >= least:
        end, edits = 0, most + 1
        for j, score in _ends(pattern, text[at:], True):
            if score < edits:
                end, edits = j, score
            # Stretches that end later don't overlap this one, or only one that the rest of the text may hold.
            if edits <= most and j - end >= least - 1:
                break
        if edits > most:
            return
        start = end - _reach(pattern, text[at : at + end], edits)
        yield from ((at + a, at + b, c) for a, b, c in matches(pattern, text[at : at + start], most))
        yield at + start, at + end, edits
        at += end


def batches_of(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in batches of about BATCH_WORDS words at most, counted as the search does: a character of a script without spaces
    is a word."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    alone = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED) + "]"
    own = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", alone, ""))
    size = items.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]
    count = max(1, -(-size // BATCH_WORDS))
    for k in range(count):
        yield sorted((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect())


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each passage of a document that matches an item: doc_id, item_id, first_word (from 0), words, edits.

    Overlapping stretches of a document that match an item are one passage, the nearest; others are a row each. Null or empty texts match nothing;
    items without words, or with a null id, take no part; repeated rows of documents each give their matches;
    repeated items count once. Empty tables give no rows.
    """
    rows, found = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), None
    for part in batches_of(benchmark, item_id, item_text):
        one = rows.mapInArrow(_searcher(documents.sparkSession.sparkContext.broadcast(part)), "doc_id long, item_id long, first_word long, words long, edits long")
        found = one if found is None else found.unionByName(one)
    return found


def _searcher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value)
        for batch, data, offsets in text_slices(batches):
            hashes, _, _, places = word_hashes(data, offsets)
            found = items.search(hashes, places)
            if found:
                doc, item, first, count, edits = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, (item, first, count, edits))], names=["doc_id", "item_id", "first_word", "words", "edits"])

    return run


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that hold no passage of an item; null and empty texts stay."""
    columns, left = documents.columns, documents
    (name,) = unused(columns, "passages")
    for part in batches_of(benchmark):
        held, ready = documents.sparkSession.sparkContext.broadcast(part), []

        def compute(rows: int, data: np.ndarray, offsets: np.ndarray, held=held, ready=ready) -> list[pa.Array]:
            if not ready:  # once in a task
                ready.append(Items(held.value))
            hashes, _, _, places = word_hashes(data, offsets)
            count = np.zeros(rows, np.int64)
            for match in ready[0].search(hashes, places):
                count[match[0]] += 1
            return [pa.array(count)]

        left = annotated(left, columns, text, [T.StructField(name, T.LongType())], compute).where(column(name) == 0).select(*map(column, columns))
    return left
