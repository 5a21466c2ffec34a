"""Ids of a lower-casing word-end BPE vocabulary, computed for whole batches of text with numpy.

The vocabulary file belongs to the `tokenizers` library, whose ids these are. A batch is cut into pre-tokens by vector
operations, each distinct pre-token is merged once, and the ids are gathered back. Texts with characters outside the
checked ranges, or with the strings of special tokens, go through the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from ._common import ragged, run_hashes

SPACE, LETTER, NUMBER, OTHER, UNCHECKED = range(5)
#: Pre-tokens of more bytes than this go through the library, one by one.
LONGEST = 48
_NONE = np.int64(1 << 40)

_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """The vocabulary of a file, kept in this Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _classes() -> np.ndarray:
    table = np.full(0x110000, UNCHECKED, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(c))
        table[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return table


class WordBPE:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocab, merges = parts["model"]["vocab"], parts["model"]["merges"]
        self.specials = [t["content"] for t in parts["added_tokens"]]
        self.width = max(vocab.values()) + 1
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars, extra = {b: chr(b) for b in plain}, 0
        for b in range(256):
            if b not in chars:
                chars[b] = chr(256 + extra)
                extra += 1
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        bits = 18
        slot = self._slots(self.keys, bits)
        self.bits, self.first = bits, np.full(1 << bits, -1, np.int64)
        self.first_rank = np.full(1 << bits, _NONE, np.int64)
        self.crowded = np.zeros(1 << bits, bool)
        self.first[slot], self.first_rank[slot] = self.keys, self.ranks
        self.crowded[slot[self.first[slot] != self.keys]] = True
        self.kinds = _classes()

    @staticmethod
    def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or _NONE."""
        keys = left * self.width + right
        slot = self._slots(keys, self.bits)
        out = np.where(self.first[slot] == keys, self.first_rank[slot], _NONE)
        again = (out == _NONE) & self.crowded[slot]
        if again.any():
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            out[again] = np.where(self.keys[at] == keys[again], self.ranks[at], _NONE)
        return out

    def merged(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols: words of equal length, a row each. Their ids (a row each, the rest unused) and how many."""
        rows, width = symbols.shape
        out, sizes = np.zeros((rows, width), np.int64), np.full(rows, width, np.int64)
        live, now = np.arange(rows), symbols
        ranks = self.rank(now[:, :-1], now[:, 1:]) if width > 1 else np.zeros((rows, 0), np.int64)
        while width > 1 and len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            done = best == _NONE
            if done.any():
                out[live[done], :width], sizes[live[done]] = now[done], width
                keep = ~done
                live, now, ranks, at, best = live[keep], now[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
            row, width = np.arange(len(live)), width - 1
            take = np.arange(width) + (np.arange(width) > at[:, None])
            now = np.take_along_axis(now, take, axis=1)
            now[row, at] = self.made[best]
            if width > 1:
                step = np.arange(width - 1)
                ranks = np.take_along_axis(ranks, step + (step >= at[:, None]), axis=1)
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
                ranks[left, at[left] - 1] = self.rank(now[left, at[left] - 1], now[left, at[left]])
                ranks[right, at[right]] = self.rank(now[right, at[right]], now[right, at[right] + 1])
        if len(live):
            out[live, :width], sizes[live] = now, width
        return out, sizes

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as ranges of UTF-8 bytes: flat, and how many each word has."""
        sizes, parts, places = np.zeros(len(starts), np.int64), [], []
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            if n <= LONGEST:
                raw = data[starts[which][:, None] + np.arange(n)]
                symbols = self.inner[raw]
                symbols[:, -1] = self.final[raw[:, -1]]
                ids, count = self.merged(symbols)
                flat = ids[np.arange(n) < count[:, None]]
            else:
                found = [self.library.encode(data[s : s + n].tobytes().decode("utf-8"), add_special_tokens=False).ids for s in starts[which]]
                count, flat = np.array([len(x) for x in found], np.int64), np.concatenate([np.array(x, np.int64) for x in found])
            sizes[which] = count
            parts.append(flat)
            places.append(which)
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for flat, which in zip(parts, places):
            out[ragged(ends[which] - sizes[which], sizes[which])] = flat
        return out, sizes

    def encode(self, texts: list[str], last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32) and the offsets of the texts in them; `last`: an id to end each with."""
        ready, odd = [], {}
        for i, text in enumerate(texts):
            t = text if text.isascii() else unicodedata.normalize("NFC", text)
            if "<" in t and any(s in t for s in self.specials):
                odd[i] = None
                t = ""
            ready.append(t.lower())
        codes = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in ready], out=offsets[1:])
        kinds = self.kinds[codes]
        if (kinds == UNCHECKED).any():
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(kinds == UNCHECKED), side="right") - 1):
                odd[int(i)] = None
                kinds[offsets[i] : offsets[i + 1]] = SPACE
        for i in odd:
            odd[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int64)
        begins = self._begins(codes, kinds, offsets)
        starts = np.flatnonzero(begins & (kinds != SPACE))
        stops = np.append(np.flatnonzero(begins), len(codes))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        hashes = run_hashes(codes, starts, ends)
        _, firsts, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = ends[firsts] - starts[firsts]
        chosen = codes[ragged(starts[firsts], lengths)]
        data = np.frombuffer(chosen.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        octets = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum(octets)])[edges]
        ids, sizes = self.words(data, at[:-1], np.diff(at))
        # What is not a word is appended to the table of distinct words: the last id, and the texts of the library.
        tables, spans = [ids], list(sizes)
        places = np.searchsorted(starts, offsets)
        put, what = [], []
        for i, found in sorted(odd.items()):
            put.append(places[i])
            what.append(len(spans))
            spans.append(len(found))
            tables.append(found)
        if last is not None:
            put, what = [*put, *places[1:]], [*what, *[len(spans)] * len(texts)]
            spans.append(1)
            tables.append(np.array([last], np.int64))
        spans = np.array(spans, np.int64)
        heads, flat = np.concatenate([[0], np.cumsum(spans)]), np.concatenate(tables)
        order = inverse.reshape(-1)
        if put:
            # Stable by place and text: a text's own ids come before its last id, which comes before the next text's.
            text_of = np.concatenate([np.array(sorted(odd), np.int64), np.arange(len(texts)) if last is not None else np.zeros(0, np.int64)])
            sort = np.lexsort((np.array([0] * len(odd) + [1] * (len(put) - len(odd))), text_of))
            put, what = np.array(put)[sort], np.array(what)[sort]
            order = np.insert(order, put, what)
        out = flat[ragged(heads[order], spans[order])].astype("<u4")
        if put is not None and len(put):
            tokens_before = np.searchsorted(np.sort(text_of), np.arange(len(texts) + 1), side="left")
            cuts = places + tokens_before
        else:
            cuts = places
        totals = np.concatenate([[0], np.cumsum(spans[order])])
        return out, totals[cuts]

    @staticmethod
    def _begins(codes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where a pre-token or a stretch of white space begins."""
        n = len(codes)
        begins = np.ones(n, bool)
        if n == 0:
            return begins
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        begins[offsets[:-1][offsets[:-1] < n]] = True
        marks = np.flatnonzero((codes == 39) & begins)  # an apostrophe that opens a pre-token may open a contraction
        if len(marks):
            after = np.append(codes, [0, 0])
            stop = offsets[np.searchsorted(offsets, marks, side="right")]
            one, two = after[marks + 1], after[marks + 2]
            short = np.isin(one, [115, 116, 109, 100]) & (marks + 1 < stop)
            long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (marks + 2 < stop)
            for hit, size in ((short, 2), (long, 3)):
                found = marks[hit]
                begins[found + 1] = False
                tail = found + size
                begins[tail[tail < n]] = True
        return begins
