"""Repairs the structure of conversations with the cheapest edits: an optional system turn, then user and assistant in turn.

A repaired conversation has role initials `(s?(ua)+)?`. The grammar has four states (nothing yet, after system, after user, after
assistant), so the states from which a conversation can still end well at some cost are four bits. A turn's word holds these bits
for increasing cost, a layer of four bits for each unit; an edit of cost w moves a word up by w layers, and all layers of a turn are
worked out at once from those of the turn behind it. The first layer of the first turn that holds the start is the cost. Where a
trace of the bits has a choice, it takes the edit with the least letter, which gives the least audit.

States differ by at most SPAN in cost (two insertions lead from any state to any other, or a deletion stands in for a system turn),
so a word keeps SPAN + 2 layers above the turn's least cost; what lies above is as the highest layer.

Layout: rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over many tasks.
Conversations inside a range are repaired there. For those that reach over a range's end, the range gives the cost between any two
states, the driver links these (at most two small rows a range), and then the rows are streamed in order, a range at a time: their
hash can be had in order only. Nothing but a range of rows and the audit is held in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import fixed

#: Bits of the states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant turn leads to, whichever of the two fits.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPAN = 4
KEPT, ABOVE = SPAN + 2, 8
_LAYERS = int("1" * (KEPT + ABOVE), 16)
_ALL = (1 << 4 * (KEPT + ABOVE)) - 1
_WINDOW = (1 << 4 * KEPT) - 1
SPACES = " \t\n\x0b\x0c\r"
COUNTED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SUMMARY = [c.split()[0] for c in COUNTED.split(", ")]

Word = tuple[int, int]  # the least cost of any state, and the layers above it
Turn = tuple[str, str, str, bool, bool, int]  # role, text, initial, whether it must go, whether it is truncated, how often it comes


def _closed(bits: int) -> int:
    """With insertions: each adds a user or assistant turn for INSERT layers."""
    for _ in range(SPAN // INSERT + 1):
        bits |= (_forced(bits) << 4 * INSERT) & _ALL
    return bits


def _forced(bits: int) -> int:
    """The states from which a user or assistant turn leads into `bits`."""
    return ((bits >> USER) & _LAYERS) * 0b1011 | ((bits >> ASSISTANT) & _LAYERS) * 0b0100


def _held(bits: int, initial: str) -> int:
    """The states from which a turn with this initial leads into `bits`."""
    if initial == "u":
        return ((bits >> USER) & _LAYERS) * 0b1011
    if initial == "a":
        return ((bits >> ASSISTANT) & _LAYERS) * 0b0100
    return (bits >> SYSTEM) & _LAYERS if initial == "s" else 0


def _settled(base: int, bits: int) -> Word:
    empty = ((bits & -bits).bit_length() - 1) // 4
    return base + empty, (bits >> 4 * empty) & _WINDOW


def before(word: Word, initial: str, must_go: bool, truncated: bool, times: int = 1) -> Word:
    """The word in front of a turn from the word behind it; in front of `times` turns, if they must go."""
    base, bits = word[0] + DELETE * (times - 1), word[1]
    top = bits >> 4 * (KEPT - 1)
    bits |= (top * _LAYERS) << 4 * KEPT & _ALL
    made = bits << 4 * DELETE
    if not must_go:
        made |= (_held(bits, initial) | _forced(bits) << 4 * REROLE) << 4 * TRUNCATED * truncated
    return _settled(base, _closed(made & _ALL))


def word_of(costs: list[int | None]) -> Word:
    """The word of these costs of the states; None: no way."""
    base, bits = min(c for c in costs if c is not None), 0
    for state, c in enumerate(costs):
        if c is not None and c - base < KEPT + ABOVE:
            bits |= (_LAYERS << 4 * (c - base) & _ALL) << state
    return _settled(base, bits & _ALL)


def costs_of(word: Word) -> list[int | None]:
    base, bits = word
    out = []
    for state in range(4):
        own = (bits >> state) & _LAYERS
        out.append(base + ((own & -own).bit_length() - 1) // 4 if own else None)
    return out


#: Behind the last turn a conversation may end if nothing or an assistant turn is there; else insertions make it so.
END = _settled(0, _closed(_LAYERS << START | _LAYERS << ASSISTANT))


class Running:
    """A conversation as far as its rows have come: counts, state, audit and hash. Rows are (turn, role, text, last, copies, seen)."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.hash, self.written = START, 0, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.initial = None

    def faults(self, rows: list[tuple]) -> list[Turn]:
        """The turns of these rows, whose faults are counted; further copies of a row are one turn that must go some times."""
        out = []
        for turn, role, text, last, copies, seen in rows:
            if turn is not None and copies and turn != self.high:
                self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
            if not copies:
                continue
            initial = role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.illegal += copies - 1  # no role may follow itself
            self.initial = initial
            fine = bool(last) and not seen
            truncated = fine and last not in ".!?"
            gone = copies - fine
            self.truncated, self.blank, self.duplicate = self.truncated + truncated, self.blank + (0 if last else gone), self.duplicate + (gone if last else 0)
            if fine:
                out.append((role, text, initial, False, truncated, 1))
            if gone:
                out.append((role, text, initial, True, False, gone))
        return out

    def take(self, turns: list[Turn], end: Word, more: bool) -> list[tuple[int, str, str]]:
        """Goes through these turns by the least trace, to the costs `end` behind them; what the repaired conversation gets."""
        words = [end]
        for turn in reversed(turns):
            words.append(before(words[-1], *turn[2:]))
        costs = [costs_of(w) for w in reversed(words)]
        if not self.audit and not self.written and self.state == START:
            self.cost = costs[0][START]
        made, i, q = [], 0, self.state
        while i < len(turns) or not (more or q in (START, ASSISTANT)):
            here = costs[i][q]
            if i < len(turns):
                role, text, initial, _, truncated, times = turns[i]
                ahead = costs[i + 1]
                if DELETE * times + ahead[q] == here:
                    self.audit.append("D" * times)
                    i += 1
                    continue
            if INSERT + costs[i][NEXT[q]] == here:
                self.audit.append("I")
                q = NEXT[q]
                made.append((NAME[q], ""))
                continue
            to = SYSTEM if initial == "s" and q == START else NEXT[q] if initial == NAME[NEXT[q]][0] else None
            if to is not None and TRUNCATED * truncated + ahead[to] == here:
                self.audit.append("K")
                q = to
                made.append((role, text))
            else:
                self.audit.append("R")
                q = NEXT[q]
                made.append((NAME[q], text))
            i += 1
        self.state, out = q, []
        for role, text in made:
            self.hash.update(("\n" * (self.written > 0) + f"{role}:{text}").encode())
            out.append((self.written, role, text))
            self.written += 1
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _fields(text: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(text))


def _conversations(batches: Iterator[pa.RecordBatch], key: list[str], fields: list[str]) -> Iterator[tuple[tuple, list[tuple], bool, bool]]:
    """Neighbouring rows with the same key, whether they are the first in the task, and whether the last."""

    def rows() -> Iterator[tuple[tuple, tuple]]:
        for batch in batches:
            own = [[batch.column(n).to_pylist() for n in names] for names in (key, fields)]
            yield from zip(zip(*own[0]), zip(*own[1]))

    first, held = True, None
    for k, group in groupby(rows(), key=lambda r: r[0]):
        if held:
            yield *held, first, False
            first = False
        held = k, [r[1] for r in group]
    if held:
        yield *held, first, True


ROW = ["turn", "role", "text", "last", "copies", "seen"]


def _repaired_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations that lie within the task, repaired; of others the costs from each state to each. A range's number is that of
    its rows."""
    for (conv,), rows, first, last in _conversations(batches, ["conv_id"], ["at", *ROW]):
        place, turns = rows[0][0] >> 33, Running()
        found = turns.faults([r[1:] for r in rows])
        if first or last:
            ways: list[int | None] = []
            for end in range(4):
                word = _settled(0, _closed(_LAYERS << end))
                for turn in reversed(found):
                    word = before(word, *turn[2:])
                ways += costs_of(word)
            yield conv, place, ways, *[None] * len(SUMMARY)
        else:
            turns.take(found, END, more=False)
            yield conv, place, None, *turns.summary()


def _repaired_across(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations whose rows come in order, a range at a time, with the costs behind each range."""
    for conv, turns, _ in _streamed(batches):
        if turns:
            yield conv, None, None, *turns.summary()


def _repaired_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, _, made in _streamed(batches):
        yield from ((conv, *m) for m in made)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, nothing and what a range adds to the repaired form; behind the last range conv_id, what is counted, and nothing."""
    turns, conv = None, None
    for (key, base, bits, _), rows, _, _ in _conversations(batches, ["conv_id", "base", "bits", "p"], ROW):
        if turns is None or key != conv:
            if turns is not None:
                yield conv, turns, []
            turns, conv = Running(), key
        end = END if base is None else (base, bits)
        yield conv, None, turns.take(turns.faults(rows), end, more=end != END)
    if turns is not None:
        yield conv, turns, []


def _in_batches(make, kinds: pa.Schema):
    """make's rows as Arrow batches of these types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make(batches)
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kinds)], schema=kinds)

    return run


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after damage, chosen by crc32 of `conv_id:turn` modulo 20; copies is how often a row is there:
    0 (dropped; role and text null), 1 or 2. Nulls of role and text are one space, and so are nulls in the hashed text; a null
    turn stays null. Other columns are left out."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), (F.crc32(key) % 20).alias("kind"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).when(F.col("kind") != 0, F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).when(F.col("kind") != 0, F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, whether role and text came in an earlier turn (seen), the last character that is no
    separator (last), and a number by which they are in order (at; its high bits are the range's number)."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("int").alias("copies"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    once = once.select("*", digest.alias("digest"))
    many = once.where("digest is not null").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    found = once.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    seen = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = found.select("conv_id", "turn", "role", "text", last.alias("last"), "copies", seen.alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)
    return fixed(dealt).withColumn("at", F.monotonically_increasing_id())


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """Of every conversation its gaps, faults, cost, audit and the hash of its repaired form; turns: the repaired form itself, as
    rows conv_id, position (from 0), role, text.

    rows: conv_id, turn, role, text, copies (as `damage` gives them; other columns are passed over). Rows are taken by turn, nulls
    first, then by role and text; equal rows count as often as they come. Conversations without rows (copies 0) and those of which
    nothing is left have an empty audit and the hash of no text. A null conv_id is a conversation of its own. Differences of turns
    are counted modulo 2^64. An empty table gives an empty result."""
    kind = rows.schema["conv_id"].dataType
    one = T.StructType([T.StructField("conv_id", kind)])
    found = T.StructType([*one, *_fields("place long, ways array<long>, " + COUNTED)])
    ordered = _ordered(rows.select("conv_id", "turn", "role", "text", "copies"))
    inside = fixed(ordered.mapInArrow(_in_batches(_repaired_inside, to_arrow_schema(found)), found))
    across: dict = {}
    for r in sorted(inside.where("ways is not null").select("conv_id", "place", "ways").collect(), key=lambda r: r["place"]):
        across.setdefault(r["conv_id"], []).append(r)  # at most two rows a range
    ends = []
    for conv, pieces in across.items():
        word = END
        for r in reversed(pieces):
            ends.append((conv, r["place"], *word))
            there = costs_of(word)
            ways = [[r["ways"][4 * end + start] for end in range(4)] for start in range(4)]
            word = word_of([min((w + t for w, t in zip(row, there) if w is not None and t is not None), default=None) for row in ways])
    known = rows.sparkSession.createDataFrame(ends, T.StructType([T.StructField("c", kind), *_fields("p long, base long, bits long")]))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("at", 33) == F.col("p"))
    streamed = ordered.join(F.broadcast(known), on, "left" if turns else "inner").drop("c").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    if turns:
        made = T.StructType([*one, *_fields("position long, role string, text string")])
        return streamed.mapInArrow(_in_batches(_repaired_turns, to_arrow_schema(made)), made)
    done = streamed.mapInArrow(_in_batches(_repaired_across, to_arrow_schema(found)), found)
    return inside.where("ways is null").unionByName(done).drop("place", "ways")
