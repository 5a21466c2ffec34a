"""Substructure patterns as Spark expressions.

A pattern is compiled once, where the plan is made, to one SQL condition on a molecule's row: nested `exists` over the neighbours of
the atoms placed so far. Spark evaluates these in order and stops at the first atom that fits, which is a search with backtracking,
inside the row and without Python. No matches are listed, only whether there is one, as alerts need.

The language: organic atoms and * outside brackets; in brackets symbols, #number, *, a, A, charges, H, D, X, v, R, r (each with or
without a number) and $(pattern), joined by !, &, a comma and ; with their usual strength; bonds - = # : ~ @ with the same
operators; branches and ring closures. A bond that is not written is single or aromatic. Stereo marks, isotopes and patterns of
several parts are errors. Hydrogens that are written as atoms are part of their heavy atom, so [#1] finds none."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chemistry import NUMBERS

_ORGANIC = ("Cl", "Br", "B", "C", "N", "O", "P", "S", "F", "I")
_SMALL = ("se", "as", "te", "b", "c", "n", "o", "p", "s")
_BONDS = {"-": "{e}.bond = 'single'", "=": "{e}.bond = 'double'", "#": "{e}.bond = 'triple'", ":": "{e}.bond = 'aromatic'", "~": "true", "@": "{e}.ring"}
_UNWRITTEN = "{e}.bond in ('single', 'aromatic')"
#: Properties of an atom: the field that a number is compared with, the number that a bare letter means, or the bare letter's condition.
_COUNTS = {"H": ("hydrogens", "= 1"), "h": ("hydrogens", "> 0"), "D": ("degree", "= 1"), "v": ("valence", "= 1"), "R": ("rings", "> 0"), "r": ("smallest", "> 0")}


@dataclass
class _Pattern:
    """Conditions with {a} for an atom and {i} for its number; bonds from a later atom to an earlier one, with {e} for the bond."""

    atoms: list[str] = field(default_factory=list)
    bonds: list[list[tuple[int, str]]] = field(default_factory=list)


class _Text:
    def __init__(self, text: str, names) -> None:
        self.text, self.at, self.names = text, 0, names  # names: numbers for variables

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, *options: str) -> str | None:
        for o in options:
            if self.text.startswith(o, self.at):
                self.at += len(o)
                return o
        return None

    def number(self) -> int | None:
        m = re.compile(r"\d+").match(self.text, self.at)
        if m:
            self.at = m.end()
        return int(m.group()) if m else None

    def wrong(self) -> ValueError:
        return ValueError(f"pattern {self.text!r}, at {self.at}")


def _joined(t: _Text, one, ends) -> str:
    """Operators by strength: ! binds most, then & (or nothing), then the comma, then ;."""

    def unit() -> str:
        return f"not ({unit()})" if t.take("!") else one()

    def high() -> str:
        parts = [unit()]
        while t.take("&") or not (ends() or t.next() in (",", ";", "")):
            parts.append(unit())
        return " and ".join(parts)

    def middle() -> str:
        parts = [high()]
        while t.take(","):
            parts.append(high())
        return parts[0] if len(parts) == 1 else "(" + " or ".join(f"({p})" for p in parts) + ")"

    parts = [middle()]
    while t.take(";"):
        parts.append(middle())
    return " and ".join(parts)


def _symbol(symbol: str) -> str:
    small = symbol[0].islower()
    return f"{{a}}.symbol = '{symbol.capitalize()}' and {'' if small else 'not '}{{a}}.aromatic"


def _primitive(t: _Text) -> str:
    if t.take("$("):
        begin, depth = t.at, 1
        while depth:
            if not t.next():
                raise t.wrong()
            depth += {"(": 1, ")": -1}.get(t.next(), 0)
            t.at += 1
        return _rooted(_parsed(_Text(t.text[begin : t.at - 1], t.names)), t.names)
    if t.take("#"):
        return f"{{a}}.number = {_needed(t)}"
    if t.take("*"):
        return "true"
    for sign in "+-":
        if t.next() == sign:
            n = 0
            while t.take(sign):
                n += 1
            number = t.number()
            return f"{{a}}.charge = {'' if sign == '+' else '-'}{n if number is None else number}"
    if t.next() == "H" and not re.match(r"H[efgos]", t.text[t.at : t.at + 2]) or t.next() in "hDvRr" and not re.match(r"D[by]|R[abefghnu]", t.text[t.at : t.at + 2]):
        name, bare = _COUNTS[t.take(*_COUNTS)]
        number = t.number()
        return f"{{a}}.{name} {bare if number is None else f'= {number}'}"
    if t.next() == "X" and not t.text.startswith("Xe", t.at):
        t.take("X")
        number = t.number()
        return f"{{a}}.degree + {{a}}.hydrogens = {1 if number is None else number}"
    if symbol := t.take(*sorted((n for n in NUMBERS if len(n) == 2), reverse=True), *_SMALL[:3]):
        return _symbol(symbol)
    if t.take("a"):
        return "{a}.aromatic"
    if t.take("A"):
        return "not {a}.aromatic"
    if symbol := t.take(*(n for n in NUMBERS if len(n) == 1), *_SMALL[3:]):
        return _symbol(symbol)
    raise t.wrong()


def _needed(t: _Text) -> int:
    number = t.number()
    if number is None:
        raise t.wrong()
    return number


def _atom(t: _Text) -> str | None:
    if t.take("["):
        condition = _joined(t, lambda: _primitive(t), lambda: t.next() == "]")
        if not t.take("]"):
            raise t.wrong()
        return condition
    if symbol := t.take(*_ORGANIC, *_SMALL[3:]):
        return _symbol(symbol)
    if t.take("*"):
        return "true"
    if t.take("a"):
        return "{a}.aromatic"
    return "not {a}.aromatic" if t.take("A") else None


def _bond(t: _Text) -> str | None:
    if t.next() not in ("-", "=", "#", ":", "~", "@", "!"):
        return None

    def one() -> str:
        sign = t.take(*_BONDS)
        if not sign:
            raise t.wrong()
        return _BONDS[sign]

    return _joined(t, one, lambda: t.next() not in tuple(_BONDS) + ("!",))


def _parsed(t: _Text) -> _Pattern:
    out, stack, open_, last = _Pattern(), [], {}, None
    while t.next():
        if t.take("("):
            stack.append(last)
            continue
        if t.take(")"):
            if not stack:
                raise t.wrong()
            last = stack.pop()
            continue
        bond = _bond(t)
        digit = re.compile(r"%\d\d|\d").match(t.text, t.at)
        if digit:
            if last is None:
                raise t.wrong()
            t.at, key = digit.end(), digit.group().lstrip("%")
            if key in open_:
                other, known = open_.pop(key)
                out.bonds[last].append((other, bond or known or _UNWRITTEN))
            else:
                open_[key] = (last, bond)
            continue
        atom = _atom(t)
        if atom is None:
            raise t.wrong()
        out.atoms.append(atom)
        out.bonds.append([] if last is None else [(last, bond or _UNWRITTEN)])
        last = len(out.atoms) - 1
    if stack or open_ or not out.atoms:
        raise t.wrong()
    return out


def _rooted(p: _Pattern, names) -> str:
    """The condition that the pattern fits with its first atom at the atom whose number is {i}."""
    places = ["{i}"] + [f"e{next(names)}" for _ in p.atoms[1:]]
    at = lambda k: places[k] if k == 0 else f"{places[k]}.v"

    def step(k: int) -> str:
        if k == len(p.atoms):
            return ""
        (parent, bond), *closing = p.bonds[k]
        tests = [f"({bond.replace('{e}', places[k])})", f"({_of(p.atoms[k], at(k))})", *[f"{at(k)} <> {at(j)}" for j in range(k) if j != parent]]
        for other, closed in closing:
            x = f"e{next(names)}"
            tests.append(f"exists(near[{at(k)}], {x} -> {x}.v = {at(other)} and ({closed.replace('{e}', x)}))")
        more = step(k + 1)
        return f"exists(near[{at(parent)}], {places[k]} -> " + " and ".join(tests + [more] * bool(more)) + ")"

    more = step(1)
    return f"({p.atoms[0]})" + (f" and {more}" if more else "")


def _of(condition: str, number: str) -> str:
    return condition.replace("{a}", f"atoms[{number}]").replace("{i}", number)


def condition(pattern: str) -> str:
    """SQL that says whether a row with `atoms` and `near` holds the pattern; ValueError for other texts."""
    names = count()
    i = f"i{next(names)}"
    return f"exists(sequence(0, size(atoms) - 1), {i} -> {_of(_rooted(_parsed(_Text(pattern.strip(), names)), names), i)})"


def holds(pattern: str) -> Column:
    """Whether a molecule as `chemistry.molecules` gives it holds the pattern; those that could not be read hold none."""
    return F.expr(f"size(atoms) > 0 and {condition(pattern)}")


def alerts(parsed: DataFrame, rules: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """item and alert for every pattern that a molecule holds, with the columns `keep`: one pass over the rows, no join. parsed:
    molecules as `chemistry.molecules` gives them."""
    hits = F.filter(F.array(*[F.when(holds(p), F.lit(name)) for name, p in rules.items()]), lambda a: a.isNotNull())
    # An outer explode: of an inner one, Spark would search twice, first for whether there is a hit at all.
    return parsed.select(F.col("id").alias("item"), *(keep or []), F.explode_outer(hits).alias("alert")).where("alert is not null")
