"""Molecules as text: a SMILES parser with ring and aromaticity perception, valence checks, rule-of-five properties and scaffolds.

Only what text and valences tell is computed. The logarithm of the partition coefficient and the synthetic accessibility
score are left null; a check that lacks its number passes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rings

# Masses.
MASSES = {"H": 1.008, "Li": 6.941, "B": 10.811, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.086, "P": 30.974, "S": 32.06, "Cl": 35.453, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Cu": 63.546, "Zn": 65.38, "As": 74.922, "Se": 78.971, "Br": 79.904, "Sn": 118.710, "Te": 127.60, "I": 126.904, "Hg": 200.592, "Pb": 207.2}
# Atomic numbers of the same elements.
NUMBERS = {"H": 1, "Li": 3, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "P": 15, "S": 16, "Cl": 17, "K": 19, "Ca": 20, "Fe": 26, "Cu": 29, "Zn": 30, "As": 33, "Se": 34, "Br": 35, "Sn": 50, "Te": 52, "I": 53, "Hg": 80, "Pb": 82}
# Valences of atoms without charge; implicit hydrogens fill up to the least that holds the bonds.
FILLED = {"H": (1,), "B": (3,), "C": (4,), "N": (3,), "O": (2,), "F": (1,), "Si": (4,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1,), "As": (3, 5), "Se": (2, 4, 6), "Br": (1,), "Te": (2, 4, 6), "I": (1, 3, 5)}
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5, "/": 1.0, "\\": 1.0}
NAMES = {1.0: "single", 2.0: "double", 3.0: "triple", 1.5: "aromatic"}
_TOKEN = re.compile(r"(\[[^\]]+\]|Br|Cl|[BCNOPSFI*]|[bcnops]|[-=#:/\\.()]|%\d\d|%\(\d+\)|\d)")
_BRACKET = re.compile(r"\[(\d*)(\*|[A-Z][a-z]?|se|as|te|[bcnops])(@{0,2})(H\d*)?([+-]+\d*|[+-]\d+)?(?::\d+)?\]$")
#: Rule-of-five limits, all strict, and the limit of the accessibility score.
MASS, LOGP, ACCEPTORS, DONORS, ACCESS = 500.0, 5.0, 10, 5, 6.0

ATOM = "symbol: string, aromatic: boolean, charge: int, hydrogens: int, number: int, degree: int, valence: int, rings: int, smallest: int"
SCHEMA = f"id long, ok boolean, atoms array<struct<{ATOM}>>, bonds array<struct<u: int, v: int, bond: string, ring: boolean>>, near array<array<struct<v: int, bond: string, ring: boolean>>>, note string"


def _read(text: str | None) -> tuple[list[list], dict[tuple[int, int], float | None]]:
    """Atoms (symbol, whether written as aromatic, charge, hydrogens or None, isotope) and bonds (order, or None if not written)."""
    if not text or not text.strip():
        raise ValueError("empty")
    text = text.strip()
    atoms: list[list] = []
    bonds: dict[tuple[int, int], float | None] = {}
    stack, open_, last, order, at = [], {}, None, None, 0
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            raise ValueError("unknown_text")
        at, t = m.end(), m.group(1)
        if t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                raise ValueError("unbalanced_branch")
            last = stack.pop()
        elif t == ".":
            last = None
        elif t in ORDERS:
            order = ORDERS[t]
        elif t[0].isdigit() or t[0] == "%":
            if last is None:
                raise ValueError("ring_without_atom")
            t = str(int(re.sub(r"\D", "", t)))
            if t in open_:
                other, known = open_.pop(t)
                pair = (min(other, last), max(other, last))
                if other == last or pair in bonds:
                    raise ValueError("bad_ring")
                bonds[pair] = order or known
            else:
                open_[t] = (last, order)
            order = None
        else:
            hydrogens, charge, symbol, isotope = None, 0, t, ""
            if t[0] == "[":
                b = _BRACKET.match(t)
                if not b:
                    raise ValueError("bad_bracket")
                isotope, symbol, hydrogens = b.group(1), b.group(2), int(b.group(4)[1:] or 1) if b.group(4) else 0
                sign = b.group(5) or ""
                charge = (1 if "+" in sign else -1) * int(re.sub(r"\D", "", sign) or len(sign)) if sign else 0
            small = symbol[0].islower()
            symbol = symbol.capitalize()
            atoms.append([symbol if symbol in MASSES else "*", small, charge, 0 if symbol == "*" else hydrogens, isotope])
            if last is not None:
                bonds[(last, len(atoms) - 1)] = order
            last, order = len(atoms) - 1, None
    if at != len(text) or stack or open_ or not atoms:
        raise ValueError("incomplete")
    return _without_hydrogens(atoms, bonds)


def _without_hydrogens(atoms: list[list], bonds: dict) -> tuple[list[list], dict]:
    """Hydrogens that are written as atoms of their own become a number at the heavy atom they are bound to."""
    ends: dict[int, list[int]] = {}
    for u, v in bonds:
        ends.setdefault(u, []).append(v)
        ends.setdefault(v, []).append(u)
    gone = {i for i, a in enumerate(atoms) if a[0] == "H" and not a[2] and not a[4] and not a[3] and len(ends.get(i, [])) == 1 and atoms[ends[i][0]][0] != "H"}
    if not gone:
        return atoms, bonds
    for i in gone:
        if atoms[ends[i][0]][3] is not None:
            atoms[ends[i][0]][3] += 1
    place = {i: k for k, i in enumerate(i for i in range(len(atoms)) if i not in gone)}
    return [a for i, a in enumerate(atoms) if i not in gone], {(place[u], place[v]): o for (u, v), o in bonds.items() if u not in gone and v not in gone}


def _limits(symbol: str, charge: int) -> tuple[int, ...]:
    """The valences that an atom may have; none if they are not known. A charge makes an atom like its neighbour in the table."""
    if symbol not in FILLED or abs(charge) > 1:
        return ()
    if charge == 0:
        return FILLED[symbol]
    if symbol in ("C", "Si", "H"):
        return tuple(v - 1 for v in FILLED[symbol])
    return tuple(v - charge if symbol == "B" else v + charge for v in FILLED[symbol])


def perceive(text: str | None) -> tuple[list[tuple], list[tuple[int, int, float, bool]]]:
    """Atoms (symbol, aromatic, charge, hydrogens, atomic number, degree, valence, rings, size of the smallest ring or 0) and bonds
    (u, v, order, whether in a ring); ValueError for text that is no SMILES or breaks valences.

    Lower-case atoms are first given double bonds (one each for those with a bond to spare, by a perfect pairing along their ring
    bonds); then aromaticity is told from rings and electrons, so both ways to write a ring come to the same. Aromatic bonds have
    the order 1.5. An atom's valence counts its bonds with the double bonds in place, and its hydrogens. Groups of a five-valent
    nitrogen without charge (N(=O)=O, N=N#N) become the charged forms."""
    atoms, known = _read(text)
    bonds, n = sorted(known), len(atoms)
    near = rings.neighbours(n, bonds)
    inside = rings.ring_bonds(near)
    soft = {k for k, b in enumerate(bonds) if all(atoms[i][1] for i in b) and (known[b] == 1.5 or known[b] is None and k in inside)}
    order = [1 if k in soft else int(known[b] or 1) for k, b in enumerate(bonds)]
    if any(known[b] == 1.5 and k not in soft for k, b in enumerate(bonds)):
        raise ValueError("aromatic_bond_outside_a_ring")
    need = set()
    for i, (symbol, small, charge, hydrogens, _) in enumerate(atoms):
        if small:
            if symbol not in rings.AROMATIC_VALENCE or not near[i].keys() or not any(k in inside for k in near[i].values()):
                raise ValueError("aromatic_atom_outside_a_ring")
            own = rings.AROMATIC_VALENCE[symbol]
            own = own - abs(charge) if symbol == "C" else own - charge if symbol == "B" else own + charge
            if sum(order[k] for k in near[i].values()) + (hydrogens or 0) < own:
                need.add(i)
    along = {i: {j for j, k in near[i].items() if k in soft and j in need} for i in need}
    pairs = rings.double_bonds(need, along)
    if pairs is None:
        raise ValueError("kekulize")
    for i, j in pairs:
        order[near[i][j]] = 2
    _charged(atoms, near, order)
    for i, a in enumerate(atoms):
        total, limits = sum(order[k] for k in near[i].values()), _limits(a[0], a[2])
        if a[3] is None:
            a[3] = next((v - total for v in limits if v >= total), 0)
        if limits and total + a[3] > max(limits):
            raise ValueError(f"valence_of_{a[0]}")
    circles = rings.smallest_rings(near, bonds, inside)
    of_atoms, of_bonds = rings.aromatic([(a[0], a[2], a[3]) for a in atoms], near, bonds, order, inside, circles)
    sizes: list[list[int]] = [[] for _ in atoms]
    for ring in circles:
        for i in {i for k in ring for i in bonds[k]}:
            sizes[i].append(len(ring))
    out = [
        (a[0], i in of_atoms, a[2], a[3], NUMBERS.get(a[0], 0), len(near[i]), sum(order[k] for k in near[i].values()) + a[3], len(sizes[i]), min(sizes[i], default=0))
        for i, a in enumerate(atoms)
    ]
    return out, [(u, v, 1.5 if k in of_bonds else float(order[k]), k in inside) for k, (u, v) in enumerate(bonds)]


def _charged(atoms: list[list], near: list[dict[int, int]], order: list[int]) -> None:
    """Five-valent nitrogens without charge: a double bond to an oxygen becomes single, or a triple bond to a nitrogen double, and
    the two atoms take charges."""
    for i, a in enumerate(atoms):
        if a[0] == "N" and a[2] == 0 and sum(order[k] for k in near[i].values()) + (a[3] or 0) == 5:
            for symbol, bond in (("O", 2), ("N", 3)):
                ends = [(j, k) for j, k in near[i].items() if atoms[j][0] == symbol and atoms[j][2] == 0 and order[k] == bond and len(near[j]) == 1]
                if ends:
                    j, k = ends[0]
                    order[k], a[2], atoms[j][2], atoms[j][3] = bond - 1, 1, -1, 0
                    break


def parse(text: str | None) -> tuple[list[tuple[str, bool, int, int]], list[tuple[int, int, float]]]:
    """Atoms (symbol, aromatic, charge, hydrogens) and bonds (u, v, order) as `perceive` finds them."""
    atoms, bonds = perceive(text)
    return [a[:4] for a in atoms], [b[:3] for b in bonds]


def scaffold(atoms: list, bonds: list) -> str:
    """A key of the rings, what links them, and what hangs on them by a double bond. Empty without rings. Two molecules have the
    same key if and only if their cores are the same but for the numbering (the key is a digest of the core's canonical form)."""
    near: dict[int, dict[int, float]] = {i: {} for i in range(len(atoms))}
    for u, v, o in (b[:3] for b in bonds):
        near[u][v] = near[v][u] = o
    core = {i: dict(n) for i, n in near.items()}
    leaves = [i for i, n in core.items() if len(n) < 2]
    while leaves:
        i = leaves.pop()
        for j in core.pop(i, {}):
            if j in core:
                core[j].pop(i, None)
                if len(core[j]) < 2:
                    leaves.append(j)
    if not core:
        return ""
    kept = core.keys() | {j for i in core for j, o in near[i].items() if o == 2.0}
    place = {i: k for k, i in enumerate(sorted(kept))}
    form = rings.canonical([atoms[i][:3] for i in sorted(kept)], {(place[i], place[j]): o for i in kept for j, o in near[i].items() if i < j and j in kept})
    return f"{len(kept)}:{hashlib.sha256(repr(form).encode()).hexdigest()[:32]}"


def molecules(df: DataFrame, id_: str, smiles: str, keep: list[str] | None = None) -> DataFrame:
    """id, ok, atoms, bonds, near (for each atom those bound to it), note and scaffold of every row, and the columns `keep`; text that
    can't be read or breaks valences is not ok, and has none of these."""
    keep = keep or []
    names = [c.split()[0] for c in re.sub(r"<.*?>+", "", SCHEMA).split(", ")] + ["scaffold"]
    fields = [f.split(":")[0] for f in ATOM.split(", ")]

    def row(text: str | None) -> tuple:
        try:
            atoms, bonds = perceive(text)
        except ValueError as problem:
            return False, [], [], [], str(problem), ""
        near: list[list[dict]] = [[] for _ in atoms]
        for u, v, o, r in bonds:
            near[u].append({"v": v, "bond": NAMES[o], "ring": r})
            near[v].append({"v": u, "bond": NAMES[o], "ring": r})
        return True, [dict(zip(fields, a)) for a in atoms], [{"u": u, "v": v, "bond": NAMES[o], "ring": r} for u, v, o, r in bonds], near, "", scaffold(atoms, bonds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(key, *row(text)) for key, text in zip(pdf["id"], pdf["smiles"])], columns=names).join(pdf[keep])

    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(smiles).cast("string").alias("smiles"), *keep)
    more = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, f"{SCHEMA}, scaffold string{more}")


def of_texts(df: DataFrame, id_: str, smiles: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id of every row, and what `compute` tells of its text. compute: from `molecules`, with the column text kept, to columns that
    include text. A text is read once, however many rows have it: nothing but the texts and what is told of them shuffles."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(smiles).cast("string").alias("text"))
    # Few bytes, but each text takes a while: spread over all tasks rather than by size.
    texts = rows.select("text").distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text")
    found = compute(molecules(texts.select(F.lit(0).alias("id"), "text"), "id", "text", keep=["text"])).drop("id").withColumnRenamed("text", "__text")
    return rows.join(found, F.col("text").eqNullSafe(F.col("__text"))).drop("text", "__text")


def _with_properties(parsed: DataFrame) -> DataFrame:
    mass = F.create_map(*[F.lit(x) for s, m in MASSES.items() for x in (s, m)])
    own = lambda a: F.coalesce(F.try_element_at(mass, a["symbol"]), F.lit(0.0)) + a["hydrogens"] * F.lit(1.008)
    hetero = lambda a: a["symbol"].isin("N", "O")
    out = parsed.select(
        "*",
        F.aggregate("atoms", F.lit(0.0), lambda acc, a: acc + own(a)).alias("mw"),
        F.lit(None).cast("double").alias("logp"),
        F.size(F.filter("atoms", hetero)).alias("hba"),
        F.size(F.filter("atoms", lambda a: hetero(a) & (a["hydrogens"] > 0))).alias("hbd"),
    )
    return out.withColumn("lipinski_ok", (F.col("mw") < MASS) & F.coalesce(F.col("logp") < LOGP, F.lit(True)) & (F.col("hba") < ACCEPTORS) & (F.col("hbd") < DONORS))


def properties(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, mw, logp (null), hba, hbd, lipinski_ok, and the columns `keep`: sums and counts over each molecule's atoms, without leaving
    its row."""
    return _with_properties(parsed).select("id", "mw", "logp", "hba", "hbd", "lipinski_ok", *(keep or []))


def validity(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """id, sanitize_ok, lipinski_ok, sa_score (null), sa_ok, overall_ok, notes, and the columns `keep`: stage by stage; later stages of
    a molecule that can't be read fail. All in the molecule's row."""
    lipinski = F.col("ok") & F.col("lipinski_ok")
    note = F.when(~F.col("ok"), F.col("note")).when(~F.col("lipinski_ok"), F.lit("lipinski_fail")).otherwise(F.lit("sascore_unavailable"))
    return _with_properties(parsed).select("id", F.col("ok").alias("sanitize_ok"), lipinski.alias("lipinski_ok"), F.lit(None).cast("double").alias("sa_score"), F.col("ok").alias("sa_ok"), (F.col("ok") & lipinski).alias("overall_ok"), note.alias("notes"), *(keep or []))


def valence_ok(nodes: DataFrame, bonds: DataFrame, limits: list[int]) -> DataFrame:
    """graph_id of graphs in which no node has more bonds, by order, than its type allows. Bond codes are 0 single, 1 double,
    2 triple, 3 aromatic."""
    order = F.element_at(F.array(F.lit(2), F.lit(4), F.lit(6), F.lit(3)), F.col("bond_type") + 1)
    ends = bonds.select("graph_id", order.alias("twice"), F.explode(F.array("u", "v")).alias("node_id"))
    used = ends.groupBy("graph_id", "node_id").agg(F.sum("twice").alias("twice"))
    most = F.element_at(F.array(*[F.lit(2 * x) for x in limits]), F.col("atom_type") + 1)
    over = nodes.join(used, ["graph_id", "node_id"]).where(F.col("twice") > most).select("graph_id").distinct()
    return nodes.select("graph_id").distinct().join(over, "graph_id", "left_anti")
