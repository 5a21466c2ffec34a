"""Rings, hydrogens, cores and substructures of molecules, held against known formulas and searches over all numberings."""

import random
from collections import Counter
from itertools import combinations, permutations, product

import pytest

from hyperclause.operators import chemistry, patterns, rings

# Molecules and their known formulas; the letter tells how many rings.
FORMULAS = [
    ("c1ccoc1", "C4H4O", 1), ("c1ccc2c(c1)oc1ccccc12", "C12H8O", 3), ("O=c1cc[nH]cc1", "C5H5NO", 1), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C8H10N4O2", 2),
    ("c1ccsc1", "C4H4S", 1), ("Cn1cccc1", "C5H7N", 1), ("C1=CC=CC=C1", "C6H6", 1), ("c1ccc2cccc2cc1", "C10H8", 2), ("c1cc2ccc3cccc4ccc(c1)c2c34", "C16H10", 4),
    ("C[N+](=O)[O-]", "CH3NO2", 0), ("CN(=O)=O", "CH3NO2", 0), ("CN=N#N", "CH3N3", 0), ("c1cc[n+]([O-])cc1", "C5H5NO", 1), ("CC(=O)Oc1ccccc1C(=O)O", "C9H8O4", 1),
    ("c1ccccc1c1ccccc1", "C12H10", 2), ("[H]C([H])([H])[H]", "CH4", 0), ("OS(=O)(=O)c1ccccc1", "C6H6O3S", 1), ("C12C3C4C1C5C2C3C45", "C8H8", 5),
    ("c1nc2[nH]cnc2c(=O)[nH]1", "C5H4N4O", 2), ("c1cc[nH+]cc1", "C5H6N", 1), ("[cH-]1cccc1", "C5H5", 1), ("O=C1C=CC(=O)C=C1", "C6H4O2", 1), ("c1ccc2[nH]c3ccccc3c2c1", "C12H9N", 3),
    ("C1CC2CCC1CC2", "C8H14", 2), ("c1cncnc1", "C4H4N2", 1), ("c1ncon1", "C2H2N2O", 1), ("O=c1[nH]c(=O)c2[nH]c[nH+]c2[nH]1", "C5H5N4O2", 2),
]


def formula(text):
    n = Counter()
    for a in chemistry.perceive(text)[0]:
        n[a[0]] += 1
        n["H"] += a[3]
    return "".join(f"{s}{n[s] if n[s] > 1 else ''}" for s in ("C", "H", *sorted(set(n) - {"C", "H"})) if n[s])


@pytest.mark.parametrize("text, known, circles", FORMULAS)
def test_formulas_and_rings(text, known, circles):
    assert formula(text) == known
    bonds = [b[:2] for b in chemistry.perceive(text)[1]]
    near = rings.neighbours(len(chemistry.perceive(text)[0]), bonds)
    assert len(rings.smallest_rings(near, bonds, rings.ring_bonds(near))) == circles


@pytest.mark.parametrize("text, note", [("n1cccc1", "kekulize"), ("c1cccc1", "kekulize"), ("cc", "aromatic_atom_outside_a_ring"), ("C(C)(C)(C)(C)C", "valence_of_C"), ("F(C)C", "valence_of_F"), ("C[N+](C)(C)(C)C", "valence_of_N"), ("C1CC", "incomplete"), ("C:C", "aromatic_bond_outside_a_ring"), (None, "empty"), (" ", "empty"), ("C1C1", "bad_ring")])
def test_texts_that_are_no_molecules(text, note):
    with pytest.raises(ValueError, match=note):
        chemistry.perceive(text)


def test_aromatic_however_it_is_written():
    for a, b in [("c1ccccc1C", "CC1=CC=CC=C1"), ("c1ccoc1", "C1=COC=C1"), ("c1ccc2[nH]ccc2c1", "C1=CC=C2NC=CC2=C1"), ("O=c1cc[nH]cc1", "O=C1C=CNC=C1"), ("c1cccc2cccc2c1", "C1=CC=CC2=CC=CC2=C1"), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C")]:
        found = [Counter((x[0], x[1], x[3]) for x in chemistry.perceive(t)[0]) for t in (a, b)]
        assert found[0] == found[1]
        assert chemistry.scaffold(*chemistry.perceive(a)) == chemistry.scaffold(*chemistry.perceive(b))
    for text in ("C1=CC=CC=CC=C1", "O=C1C=CC(=O)C=C1", "C1=CCC=C1", "O=C1C=CC=C1"):  # eight electrons, four, a break, four
        assert not any(a[1] for a in chemistry.perceive(text)[0])


def test_scaffolds():
    key = lambda s: chemistry.scaffold(*chemistry.perceive(s))
    assert key("CCC(C)O") == "" and key("Cc1ccccc1CCO") == key("c1ccccc1") != key("C1CCCCC1")
    assert key("O=C1CCCCC1C") == key("O=C1CCCCC1") != key("C1CCCCC1")  # what hangs on the core by a double bond is part of it
    assert key("c1ccccc1CCc1ccccc1") != key("c1ccccc1CCCc1ccccc1") and key("c1ccncc1") != key("c1ccccc1")
    star = "c1(c2ccccc2)c(c2ccccc2)c(c2ccccc2)c(c2ccccc2)c(c2ccccc2)c1c1ccccc1"
    assert key(star).startswith("42:") and key("C12C3C4C1C5C2C3C45").startswith("8:")


def least_form(colours, edges):
    """By trying all numberings."""
    n = len(colours)
    return min((tuple(colours[p.index(i)] for i in range(n)), tuple(sorted((min(p[u], p[v]), max(p[u], p[v]), c) for (u, v), c in edges.items()))) for p in permutations(range(n)))


@pytest.mark.parametrize("n, colours, kinds", [(3, 3, 3), (4, 2, 2), (5, 1, 2)])
def test_canonical_forms_of_all_small_graphs(n, colours, kinds):
    """Two graphs share the form exactly if one is the other renumbered."""
    forms = {}
    for own in product(range(colours), repeat=n):
        for bonds in product(range(kinds), repeat=n * (n - 1) // 2):
            edges = {e: b for e, b in zip(combinations(range(n), 2), bonds) if b}
            forms.setdefault(rings.canonical(list(own), edges), set()).add(least_form(own, edges))
    assert all(len(x) == 1 for x in forms.values())
    assert len({next(iter(x)) for x in forms.values()}) == len(forms)


def test_canonical_forms_of_regular_graphs():
    """Graphs that refinement alone can't tell apart, or whose atoms are all alike, under random numberings."""
    r = random.Random(4)
    circle = lambda n, at=0: [(at + i, at + (i + 1) % n) for i in range(n)]
    prism = circle(6) + circle(6, 6) + [(i, i + 6) for i in range(6)]
    moebius = circle(12) + [(i, i + 6) for i in range(6)]
    cases = [(12, prism), (12, moebius), (12, circle(12)), (12, circle(6) + circle(6, 6)), (12, circle(4) + circle(8, 4)), (20, [(i, (i + k) % 20) for i in range(20) for k in (1, 8)])]
    forms = []
    for n, edges in cases:
        found = set()
        for _ in range(4):
            p = r.sample(range(n), n)
            found.add(rings.canonical([0] * n, {(min(p[u], p[v]), max(p[u], p[v])): 1 for u, v in edges}))
        assert len(found) == 1
        forms += found
    assert len(set(forms)) == len(cases)


# Patterns

MOLECULES = [t for t, *_ in FORMULAS] + ["CC(=O)Nc1ccccc1", "Nc1ccccc1", "ClC(Cl)Cl", "C1OC1C", "CCCCCCCO", "OC(=O)CN", "C=CC#N", "[Na+].[O-]C", "CSC", "c1ccccc1Br", "CN(C)C", "C=C=O", "NN", "C"]
#: Conditions as text and in plain Python: an atom is (symbol, aromatic, charge, hydrogens, number, degree, valence, rings, smallest).
ATOMS = [
    ("C", lambda a: a[0] == "C" and not a[1]), ("c", lambda a: a[0] == "C" and a[1]), ("[#6]", lambda a: a[0] == "C"), ("[N,O]", lambda a: a[0] in "NO" and not a[1]), ("[!#6]", lambda a: a[0] != "C"),
    ("[a]", lambda a: a[1]), ("*", lambda a: True), ("[R]", lambda a: a[7] > 0), ("[!R]", lambda a: not a[7]), ("[CX4;H2,H3]", lambda a: a[0] == "C" and not a[1] and a[5] + a[3] == 4 and a[3] in (2, 3)),
    ("[D2]", lambda a: a[5] == 2), ("[r5]", lambda a: a[8] == 5), ("[nH]", lambda a: a[0] == "N" and a[1] and a[3] == 1), ("[+]", lambda a: a[2] == 1), ("[O-]", lambda a: a[0] == "O" and not a[1] and a[2] == -1), ("[v4!H0]", lambda a: a[6] == 4 and a[3] != 0), ("[R2]", lambda a: a[7] == 2),
]
BONDS = [("", lambda o, r: o in (1.0, 1.5)), ("-", lambda o, r: o == 1.0), ("=", lambda o, r: o == 2.0), ("~", lambda o, r: True), (":", lambda o, r: o == 1.5), ("@", lambda o, r: r), ("!@", lambda o, r: not r), ("-,=", lambda o, r: o in (1.0, 2.0))]


def random_pattern(r):
    """A tree of two to four atoms, perhaps with a ring closure, as text and as conditions."""
    n = r.randint(2, 4)
    atoms = [r.choice(ATOMS) for _ in range(n)]
    parents = [None, *[r.choice(range(max(0, k - 2), k)) for k in range(1, n)]]
    bonds = [(k, parents[k], r.choice(BONDS)) for k in range(1, n)]
    closing = r.choice(BONDS) if n > 2 and parents[n - 1] != 0 and r.random() < 0.5 else None

    def text(k):
        own = atoms[k][0] + (f"{closing[0]}1" if closing and k == 0 else "1" if closing and k == n - 1 else "")
        below = [b[2][0] + text(b[0]) for b in bonds if b[1] == k]
        return own + "".join(f"({x})" for x in below[:-1]) + (below[-1] if below else "")

    return text(0), [a[1] for a in atoms], [(k, p, b[1]) for k, p, b in bonds] + ([(n - 1, 0, closing[1])] if closing else [])


def fits(molecule, atoms, bonds):
    own, between = molecule
    order = {frozenset(b[:2]): b[2:] for b in between}
    return any(all(t(own[i]) for t, i in zip(atoms, place)) and all((o := order.get(frozenset((place[a], place[b])))) and t(*o) for a, b, t in bonds) for place in permutations(range(len(own)), len(atoms)))


def test_patterns_equal_a_search_over_all_mappings(spark):
    r = random.Random(8)
    rules = [random_pattern(r) for _ in range(60)]
    small = [t for t in MOLECULES if len(chemistry.perceive(t)[0]) <= 12]
    parsed = chemistry.molecules(spark.createDataFrame(list(enumerate(small)), "id long, smiles string"), "id", "smiles").cache()
    got = {(x.item, x.alert) for x in patterns.alerts(parsed, {f"{k}": p[0] for k, p in enumerate(rules)}).collect()}
    want = {(i, f"{k}") for i, t in enumerate(small) for k, p in enumerate(rules) if fits(chemistry.perceive(t), *p[1:])}
    assert got == want and len({k for _, k in want}) > 20


def test_patterns_within_patterns_and_errors(spark):
    rules = {"amine": "[NX3;H2,H1;!$(NC=O);!$(N=*)]-a", "amide": "[$(NC=O)]", "nitro": "[N+](=O)[O-]", "chlorine": "[Cl]", "acid": "C(=O)[OX2H1]", "path": "[#6][#6][#6][#6][#6][#6][#6][N,O,S]", "pyrene": "c1cc2ccc3cccc4ccc(c1)c2c34", "hydrogen": "[#1]", "charge": "[-1]", "carbon": "[#6;H4]"}
    texts = ["Nc1ccccc1", "CC(=O)Nc1ccccc1", "CN(=O)=O", "ClC(Cl)Cl", "CC(=O)O", "CCCCCCCO", "c1cc2ccc3cccc4ccc(c1)c2c34", "C", "no molecule", None]
    parsed = chemistry.molecules(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id long, smiles string, atoms int"), "id", "smiles")
    got = {}
    for x in patterns.alerts(parsed, rules).collect():
        got.setdefault(x.item, set()).add(x.alert)
    assert got == {0: {"amine"}, 1: {"amide"}, 2: {"nitro", "charge"}, 3: {"chlorine"}, 4: {"acid"}, 5: {"path"}, 6: {"pyrene"}, 7: {"carbon"}}
    for bad in ("", "C(", "C)", "[C", "C1CC", "[$(C]", "Q", "[#]", "C.C", "1C", "[C@H]"):
        with pytest.raises(ValueError):
            patterns.condition(bad)
    empty = chemistry.molecules(spark.createDataFrame([], "id long, smiles string"), "id", "smiles")
    assert patterns.alerts(empty, rules).count() == 0


def test_long_molecules():
    atoms, _ = chemistry.perceive("C" * 20_000)
    assert len(atoms) == 20_000
    assert len(chemistry.perceive("c1ccc(cc1)" * 150 + "C")[0]) == 901


def test_each_text_is_read_once(spark):
    texts = ["CCO", "c1ccccc1N", None, "C(", "C" * 40]
    rows = spark.createDataFrame([(k % 50, texts[k % 5]) for k in range(500)], "id long, smiles string")
    seen = []

    def compute(parsed):
        seen.append(parsed.count())
        return chemistry.validity(parsed, ["text"])

    got = chemistry.of_texts(rows, "id", "smiles", compute).select("id", "overall_ok", "notes").collect()
    assert seen == [5] and len(got) == 500
    assert {(r.id % 5, r.overall_ok, r.notes) for r in got} == {(0, True, "sascore_unavailable"), (1, True, "sascore_unavailable"), (2, False, "empty"), (3, False, "incomplete"), (4, False, "lipinski_fail")}


def test_validity_of_rows_that_share_an_id(spark):
    parsed = chemistry.molecules(spark.createDataFrame([(1, "CCO"), (1, "C("), (1, "CCO")], "id long, smiles string"), "id", "smiles")
    assert sorted(r.overall_ok for r in chemistry.validity(parsed).collect()) == [False, True, True]
