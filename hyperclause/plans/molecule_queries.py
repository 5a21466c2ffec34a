"""Queries over molecules with fused, hetero and aromatic rings, which the parts name: a core, a chain and an end group each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chemistry, patterns
from .derived import read
from .registry import query

#: Cores, written so that what follows is bound to the last atom: name, text, atoms of C, H, N, O and S, ring atoms, aromatic atoms,
#: hydrogens on N and O, and what the last atom is.
CORES = [
    ("furan", "c1ccoc1", 4, 4, 0, 1, 0, 5, 5, 0, "aromatic"),
    ("thiophene", "c1ccsc1", 4, 4, 0, 0, 1, 5, 5, 0, "aromatic"),
    ("pyrrole", "c1cc[nH]c1", 4, 5, 1, 0, 0, 5, 5, 1, "aromatic"),
    ("pyridine", "c1ccncc1", 5, 5, 1, 0, 0, 6, 6, 0, "aromatic"),
    ("pyridone", "O=c1cc[nH]cc1", 5, 5, 1, 1, 0, 6, 6, 1, "aromatic"),
    ("imidazole", "c1nc[nH]c1", 3, 4, 2, 0, 0, 5, 5, 1, "aromatic"),
    ("indole", "c1ccc2[nH]ccc2c1", 8, 7, 1, 0, 0, 9, 9, 1, "aromatic"),
    ("dibenzofuran", "c1ccc2oc3ccccc3c2c1", 12, 8, 0, 1, 0, 13, 13, 0, "aromatic"),
    ("benzene", "C1=CC=CC=C1", 6, 6, 0, 0, 0, 6, 6, 0, "aromatic"),
    ("caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", 8, 10, 4, 2, 0, 9, 9, 0, "chain"),
    ("cyclohexanone", "O=C1CCCCC1", 6, 10, 0, 1, 0, 6, 0, 0, "chain"),
    ("azulene", "c1cccc2cccc2c1", 10, 8, 0, 0, 0, 10, 10, 0, "aromatic"),
    ("quinone", "O=C1C=CC(=O)C=C1", 6, 4, 0, 2, 0, 6, 0, 0, "double"),
    ("biphenyl", "c1ccccc1c1ccccc1", 12, 10, 0, 0, 0, 12, 12, 0, "aromatic"),
]
#: End groups: name, text, C, H, N, O, Cl, hydrogens on N.
ENDS = [
    ("none", "", 0, 1, 0, 0, 0, 0),
    ("amine", "N", 0, 2, 1, 0, 0, 1),
    ("nitro", "N(=O)=O", 0, 0, 1, 2, 0, 0),
    ("chlorine", "Cl", 0, 0, 0, 0, 1, 0),
    ("epoxide", "C1CO1", 2, 3, 0, 1, 0, 0),
    ("aldehyde", "C=O", 1, 1, 0, 1, 0, 0),
    ("azide", "N=[N+]=[N-]", 0, 0, 3, 0, 0, 0),
]
ALERTS = {
    "aromatic_nitro": "a[N+](=O)[O-]",
    "aliphatic_nitro": "[CX4][N+](=O)[O-]",
    "aromatic_amine": "[NX3;H2;!$(NC=O);!$(N=*)]-a",
    "alkyl_halide": "[CX4;H1,H2,H3][F,Cl,Br,I]",
    "epoxide": "C1OC1",
    "aldehyde": "[CX3H1](=O)[#6]",
    "azide": "[N-]=[N+]=N",
    "quinone": "O=C1C=CC(=O)C=C1",
    "lactam": "O=c[c,n]c[nH]",
    "fused": "[R2]@[R2]",
    "biaryl": "a-!@a",
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(k), *(f"'{x}'" if isinstance(x, str) else str(x) for x in r)]) + ")" for k, r in enumerate(rows))


_SQL = f"""core(k, core, smiles, c, h, n, o, s, ring, aromatic, hn, last) AS (VALUES {_values(CORES)}),
    tail(k, tail, smiles, c, h, n, o, cl, hn) AS (VALUES {_values(ENDS)}),
    m AS (
        SELECT p_partkey AS id, core, tail, p_size % 4 AS chain, last, c.c + e.c + p_size % 4 AS c, c.h - 1 + e.h + 2 * (p_size % 4) AS h, c.n + e.n AS n, c.o + e.o AS o, c.s, e.cl,
               ring + CASE WHEN tail = 'epoxide' THEN 3 ELSE 0 END AS ring, aromatic, c.hn + CASE WHEN tail = 'amine' THEN 1 ELSE 0 END AS hbd
        FROM part JOIN core c ON c.k = p_partkey % {len(CORES)} JOIN tail e ON e.k = (p_partkey // {len(CORES)}) % {len(ENDS)})"""


def _parts(spark, sf_dir, compute):
    """id of every part, and what `compute` tells of its molecule."""
    pick = lambda rows, k: F.element_at(F.array(*[F.lit(r[1]) for r in rows]), (k % len(rows) + 1).cast("int"))
    key = F.col("p_partkey")
    text = F.concat(pick(CORES, key), F.expr("repeat('C', p_size % 4)"), pick(ENDS, F.floor(key / len(CORES))))
    return chemistry.of_texts(read(spark, sf_dir, "part").select(key.alias("id"), text.alias("smiles")), "id", "smiles", compute)


@query("src07_ring_molecules", f"WITH {_SQL} SELECT id, true AS ok, CAST(c + n + o + s + cl AS INTEGER) AS atoms, CAST(h AS INTEGER) AS hydrogens, CAST(ring AS INTEGER) AS ring_atoms, CAST(aromatic AS INTEGER) AS aromatic_atoms FROM m")
def src07_rings(spark, sf_dir):
    """Counts that follow from the formulas: hydrogens are where double bonds and aromaticity leave them."""
    hydrogens = F.aggregate("atoms", F.lit(0), lambda acc, a: acc + a["hydrogens"])
    return _parts(spark, sf_dir, lambda parsed: parsed.select("text", "ok", F.size("atoms").alias("atoms"), hydrogens.alias("hydrogens"), F.size(F.filter("atoms", lambda a: a["rings"] > 0)).alias("ring_atoms"), F.size(F.filter("atoms", lambda a: a["aromatic"])).alias("aromatic_atoms")))


@query("rc10_ring_rule_of_five", f"WITH {_SQL} SELECT id, round(12.011::DOUBLE * c + 1.008 * h + 14.007 * n + 15.999 * o + 32.06 * s + 35.453 * cl, 3) AS mw, CAST(n + o AS INTEGER) AS hba, CAST(hbd AS INTEGER) AS hbd, n + o < 10 AS lipinski_ok FROM m")
def rc10_rings(spark, sf_dir):
    return _parts(spark, sf_dir, lambda parsed: chemistry.properties(parsed, ["text"]).select("text", F.round("mw", 3).alias("mw"), "hba", "hbd", "lipinski_ok"))


@query("sp01_ring_scaffolds", f"WITH {_SQL} SELECT id, CASE WHEN tail = 'epoxide' THEN 'linked' ELSE core END AS core FROM m")
def sp01_rings(spark, sf_dir):
    """Cores by name; a core that is linked to the ring of the end group is another one."""
    names = F.create_map(*[F.lit(x) for name, smiles, *_ in CORES for x in (chemistry.scaffold(*chemistry.perceive(smiles)), name)])
    return _parts(spark, sf_dir, lambda parsed: parsed.select("text", F.coalesce(F.try_element_at(names, F.col("scaffold")), F.lit("linked")).alias("core")))


_BOUND = "CASE WHEN chain > 0 THEN 'chain' ELSE last END"


@query(
    "jn04_substructures",
    f"""WITH {_SQL}, b AS (SELECT *, {_BOUND} AS bound FROM m)
    SELECT id AS item, unnest(list_filter([
        CASE WHEN tail = 'nitro' AND bound = 'aromatic' THEN 'aromatic_nitro' END, CASE WHEN tail = 'nitro' AND bound = 'chain' THEN 'aliphatic_nitro' END,
        CASE WHEN tail = 'amine' AND bound = 'aromatic' THEN 'aromatic_amine' END, CASE WHEN tail = 'chlorine' AND bound = 'chain' THEN 'alkyl_halide' END,
        CASE WHEN tail IN ('epoxide', 'aldehyde', 'azide') THEN tail END, CASE WHEN core = 'quinone' THEN core END, CASE WHEN core = 'pyridone' THEN 'lactam' END,
        CASE WHEN core IN ('indole', 'dibenzofuran', 'caffeine', 'azulene') THEN 'fused' END, CASE WHEN core = 'biphenyl' THEN 'biaryl' END], lambda a: a IS NOT NULL)) AS alert FROM b""",
)
def jn04_substructures(spark, sf_dir):
    found = _parts(spark, sf_dir, lambda parsed: patterns.alerts(parsed, ALERTS, keep=["text"]).select("text", "alert"))
    return found.select(F.col("id").alias("item"), "alert")
