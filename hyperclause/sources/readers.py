"""Tolerant readers of labelled molecule tables, rule tables and dense Boolean text, and generators of samples."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import mix
from ..operators import patterns

# The names under which files have their columns; the tasks of the assay table.
TEXT_NAMES = ["Drug", "SMILES", "smiles", "Canonical_SMILES"]
LABEL_NAMES = ["Y", "y", "label", "Label", "Activity", "activity"]
TASKS = ["NR-AR", "NR-AR-LBD", "NR-AhR", "NR-Aromatase", "NR-ER", "NR-ER-LBD", "NR-PPAR-gamma", "SR-ARE", "SR-ATAD5", "SR-HSE", "SR-MMP", "SR-p53"]
RULE = "kazius_id int, name string, smarts string, tier string, notes string"


def first_source(spark: SparkSession, candidates: list[tuple[str, str]]) -> tuple[str, str]:
    """The tag and path of the first (tag, path) that is there, by whatever file system the path names: Spark's readers look for
    their paths before anything is read."""
    for tag, path in candidates:
        try:
            spark.read.format("binaryFile").load(path).schema
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            return tag, path
    raise FileNotFoundError("none of the sources exists: " + ", ".join(p for _, p in candidates))


def _named(df: DataFrame, names: list[str]):
    """The first of several columns that has a value; they may be called any of the names."""
    there = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names if c in df.columns]
    if not there:
        raise ValueError(f"no column is named any of {names}")
    return F.coalesce(*there)


def labelled(df: DataFrame) -> DataFrame:
    """smiles and y of rows that have both: labels may be written as decimals; empty and unreadable ones are skipped."""
    y = _named(df, LABEL_NAMES).try_cast("double").try_cast("int")
    return df.select(_named(df, TEXT_NAMES).alias("smiles"), y.alias("y")).where("smiles is not null and y is not null")


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """smiles and y of a CSV file with a header (gzipped or not); all columns are read as text, so no pass infers types."""
    return labelled(spark.read.csv(path, header=True))


def assay(df: DataFrame, task: str) -> DataFrame:
    """smiles and y of one task of a wide assay table; molecules that were not assayed are dropped."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    value = F.trim(F.col(f"`{task}`").cast("string"))
    kept = df.select(F.col("smiles"), value.alias("v")).where(F.col("v").isNotNull() & ~F.lower("v").isin("", "nan"))
    return kept.select("smiles", F.col("v").try_cast("double").try_cast("int").alias("y")).where("y is not null")


def rules(spark: SparkSession, path: str, least: int = 8) -> DataFrame:
    """An alert table from YAML: ids and names must be unique, patterns not empty, and there must be enough of them."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    got = yaml.safe_load(text)
    got = got if isinstance(got, list) else next(v for v in got.values() if isinstance(v, list))
    rows = [(r["kazius_id"], r["name"], r["smarts"], r.get("tier"), r.get("notes")) for r in got]
    for k, what in ((0, "ids"), (1, "names")):
        if len({r[k] for r in rows}) != len(rows):
            raise ValueError(f"{what} are not unique")
    if len(rows) < least or not all(r[2] and r[2].strip() for r in rows):
        raise ValueError("too few alerts, or one without a pattern")
    for r in rows:
        if any(r[2].count(a) != r[2].count(b) for a, b in ("()", "[]")):
            raise ValueError(f"unbalanced pattern: {r[2]}")
        patterns.condition(r[2])  # one that can't be compiled is an error here, not where molecules are searched
    return spark.createDataFrame(rows, RULE)


def boolean_text(df: DataFrame) -> DataFrame:
    """x (array of 0 and 1) and y of lines of numbers between blanks, the last of which is the label. df: value."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.cast("int"))
    rows = df.where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.slice("p", F.lit(1), F.size("p") - 1).alias("x"), F.element_at("p", -1).alias("y"))


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and an order-free fingerprint of the content (sum of row hashes, SHA-256 of it)."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("signature"))


def load(spark: SparkSession, candidates: list[tuple[str, str]], seed: int, train: float = 0.8, valid: float = 0.1, task: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A labelled table with id and split, and one row of metadata: the source's tag, the rows, and the rows of either class.

    task: the column of a wide assay table; None: a table of texts and labels. Ids are hashes of the texts, so repeated texts share one
    and always fall into one part of the split."""
    from ..operators.metrics import class_balance, random_split

    tag, path = first_source(spark, candidates)
    raw = spark.read.csv(path, header=True)
    rows = (labelled(raw) if task is None else assay(raw, task)).withColumn("id", F.shiftrightunsigned(F.xxhash64("smiles"), 1))
    out = random_split(rows, "id", seed, train, valid)
    return out, class_balance(rows, "y").withColumn("source", F.lit(tag))


def molecule_graphs(df: DataFrame, id_: str = "id", smiles: str = "smiles") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and bonds of the molecules that can be read, and one row of counts: read and dropped."""
    from ..operators import chemistry, encoding

    parsed = chemistry.molecules(df, id_, smiles)
    rows = parsed.where("ok").select(F.col("id").alias("graph_id"), F.transform("atoms", lambda a: a["symbol"]).alias("atom_types"), F.transform("bonds", lambda b: F.struct(b["u"].alias("u"), b["v"].alias("v"), b["bond"].alias("bond"))).alias("edges"))
    nodes, bonds = encoding.from_arrays(rows)
    return nodes, bonds, parsed.agg(F.count_if("ok").alias("read"), F.count_if(~F.col("ok")).alias("dropped"))


# Generators: every value follows from the row's number, so any partitioning gives the same table.


def _ids(spark: SparkSession, rows: int | DataFrame) -> DataFrame:
    """So many numbers from 0, or the ids (a column of non-negative longs below 2^32) of a table's rows."""
    return spark.range(rows) if isinstance(rows, int) else rows.select(F.col(rows.columns[0]).cast("long").alias("id"))


def noisy_parity(spark: SparkSession, rows: int | DataFrame, bits: int, groups: int, noise: float, seed: int) -> DataFrame:
    """id, x and y: the parity of the first two bits of each group of bits, flipped for a share of the rows."""
    width = bits // groups
    x = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: (F.floor(mix(F.col("id"), i, seed) / 8) % 2).cast("int"))
    out = _ids(spark, rows).withColumn("x", x)
    clean = F.aggregate(F.filter("x", lambda v, i: i % width < 2), F.lit(0), lambda a, v: (a + v) % 2)
    return out.withColumn("y", F.when(mix(F.col("id"), F.lit(bits), seed) < int(noise * 2147483647), 1 - clean).otherwise(clean))


def noisy_xor(spark: SparkSession, rows: int | DataFrame, noise: float, seed: int) -> DataFrame:
    """id, x1, x2, y: whether two coins differ, flipped for a share of the rows."""
    coin = lambda k: (F.floor(mix(F.col("id"), F.lit(k), seed) / 8) % 2).cast("int")
    out = _ids(spark, rows).withColumn("x1", coin(0)).withColumn("x2", coin(1))
    clean = (F.col("x1") != F.col("x2")).cast("int")
    return out.withColumn("y", F.when(mix(F.col("id"), F.lit(2), seed) < int(noise * 2147483647), 1 - clean).otherwise(clean))


def addition(spark: SparkSession, rows: int | DataFrame, digits: int, seed: int, holdout: tuple[int, int] | None = None) -> DataFrame:
    """id, a, b, x (both digits one-hot) and y, their sum; the held-out pair never comes up."""
    pairs = [(a, b) for a in range(digits) for b in range(digits) if (a, b) != holdout]
    got = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), (mix(F.col("id"), F.lit(0), seed) % len(pairs) + 1).cast("int"))
    out = _ids(spark, rows).withColumn("p", got).select("id", "p.a", "p.b")
    hot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), lambda i: (F.col(c) == i).cast("int"))
    return out.withColumn("x", F.concat(hot("a"), hot("b"))).withColumn("y", F.col("a") + F.col("b"))


def random_graphs(spark: SparkSession, graphs: int, atoms: int, bonds: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs (graph_id, y), nodes and bonds: chains of 4 to 7 nodes with up to two more bonds; positive if there is an atom
    of type 0 and a bond of type 1."""
    size = (mix(F.col("id"), F.lit(0), seed) % 4 + 4).cast("int")
    base = spark.range(graphs).select(F.col("id").alias("graph_id"), size.alias("n"))
    nodes = base.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("node_id")).withColumn("atom_type", (mix(F.col("graph_id"), F.col("node_id") + 10, seed) % atoms).cast("int"))
    chain = base.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("u")).withColumn("v", F.col("u") + 1)
    more = base.select("graph_id", "n", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).select("graph_id", (mix(F.col("graph_id"), F.col("k") + 40, seed) % (F.col("n") - 2)).cast("int").alias("u")).withColumn("v", F.col("u") + 2)
    edges = chain.unionByName(more.distinct()).withColumn("bond_type", (mix(F.col("graph_id"), F.col("u") * 64 + F.col("v") + 100, seed) % bonds).cast("int"))
    has = lambda df, c: df.where(c).select("graph_id").distinct().withColumn("hit", F.lit(1))
    y = base.join(has(nodes, "atom_type = 0").withColumnRenamed("hit", "a"), "graph_id", "left").join(has(edges, "bond_type = 1").withColumnRenamed("hit", "b"), "graph_id", "left")
    return y.select("graph_id", (F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).alias("y")), nodes, edges


def ensure_inside(root: str, path: str) -> str:
    """path, if it lies under root; ValueError for one that leads out of it."""
    full = os.path.normpath(os.path.join(root, path))
    if os.path.commonpath([os.path.normpath(root), full]) != os.path.normpath(root):
        raise ValueError(f"{path} leads out of {root}")
    return full
