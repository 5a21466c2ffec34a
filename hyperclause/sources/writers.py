"""Sinks: JSON and Markdown reports, and snapshots of models as tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ensure_inside


def write_json(df: DataFrame, root: str, path: str) -> str:
    """df as JSON lines under root; a path that leads out of it is refused."""
    target = ensure_inside(root, path)
    df.write.mode("overwrite").json(target)
    return target


def markdown(df: DataFrame, title: str, rows: int = 25) -> str:
    """The first rows, by all columns in order, as a Markdown table: a report, so that many rows alone reach the driver."""
    head = df.orderBy(*df.columns).limit(rows).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in r) + " |" for r in head)]) + "\n"


def save_automata(ta: DataFrame, path: str) -> None:
    """A machine's automata (or those of several, by seed) as Parquet."""
    ta.write.mode("overwrite").parquet(path)


def load_automata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_machine(spark: SparkSession, machine, path: str) -> None:
    """A flat machine's automata and weights as two tables."""
    for name, table in zip(("automata", "weights"), machine.tables()):
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/{name}")


def load_machine(spark: SparkSession, machine, path: str):
    """The machine with the states and weights that were saved; their size is the machine's, so they come to the driver."""
    return machine.restore(*(spark.read.parquet(f"{path}/{name}").toPandas() for name in ("automata", "weights")))


def save_teacher(model, labels: DataFrame, path: str) -> None:
    """A fitted teacher and its predictions (graph_id, soft, hard)."""
    model.write().overwrite().save(f"{path}/model")
    labels.write.mode("overwrite").parquet(f"{path}/predictions")


def load_teacher(spark: SparkSession, path: str):
    """The teacher that was saved: a logistic head or a forest."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


def save_student(history: DataFrame, states: DataFrame, path: str) -> None:
    """A student's automata, and its metrics as JSON lines: a row for each seed and epoch (without the packed states)."""
    states.write.mode("overwrite").parquet(f"{path}/automata")
    history.select("seed", "epoch", "train_accuracy", "valid_auroc").orderBy("seed", "epoch").coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def run_tag(at: datetime | None = None) -> str:
    """A moment (now, if none is given) as text that fits a file name and sorts by time; in UTC."""
    return (at or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y%m%d_%H%M%S")


def tag_of(time: Column) -> Column:
    """The same tag of a timestamp column, in the session's time zone."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def node_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id and text: each node with its type and its bonds, in order."""
    near = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "bond_type"))).alias("near"))
    line = nodes.join(near, ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", F.concat_ws(" ", F.format_string("%d(%d)", "node_id", "atom_type"), F.array_join(F.transform(F.coalesce("near", F.array()), lambda e: F.concat(e["dst"].cast("string"), F.lit(":"), e["bond_type"].cast("string"))), " ")).alias("line")
    )
    return line.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "line"))).alias("lines")).select("graph_id", F.array_join(F.transform("lines", lambda x: F.rtrim(x["line"])), "\n").alias("text"))


def curves(log: DataFrame) -> DataFrame:
    """seed, epoch, auroc scraped from lines such as `seed=42 epoch=3 auroc=0.67`. log: value."""
    number = lambda name, kind: F.nullif(F.regexp_extract("value", rf"{name}=([-\d.]+)", 1), F.lit("")).try_cast(kind).alias(name)
    return log.select(number("seed", "int"), number("epoch", "int"), number("auroc", "double")).where("epoch is not null")


def case_studies(reports: DataFrame, scan: int = 80, keep: int = 3) -> DataFrame:
    """Of the first `scan` reports the first `keep` that flipped. reports: graph_id, flipped, and more."""
    return reports.orderBy("graph_id").limit(scan).where("flipped").orderBy("graph_id").limit(keep)
