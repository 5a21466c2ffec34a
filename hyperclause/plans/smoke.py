"""A small end-to-end run: subsample, encode, train, score. It shows that the parts fit, not how good they can get."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import encoding, metrics, training
from ..operators.clauses import Spec
from . import derived

#: Clauses whose leaves read DIM bits of a node.
DIM, SPEC = 64, Spec(clauses=40, threshold=40, s=3.9, root=2, inner_or=2, inner_and=5, leaf_or=3, leaf_and=3)


def run(spark: SparkSession, sf_dir: str, train: int = 500, test: int = 200, epochs: int = 2, seed: int = 42, dim: int = DIM, spec: Spec = SPEC) -> DataFrame:
    """One row: trained, tested, accuracy, auroc and majority (the accuracy of the more frequent class) of a machine that
    learns `train` graphs for some epochs, on `test` others. One task trains; its rows are bounded by train and test."""
    picked = metrics.hash_rank(derived.graphs(spark, sf_dir), "graph_id", seed).where(F.col("rank") <= train + test)
    picked = picked.withColumn("part", F.when(F.col("rank") <= train, "train").otherwise("test"))
    nodes = derived.nodes(spark, sf_dir).join(picked.select("graph_id"), "graph_id", "left_semi")
    near = encoding.adjacency(derived.bonds(spark, sf_dir).join(picked.select("graph_id"), "graph_id", "left_semi"))
    book = encoding.codebook(spark, derived.ATOMS, derived.BONDS, 3, dim, 0.3, seed)
    hv = encoding.node_vectors(nodes, near, book, 2, dim, spec.features)
    rows = hv.select("graph_id", F.struct("node_id", bits.unpack(F.col("hv"), spec.features).alias("bits")).alias("n")).groupBy("graph_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    rows = rows.join(picked, "graph_id").select("graph_id", "y", "part", F.transform("nodes", lambda n: n["bits"]).alias("bits"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("graph_id")
        graphs, y, kept = [np.stack(list(b)).astype(bool) for b in pdf["bits"]], pdf["y"].to_numpy(int), (pdf["part"] == "train").to_numpy()
        at = np.flatnonzero(kept)
        machine = training.graph_fit(training.Machine(spec, seed), [graphs[i] for i in at], y[at], epochs)
        fired = np.array([np.any([machine.evaluate(machine.literals(n))[-1] > 0 for n in g], axis=0) for g in graphs])
        return pd.DataFrame({"y": y, "part": pdf["part"], "score": fired @ machine.sign})

    scored = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "y int, part string, score long")
    tested = scored.where("part = 'test'")
    share = F.avg((F.col("y") == 1).cast("int"))
    own = scored.agg(F.count_if(F.col("part") == "train").alias("trained"), F.count_if(F.col("part") == "test").alias("tested"))
    out = tested.agg(F.avg((F.col("y") == (F.col("score") > 0).cast("int")).cast("int")).alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))
    return own.join(out, F.lit(True)).join(metrics.auroc(tested, [], "y", "score"), F.lit(True))
