"""A model that does not change scores a stream of graphs: evaluation needs no state, so it is one projection a row.

Graphs arrive whole, a row each: graph_id, nodes (arrays of the nodes' bits, packed in a long)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clauses


def score_stream(graphs: DataFrame, model: DataFrame, spec: clauses.Spec) -> DataFrame:
    """The columns of graphs but nodes, class_sum and pred. graphs may be streaming; the model is a table of one row."""
    full = F.lit((1 << spec.features) - 1).cast("long")
    held = graphs.join(F.broadcast(model.limit(1)), F.lit(True))
    fires = lambda c: F.exists("nodes", lambda x: clauses.fires(c, x, full - x))
    votes = F.aggregate(F.transform("clauses", lambda c, i: F.when(fires(c), clauses.sign(i)).otherwise(0)), F.lit(0), lambda a, v: a + v)
    total = F.greatest(F.lit(-spec.threshold), F.least(F.lit(spec.threshold), votes))
    return held.select(*[c for c in graphs.columns if c != "nodes"], total.alias("class_sum"), (total > 0).cast("int").alias("pred"))


def windowed_rates(scored: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """start, n and positives of each window of event time; rows later than `late` are dropped once a window is closed."""
    grouped = scored.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == 1).alias("positives"))
    return grouped.select(F.col("window.start").alias("start"), "n", "positives")
