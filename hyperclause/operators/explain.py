"""Why a clause machine decides as it does: firing clauses, contributions, literals, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clauses import Spec, included, sign


def literal_text(feature: Column, negated: Column) -> Column:
    return F.concat(F.when(negated, "~").otherwise(""), F.lit("X"), feature.cast("string"), F.lit("=1"))


def parse_literal(text: Column) -> Column:
    """feature and polarity (1 plain, 0 negated) of a literal's text; other texts are an error."""
    place = F.regexp_extract(F.trim(text), r"^~?X(\d+)=1$", 1)
    checked = F.when(place != "", place).otherwise(F.raise_error(F.concat(F.lit("no literal: "), text)))
    return F.struct(checked.cast("int").alias("feature"), F.when(F.startswith(F.trim(text), F.lit("~")), 0).otherwise(1).alias("polarity"))


def clause_literals(ta: DataFrame, spec: Spec, threshold: int, empty: bool = False) -> DataFrame:
    """clause and tree: nested lists of branches, ORs, ANDs and leaves of literal texts, in order. empty: keep leaves (and
    so branches) without literals; else only what holds literals stays."""
    negated = F.col("n") >= spec.leaf_and
    text = F.when(F.col("state") > threshold, literal_text(F.col("feature"), negated))
    level = ta.groupBy("clause", "j", "k", "l", "m").agg(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("n", text.alias("child"))))).alias("kids"))
    level = level.select("clause", "j", "k", "l", "m", F.transform("kids", lambda s: s["child"]).alias("child"))
    for above, own in ((["clause", "j", "k", "l"], "m"), (["clause", "j", "k"], "l"), (["clause", "j"], "k"), (["clause"], "j")):
        if not empty:
            level = level.where(F.size("child") > 0)
        level = level.groupBy(*above).agg(F.array_sort(F.collect_list(F.struct(F.col(own).alias("at"), "child"))).alias("kids"))
        level = level.select(*above, F.transform("kids", lambda s: s["child"]).alias("child"))
    return level.withColumnRenamed("child", "tree")


def fired_leaves(nodes: DataFrame, ta: DataFrame, spec: Spec, threshold: int) -> DataFrame:
    """x, clause, j, k, l, m and fired of every leaf with literals, for inputs x: nodes has x, the bits that literals read."""
    masks = included(ta, threshold).groupBy("clause", "j", "k", "l", "m").agg(
        F.bit_or(F.when(F.col("n") < spec.leaf_and, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("feature"))).otherwise(F.lit(0))).alias("pos"),
        F.bit_or(F.when(F.col("n") >= spec.leaf_and, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("feature"))).otherwise(F.lit(0))).alias("neg"),
    )
    held = (F.col("pos").bitwiseAND(F.bitwise_not(F.col("x"))) == 0) & (F.col("neg").bitwiseAND(F.col("x")) == 0)
    # The leaves are the model's, not the data's: they are broadcast.
    return nodes.join(F.broadcast(masks), F.lit(True)).select(*nodes.columns, "clause", "j", "k", "l", "m", held.cast("int").alias("fired"))


def contributions(outputs: DataFrame, id_: str, top_k: int) -> DataFrame:
    """id, clause, contribution and rank of the top_k clauses that contribute most, ties by clause. outputs: id, clause, ways."""
    votes = outputs.where("ways <> 0").withColumn("contribution", F.col("ways") * sign(F.col("clause")))
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(F.abs("contribution")), "clause"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= top_k).select(id_, "clause", "contribution", "rank")


def decisions(outputs: DataFrame, id_: str) -> DataFrame:
    """id and decision: the sign of the sum of the contributions."""
    return outputs.groupBy(id_).agg(F.signum(F.sum(F.col("ways") * sign(F.col("clause")))).cast("int").alias("decision"))


def firing_clauses(node_outputs: DataFrame, classes: int) -> DataFrame:
    """graph_id, clause, voted_class, sign, node_ids (sorted) and clause_output (their number) of every clause that fires.
    node_outputs: graph_id, node_id, clause, output."""
    fired = node_outputs.where("output = 1").groupBy("graph_id", "clause").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"), F.count(F.lit(1)).alias("clause_output"))
    return fired.select("graph_id", "clause", (F.col("clause") % classes).alias("voted_class"), sign(F.col("clause")).alias("sign"), "node_ids", "clause_output")


def firing_counts(ways: DataFrame, clauses: int, members: int) -> DataFrame:
    """member, graph_id, clause and clause_output: at how many nodes a clause holds in more ways than the member's number, where it does at
    any. ways: graph_id and ways (an array by clause) of each node. One pass over the nodes, of which no row is multiplied."""
    more = lambda c, m: F.sum((F.get("ways", F.lit(c)) > m).cast("long"))
    counts = ways.groupBy("graph_id").agg(*[more(c, m).alias(f"n{m}_{c}") for m in range(members) for c in range(clauses)])
    each = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(c).alias("clause"), F.col(f"n{m}_{c}").alias("clause_output")) for m in range(members) for c in range(clauses)])
    return counts.select("graph_id", F.explode_outer(each).alias("e")).select("e.member", "graph_id", "e.clause", "e.clause_output").where("clause_output > 0")


def alert_support(hits: DataFrame) -> DataFrame:
    """alert and support: how many items an alert is found in. hits: item, alert."""
    return hits.groupBy("alert").agg(F.count(F.lit(1)).alias("support"))


def alert_coverage(hits: DataFrame, fired: DataFrame, share: float = 0.5, first: int | None = 5) -> DataFrame:
    """alert, clause, together and support of the first clauses by number (None: of all) that fire on at least max(1, floor(share * support))
    of an alert's items. hits: item, alert; fired: item, clause. Only pairs that meet are counted; there is no cross join."""
    together = hits.join(fired, "item").groupBy("alert", "clause").agg(F.count(F.lit(1)).alias("together"))
    kept = together.join(F.broadcast(alert_support(hits)), "alert").where(F.col("together") >= F.greatest(F.lit(1), F.floor(F.col("support") * share)))
    if first is None:
        return kept.select("alert", "clause", "together", "support")
    rank = F.row_number().over(Window.partitionBy("alert").orderBy("clause"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= first).select("alert", "clause", "together", "support")


def alerts_in(df: DataFrame, item: str, text: str, alerts: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """item and alert for every pattern found in the text, with the columns `keep`: one pass, a handful of conditions, no join."""
    hits = F.filter(F.array(*[F.when(F.rlike(F.col(text), F.lit(p)), F.lit(name)) for name, p in alerts.items()]), lambda a: a.isNotNull())
    return df.select(F.col(item).alias("item"), *(keep or []), F.explode(hits).alias("alert"))
