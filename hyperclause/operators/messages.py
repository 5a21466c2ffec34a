"""The flat graph machine: clauses over node properties that send messages along typed edges, layer by layer.

A node's properties are the bits of a vector, 32 in a word. A clause includes places: p < size asks for the bit p, p + size
for its absence; so it is two masks, and it matches if pos & ~x = 0 and neg & x = 0. The model is one row of masks, which is
broadcast: matching is an expression in each row of nodes, without a row for a place. A graph is small, so for messages its
nodes and edges are gathered in a row, once, and every layer is an expression there: nothing shuffles between layers.
Messages of a layer are the fired clauses' codes at the receiving nodes, shifted by the edge's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from .prefix import prefix_sums, whole_ranges


def masks(includes: DataFrame, size: int) -> DataFrame:
    """One row: clauses, an array of clause, pos and neg in the order of clauses. includes: clause, place (null: none)."""
    grouped = includes.groupBy("clause").agg(F.collect_set("place").alias("places"))
    plain, negated = F.filter("places", lambda p: p < size), F.transform(F.filter("places", lambda p: p >= size), lambda p: p - size)
    own = grouped.select(F.struct("clause", bits.from_places(plain, size).alias("pos"), bits.from_places(negated, size).alias("neg")).alias("c"))
    return own.agg(F.array_sort(F.collect_list("c")).alias("clauses"))


def holds(clause: Column, x: Column, size: int) -> Column:
    """Whether a clause's masks match the words x."""
    out = F.lit(True)
    for w in range(-(-size // bits.WORD)):
        word = F.get(x, F.lit(w))
        out = out & (F.get(clause["pos"], F.lit(w)).bitwiseAND(F.bitwise_not(word)) == 0) & (F.get(clause["neg"], F.lit(w)).bitwiseAND(word) == 0)
    return out


def _beside(rows: DataFrame, model: DataFrame, name: str) -> DataFrame:
    """Every row with the model's masks, which are broadcast: their size is the machine's."""
    return rows.join(F.broadcast(model.select(F.col("clauses").alias(name)).limit(1)), F.lit(True))


def matches(vectors: DataFrame, includes: DataFrame, size: int, gate: Column | None = None) -> DataFrame:
    """graph_id, node_id, clause of every clause all of whose included places the node holds; clauses that include nothing
    match all. vectors: graph_id, node_id, words, and what the gate reads; gate: a condition on these and clause."""
    held = F.transform(F.filter("__clauses", lambda c: holds(c, F.col("words"), size)), lambda c: c["clause"])
    found = _beside(vectors, masks(includes, size), "__clauses").withColumn("clause", F.explode_outer(held)).where("clause is not null")  # outer: a plain one computes the array twice
    return (found if gate is None else found.where(gate)).select("graph_id", "node_id", "clause")


def gathered(vectors: DataFrame, adjacent: DataFrame, includes: DataFrame, size: int, gate: Column | None = None) -> DataFrame:
    """graph_id, nodes (node_id and the clauses that match there) and edges (src, dst, bond_type) of every graph, a row each.

    Where nodes and edges are already dealt out by graph nothing shuffles."""
    held = F.transform(F.filter("__clauses", lambda c: holds(c, F.col("words"), size)), lambda c: c["clause"])
    rows = _beside(vectors, masks(includes, size), "__clauses").withColumn("fired", held)
    if gate is not None:
        one = rows.select("*", F.posexplode_outer("fired").alias("__at", "clause")).groupBy("graph_id", "node_id")
        rows = one.agg(F.array_sort(F.collect_list(F.when(gate, F.col("clause")))).alias("fired"))
    nodes = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "fired"))).alias("nodes"))
    edges = adjacent.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "bond_type")).alias("edges"))
    return nodes.join(edges, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.filter(F.array(F.struct(F.lit(0).alias("src"), F.lit(0).alias("dst"), F.lit(0).alias("bond_type"))), lambda e: F.lit(False))))


def received(graphs: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """graphs with, in each node, inbox: the places of the messages that reach it. codes: clause, code; it is broadcast."""
    table = codes.agg(F.map_from_entries(F.collect_list(F.struct("clause", "code"))).alias("__codes"))
    rows = graphs.join(F.broadcast(table), F.lit(True)).withColumn("__at", F.map_from_arrays(F.transform("nodes", lambda n: n["node_id"]), F.transform("nodes", lambda n: n["fired"])))

    def inbox(n: Column) -> Column:
        come = F.filter("edges", lambda e: e["dst"] == n["node_id"])
        sent = F.transform(come, lambda e: F.transform(F.col("__at")[e["src"]], lambda c: F.pmod(F.col("__codes")[c] + e["bond_type"], F.lit(size)).cast("int")))
        return F.array_distinct(F.flatten(sent))

    return rows.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["fired"].alias("fired"), inbox(n).alias("inbox")))).drop("__at", "__codes")


def exchange(graphs: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """graph_id, node_id, place: the codes of the clauses that match at neighbours, shifted by the type of the edge they come
    along. graphs: as `gathered` gives them."""
    rows = received(graphs, codes, size).select("graph_id", F.explode_outer("nodes").alias("n"))
    return rows.select("graph_id", "n.node_id", F.explode_outer("n.inbox").alias("place")).where("place is not null")


def packed_inboxes(graphs: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """graph_id, node_id, words: the same messages, 32 places in a word; nodes that none reaches have zeros."""
    rows = received(graphs, codes, size).select("graph_id", F.explode_outer("nodes").alias("n"))
    return rows.select("graph_id", "n.node_id", bits.from_places(F.col("n.inbox"), size).alias("words"))


def layers(graphs: DataFrame, includes: list[DataFrame], codes: DataFrame, size: int) -> DataFrame:
    """graph_id, node_id, clause of what matches in the last layer. graphs hold what matches in the first (`gathered`); each
    further layer (includes) keeps what matched before and also matches the messages of the layer before."""
    for k, layer in enumerate(includes):
        graphs = _beside(received(graphs, codes, size), masks(layer, size), f"__layer{k}")
        read = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), n["fired"].alias("fired"), bits.from_places(n["inbox"], size).alias("x")))
        graphs = graphs.withColumn("nodes", read)

        def kept(n: Column, k: int = k) -> Column:
            return F.transform(F.filter(f"__layer{k}", lambda c: F.array_contains(n["fired"], c["clause"]) & holds(c, n["x"], size)), lambda c: c["clause"])

        graphs = graphs.withColumn("nodes", F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), kept(n).alias("fired")))).drop(f"__layer{k}")
    rows = graphs.select("graph_id", F.explode_outer("nodes").alias("n"))
    return rows.select("graph_id", "n.node_id", F.explode_outer("n.fired").alias("clause")).where("clause is not null")


def to_features(fired: DataFrame, graphs: DataFrame, clauses: int) -> DataFrame:
    """graph_id, clause, output (0 or 1) of every clause of every graph."""
    hit = fired.groupBy("graph_id").agg(F.collect_set("clause").alias("__hit"))
    output = F.transform(F.sequence(F.lit(0), F.lit(clauses - 1)), lambda c: F.coalesce(F.array_contains("__hit", c), F.lit(False)).cast("int"))
    return graphs.join(hit, "graph_id", "left").select("graph_id", F.posexplode_outer(output).alias("clause", "output"))


def multi_output(sums: DataFrame) -> DataFrame:
    """graph_id, class_id, pred: every output by itself, 1 from a sum of zero on."""
    return sums.select("graph_id", "class_id", (F.col("score") >= 0).cast("int").alias("pred"))


def symbol_counts(includes: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """clause, symbol, polarity, n: how many of a symbol's places a clause includes, plain (1) or negated (0). codes: symbol, place."""
    split = includes.where(F.col("place").isNotNull()).select("clause", (F.col("place") % size).alias("place"), (F.col("place") < size).cast("int").alias("polarity"))
    return split.join(F.broadcast(codes), "place").groupBy("clause", "symbol", "polarity").agg(F.count(F.lit(1)).alias("n"))


def message_sources(includes: DataFrame, codes: DataFrame, edge_types: int, size: int) -> DataFrame:
    """clause, edge_type, source, polarity, n: from which clauses along which edges the messages come that a clause includes."""
    split = includes.where(F.col("place").isNotNull()).select("clause", (F.col("place") % size).alias("place"), (F.col("place") < size).cast("int").alias("polarity"))
    types = split.withColumn("edge_type", F.explode(F.sequence(F.lit(0), F.lit(edge_types - 1)))).withColumn("code", F.pmod(F.col("place") - F.col("edge_type"), F.lit(size)))
    sources = codes.select(F.col("clause").alias("source"), "code")
    return types.join(F.broadcast(sources), "code").groupBy("clause", "edge_type", "source", "polarity").agg(F.count(F.lit(1)).alias("n"))


def reconciled(nodes: DataFrame, bonds: DataFrame, declared: DataFrame) -> DataFrame:
    """graph_id, nodes_declared, nodes_found, edges_declared, edges_found of graphs whose counts differ from the declared ones."""
    found = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes_found"))
    edges = bonds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges_found"))
    joined = declared.join(found, "graph_id", "left").join(edges, "graph_id", "left").fillna(0, ["nodes_found", "edges_found"])
    return joined.where("nodes_declared <> nodes_found or edges_declared <> edges_found")


def subset(graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """The graphs of a list in the list's order, numbered anew from 0. graphs: position (from 0); ids: place, index (negative
    ones count from the end). The list is a request and is broadcast."""
    n = F.broadcast(graphs.agg(F.count(F.lit(1)).alias("n")))
    wanted = ids.join(n, F.lit(True)).select("place", F.when(F.col("index") < 0, F.col("index") + F.col("n")).otherwise(F.col("index")).alias("position"))
    return graphs.join(F.broadcast(wanted), "position").withColumnRenamed("place", "new_position")


def sliced(graphs: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """The graphs of a slice, numbered anew from 0 in the slice's order; bounds and step are as in Python's slices. graphs: position
    (from 0)."""
    if not step:
        raise ValueError("the step of a slice is not zero")
    n = F.broadcast(graphs.agg(F.count(F.lit(1)).alias("__n")))
    low, high = (0, F.col("__n")) if step > 0 else (-1, F.col("__n") - 1)

    def bound(value: int | None, otherwise: Column) -> Column:
        if value is None:
            return otherwise
        at = F.lit(value) if value >= 0 else F.col("__n") + value
        return F.least(F.greatest(at, F.lit(low)), high)

    first = bound(start, F.lit(0) if step > 0 else high)
    last = bound(stop, high if step > 0 else F.lit(low))
    way = F.col("position") - first
    inside = (way * (1 if step > 0 else -1) >= 0) & ((F.col("position") - last) * (1 if step > 0 else -1) < 0) & (way % step == 0)
    return graphs.join(n, F.lit(True)).where(inside).withColumn("new_position", (way / step).cast("int")).drop("__n")


def offsets(nodes: DataFrame) -> DataFrame:
    """graph_id, n, first: where each graph's nodes start if graphs lie one after another by id."""
    counts = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counts, [], "graph_id", "n", whole_ranges(F.col("graph_id")), "first")


def truncated(nodes: DataFrame, adjacent: DataFrame, most_nodes: int, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The first nodes of each graph and the first directed edges between them, by number; 8 edges a node by default."""
    most_edges = 8 * most_nodes if most_edges is None else most_edges
    inside = adjacent.where((F.col("src") < most_nodes) & (F.col("dst") < most_nodes))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("edge_id", "src"))
    return nodes.where(F.col("node_id") < most_nodes), inside.withColumn("__r", rank).where(F.col("__r") <= most_edges).drop("__r")
