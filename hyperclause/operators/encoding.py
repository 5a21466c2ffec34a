"""Graphs into binary hypervectors: codebooks, edge vectors, k-hop neighbourhoods and majority bundles.

Hypervectors are arrays of 32-bit words (functions.bits). The node encoder can be told how many leading bits are read
later (`read_bits`), and then computes no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.hashing import mix, mix_array

KINDS = {"atom": 0, "bond": 1, "role": 2}
#: Element symbols in codebook order (any other element takes the last place), bond names by code.
ATOM_SYMBOLS = ["C", "N", "O", "S", "F", "Cl", "Br", "I", "*"]
BOND_CODES = {"single": 0, "double": 1, "triple": 2, "aromatic": 3, "1": 0, "2": 1, "3": 2, "12": 3}


def ones_of(dim: int, sparsity: float) -> int:
    """How many bits a sparse code sets: half-even rounding, one at least, one clear at least."""
    return min(dim - 1, max(1, round(sparsity * dim)))


def codebook(spark: SparkSession, atoms: int, bonds: int, roles: int, dim: int, sparsity: float, seed: int) -> DataFrame:
    """kind, code, bits and words: sparse codes with exactly ones_of(dim, sparsity) set bits, which are those with the least
    hashes. The table is small: it has atoms + bonds + roles rows."""
    if min(atoms, bonds, roles, dim) < 1 or not 0 < sparsity < 1:
        raise ValueError("counts and the dimension must be positive, the sparsity between 0 and 1")
    codes = None
    for kind, n in zip(KINDS, (atoms, bonds, roles)):
        part = spark.range(n).select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("code"))
        codes = part if codes is None else codes.unionByName(part)
    number = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)]), F.col("kind"))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.struct(mix(number * 1000 + F.col("code"), i, seed).alias("h"), i.alias("i"))))
    hot = F.transform(F.slice(ranked, 1, ones_of(dim, sparsity)), lambda s: s["i"])
    out = codes.withColumn("bits", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.array_contains(hot, i).cast("int")))
    return out.withColumn("words", bits.pack(F.col("bits")))


def codes_of(book: DataFrame, kind: str, prefix: str) -> DataFrame:
    """One kind of a codebook as prefix_code and prefix_hv; small, so that it is broadcast in joins."""
    return F.broadcast(book.where(F.col("kind") == kind).select(F.col("code").alias(f"{prefix}_code"), F.col("words").alias(f"{prefix}_hv")))


def atom_code(symbol: Column) -> Column:
    """The codebook place of an element symbol; unknown ones take the last."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(ATOM_SYMBOLS) for x in (s, i)])
    return F.coalesce(F.try_element_at(known, symbol), F.lit(len(ATOM_SYMBOLS) - 1))


def bond_code(name: Column) -> Column:
    """The code of a bond given by name (in any case) or number; others are an error."""
    known = F.create_map(*[F.lit(x) for k, v in BOND_CODES.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, F.lower(name.cast("string"))), F.raise_error(F.concat(F.lit("unknown bond: "), F.coalesce(name.cast("string"), F.lit("null")))))


def from_arrays(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and bonds of graphs given as graph_id, atom_types (symbols) and edges (structs of u, v, bond)."""
    nodes = df.select("graph_id", F.posexplode("atom_types").alias("node_id", "symbol")).select("graph_id", "node_id", atom_code(F.col("symbol")).alias("atom_type"))
    bond = df.select("graph_id", F.size("atom_types").alias("n"), F.explode("edges").alias("e")).select("graph_id", "n", "e.u", "e.v", bond_code(F.col("e.bond")).alias("bond_type"))
    inside = F.col("u").between(0, F.col("n") - 1) & F.col("v").between(0, F.col("n") - 1)
    checked = bond.withColumn("u", F.when(inside, F.col("u")).otherwise(F.raise_error(F.lit("an edge ends outside its graph"))))
    return nodes, checked.select("graph_id", "u", "v", "bond_type")


def adjacency(bonds: DataFrame) -> DataFrame:
    """graph_id, src, dst, bond_type, edge_id in both directions without self loops; edge_id orders the bonds of a graph."""
    ordered = bonds.where("u <> v").withColumn("edge_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v", "bond_type")))
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return ordered.select("graph_id", "bond_type", "edge_id", ends.alias("e")).select("graph_id", "e.src", "e.dst", "bond_type", "edge_id")


def edge_vectors(nodes: DataFrame, adjacent: DataFrame, book: DataFrame) -> DataFrame:
    """graph_id, src, dst, hv: the codes of both ends and of the bond bound together; alike in both directions."""
    own = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("atom_type").alias("a_code"))
    other = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("atom_type").alias("c_code"))
    joined = adjacent.join(own, ["graph_id", "src"]).join(other, ["graph_id", "dst"]).withColumnRenamed("bond_type", "b_code")
    joined = joined.join(codes_of(book, "atom", "a"), "a_code").join(codes_of(book, "bond", "b"), "b_code").join(codes_of(book, "atom", "c"), "c_code")
    return joined.select("graph_id", "src", "dst", bits.bind(bits.bind(F.col("a_hv"), F.col("b_hv")), F.col("c_hv")).alias("hv"))


def _code_map(book: DataFrame, kind: str, name: str) -> DataFrame:
    """One row: a map of one kind's codes to words; it is broadcast."""
    return F.broadcast(book.where(F.col("kind") == kind).agg(F.map_from_entries(F.collect_list(F.struct("code", "words"))).alias(name)))


def _near(nodes: DataFrame, adjacent: DataFrame, book: DataFrame, k: int) -> DataFrame:
    """What `neighbourhoods` gives, and atom_type. A graph is small (molecules have some 60 atoms at most), so its nodes and
    edges are gathered in a row and each root walks its hops there: nothing shuffles where rows are dealt out by graph."""
    if k < 0:
        raise ValueError("k must not be negative")
    own = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "atom_type")).alias("__nodes"))
    edge = "struct<src:int,dst:int,bond_type:int,edge_id:int>"
    edges = adjacent.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "bond_type", "edge_id")).cast(f"array<{edge}>").alias("__edges"))
    rows = own.join(edges, "graph_id", "left").withColumn("__edges", F.coalesce("__edges", F.array().cast(f"array<{edge}>")))
    rows = rows.withColumn("__atoms", F.map_from_entries("__nodes")).withColumn("root", F.explode_outer(F.transform("__nodes", lambda n: n["node_id"])))
    return walked(rows, book, k, ["graph_id"])


def walked(rows: DataFrame, book: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """keep, root, node_id, hop, chain and atom_type: the nodes within k hops of each row's root. rows: keep, root, __atoms (a map of
    the atoms) and __edges (src, dst, bond_type, edge_id, both ways)."""
    # The bonds on the way to a node are a byte each, so that nodes that are met again cost no vector.
    if k > 7:
        raise ValueError("k is 7 at most")
    none = F.lit(0).cast("long")
    rows = rows.withColumn("__found", F.array(F.struct(F.col("root").alias("node_id"), F.lit(0).alias("hop"), none.alias("way"))))
    rows = rows.withColumn("__last", F.array(F.struct(none.alias("key"), F.col("root").alias("node_id"), none.alias("way"))))
    for hop in range(1, k + 1):

        def on(f: Column, i: Column) -> Column:
            """The steps from the i-th node of the last hop. Paths compare as their parents do, then by the last bond."""
            out = F.filter("__edges", lambda e: e["src"] == f["node_id"])
            return F.transform(out, lambda e: F.struct(e["dst"].alias("node_id"), (i * F.lit(1 << 32) + e["edge_id"]).alias("key"), (f["way"] * 256 + e["bond_type"]).alias("way")))

        new = F.filter(F.flatten(F.transform("__last", on)), lambda m: ~F.exists("__found", lambda f: f["node_id"] == m["node_id"]))
        rows = rows.withColumn("__met", F.array_sort(new))
        rows = rows.withColumn("__met", F.filter("__met", lambda x, i: (i == 0) | (F.get("__met", i - 1)["node_id"] != x["node_id"])))
        rows = rows.withColumn("__found", F.concat("__found", F.transform("__met", _at_hop(hop))))
        if hop < k:
            rows = rows.withColumn("__last", F.array_sort(F.transform("__met", lambda m: F.struct(m["key"].alias("key"), m["node_id"].alias("node_id"), m["way"].alias("way")))))
    # Outer: it is never empty, and the filter that explode adds would compute all of it once more.
    rows = rows.select(*keep, "root", "__atoms", F.explode_outer("__found").alias("f"))
    return _chained(rows.select(*keep, "root", "f.node_id", "f.hop", "f.way", F.col("__atoms")[F.col("f.node_id")].alias("atom_type")), book, k, keep)


def _chained(rows: DataFrame, book: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """keep, root, node_id, hop, chain and atom_type from rows that have the way instead of the chain."""
    rows = rows.join(_code_map(book, "bond", "__bonds"), F.lit(True))
    bond = [F.when(F.col("hop") > i, F.col("__bonds")[F.shiftright("way", 8 * i).bitwiseAND(F.lit(255)).cast("int")]).alias(f"__b{i}") for i in range(k)]
    rows = rows.select(*keep, "root", "node_id", "hop", "atom_type", *bond)
    chain = F.array(*[_word(w, k) for w in range(_words(book))])
    return rows.select(*keep, "root", "node_id", "hop", chain.alias("chain"), "atom_type")


def frontier_neighbourhoods(nodes: DataFrame, adjacent: DataFrame, book: DataFrame, k: int, fixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `neighbourhoods` gives, for graphs that are too large for a row: nothing of a graph is gathered.

    Each hop joins the last hop's nodes with their bonds, keeps of the ways to a node the first, and takes out what was met before by
    anti-joins. Rows are dealt out by node, so one graph may be all there is. Ways are compared by the numbers of their bonds from
    the root on, which is the order of parents, then of bonds. The first hop is the bonds of the nodes, and the last is read once, so
    neither is written; fixed: writes what a hop between them has met and reads it again."""
    if not 0 <= k <= 7:
        raise ValueError("k is from 0 to 7")
    keys, none = ["graph_id", "root", "node_id"], F.array().cast("array<long>")
    found = nodes.select("graph_id", F.col("node_id").alias("root"), "node_id", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("way"))
    bonds = adjacent.where("src <> dst").select(F.col("graph_id").alias("__g"), "src", "dst", F.col("bond_type").cast("long").alias("bond"), F.col("edge_id").cast("long").alias("edge"))
    last, before = found.withColumn("path", none), []
    for hop in range(1, k + 1):
        stepped = last.join(bonds, (F.col("graph_id") == F.col("__g")) & (F.col("node_id") == F.col("src"))).where("dst <> root")
        stepped = stepped.select("graph_id", "root", F.col("dst").alias("node_id"), F.struct(F.concat("path", F.array("edge")).alias("path"), (F.col("way") * 256 + F.col("bond")).alias("way")).alias("by"))
        met = stepped.groupBy(*keys).agg(F.min("by").alias("by"))
        for earlier in before:
            met = met.join(earlier.select(*keys), keys, "left_anti")
        last = met.select(*keys, F.lit(hop).alias("hop"), "by.way", "by.path")
        last = fixed(last) if 1 < hop < k else last
        before.append(last)
        found = found.unionByName(last.drop("path"))
    return _chained(found.withColumn("atom_type", F.lit(None).cast("int")), book, k, ["graph_id"]).drop("atom_type")


def _word(w: int, k: int) -> Column:
    """A word of the bonds on the way, bound together."""
    out = F.lit(0).cast("long")
    for i in range(k):
        out = out.bitwiseXOR(F.coalesce(F.get(f"__b{i}", F.lit(w)), F.lit(0).cast("long")))
    return out


def _at_hop(hop: int):
    return lambda m: F.struct(m["node_id"].alias("node_id"), F.lit(hop).alias("hop"), m["way"].alias("way"))


def neighbourhoods(nodes: DataFrame, adjacent: DataFrame, book: DataFrame, k: int) -> DataFrame:
    """graph_id, root, node_id, hop, chain: every node within k hops of a root once, at its least hop, with the bonds along the
    chain that finds it first (by the order of its parents, then of the bonds) bound together. The root itself has hop 0."""
    return _near(nodes, adjacent, book, k).drop("atom_type")


def _words(book: DataFrame) -> int:
    return book.select(F.size("words")).first()[0]


def random_vectors(df: DataFrame, key: str, dim: int, seed: int) -> DataFrame:
    """df with hv, the words of `bits.random_bits` of a key, by whole columns of keys. Words of a null key are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(key)
            keys, words = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.zeros((batch.num_rows, -(-dim // bits.WORD)), np.int64)
            for i in range(dim):
                words[:, i // bits.WORD] |= (np.floor_divide(mix_array(keys, i, seed), 8) & 1) << (i % bits.WORD)
            none = np.repeat(column.is_null().to_numpy(zero_copy_only=False), words.shape[1])
            hv = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1), mask=none))
            yield pa.RecordBatch.from_arrays([*batch.columns, hv], names=[*batch.schema.names, "hv"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", hv array<long>")


#: Bits of a count in a sum.
LANE = 21


def majority(df: DataFrame, keys: list[str], words: str, first: Column, read_bits: int, also: list[str] | None = None) -> DataFrame:
    """hv: the majority of each bit over the vectors of a group; a tie takes the bit of the row for which `first` holds. also: columns
    that are alike within a group, which are kept.

    Vectors are never exploded: three bits of a word share a sum, LANE bits apart. A bit wins if twice its count, and once
    more where the first row sets it, exceeds the number of rows, which must stay under 2^(LANE - 1)."""
    weight, third, sums = F.lit(2) + first.cast("int"), -(-bits.WORD // 3), {}
    for w in range(-(-read_bits // bits.WORD)):
        word = F.get(F.col(words), F.lit(w))
        for j in range(min(third, read_bits - w * bits.WORD)):
            own = [F.shiftright(word, j + third * lane).bitwiseAND(F.lit(1)) * F.lit(1 << (LANE * lane)) for lane in range(3) if j + third * lane < bits.WORD]
            total = own[0]
            for x in own[1:]:
                total = total + x
            sums[w, j] = F.sum(total * weight).alias(f"s{w}_{j}")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums.values(), *[F.first(c).alias(c) for c in also or []])
    n = F.when(F.col("n") < 1 << (LANE - 1), F.col("n")).otherwise(F.raise_error(F.lit("too many vectors in a group")))

    def wins(i: int) -> Column:
        w, place = divmod(i, bits.WORD)
        return F.shiftright(F.col(f"s{w}_{place % third}"), LANE * (place // third)).bitwiseAND(F.lit((1 << LANE) - 1)) > F.col("n")

    return grouped.withColumn("n", n).select(*keys, *(also or []), bits.words_of([wins(i) for i in range(read_bits)]).alias("hv"))


#: Nodes and edges of graphs that are walked at once in a task, about.
WALKED = 1 << 18


def codes(book: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For atoms and bonds, the codes and their bits. The codebook is small: it has a row for each code."""
    rows = book.where(F.col("kind").isin("atom", "bond")).select("kind", "code", "words").collect()
    out = {}
    for kind in ("atom", "bond"):
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["code"])
        words = np.array([r["words"] for r in own], np.uint32)
        out[kind] = np.array([r["code"] for r in own], np.int64), np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    return out


def _coded(known: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value's code, and whether there is one."""
    place = np.minimum(np.searchsorted(known[0], values), len(known[0]) - 1)
    return place, known[0][place] == values


def counts_to_rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many items of each row: the row of each item, and its place in the row."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def places_of(owner: list[np.ndarray], ids: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """One numbering of the pairs of owner and id that several lists hold, and how many there are."""
    sizes = np.cumsum([0, *map(len, ids)])
    _, number = np.unique(np.concatenate(ids), return_inverse=True)
    key = np.concatenate(owner) * (int(number.max(initial=0)) + 1) + number
    distinct, place = np.unique(key, return_inverse=True)
    return [place[a:b] for a, b in zip(sizes[:-1], sizes[1:])], len(distinct)


def majorities(atoms: np.ndarray, src: np.ndarray, dst: np.ndarray, bond: np.ndarray, edge: np.ndarray, roots: np.ndarray, known: dict, k: int, read_bits: int) -> np.ndarray:
    """The first read_bits bits of the vector of each root, a row each: the same as `walked` and `bundled` give, for many graphs at
    once. atoms: the type of each place (below 0: none); src, dst: places; roots: places. Graphs share no places."""
    order = np.lexsort((bond, edge, src))
    dst, bond = dst[order], bond[order]
    degree = np.bincount(src, minlength=len(atoms))
    start = np.cumsum(degree) - degree
    at, has = _coded(known["atom"], atoms)
    dim = known["atom"][1].shape[1]
    turned = lambda bits, hop: bits[:, (np.arange(read_bits) - hop) % dim]
    own = turned(known["atom"][1], 0)[at[roots]] * has[roots][:, None]
    total, n = own.astype(np.int64) * 3, np.ones(len(roots), np.int64)
    root, node, way = np.arange(len(roots)), roots, np.zeros((len(roots), 0), np.int64)
    met = root * len(atoms) + node
    for hop in range(1, k + 1):
        parent, i = counts_to_rows(degree[node])
        e = start[node][parent] + i
        key = root[parent] * len(atoms) + dst[e]
        fresh, first = np.unique(key, return_index=True)  # rows come by root, parent and bond: the first is the way that counts
        first = np.sort(first[~np.isin(fresh, met)])
        root, node, way = root[parent[first]], dst[e[first]], np.column_stack([way[parent[first]], bond[e[first]]])
        met = np.concatenate([met, key[first]])
        bits = turned(known["atom"][1], hop)[at[node]]
        for step in range(hop):
            place, there = _coded(known["bond"], way[:, step] & 255)
            bits = bits ^ (turned(known["bond"][1], hop)[place] * there[:, None])
        bits *= has[node][:, None]
        sums = np.zeros((len(bits) + 1, read_bits), np.int64)
        np.cumsum(bits, axis=0, out=sums[1:])
        ends = np.searchsorted(root, np.arange(len(roots) + 1))
        total += 2 * (sums[ends[1:]] - sums[ends[:-1]])
        n += np.diff(ends)
    return total > n[:, None]


def word_lists(bits: np.ndarray) -> pa.Array:
    """Rows of bits as arrays of 32-bit words."""
    rows, width = bits.shape
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -width % 32))), axis=1, bitorder="little")
    words = packed.view(np.uint32).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))


def flat(column: pa.Array) -> np.ndarray:
    """The numbers in a column of arrays, one after another; a null is -1."""
    values = column.flatten()
    return (values.fill_null(-1) if values.null_count else values).to_numpy(zero_copy_only=False).astype(np.int64)


def sizes(column: pa.Array) -> np.ndarray:
    return pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, work: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about WALKED units of work each, a row at least."""
    total, a = np.cumsum(work), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + WALKED, "right")))
        yield batch.slice(a, b - a)
        a = b


def gathered(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """graph_id, __id and __atom (arrays over the nodes) and an array __c for each of the columns of the edges: a row for each graph
    that has nodes."""
    lists = lambda df, names: df.groupBy("graph_id").agg(F.collect_list(F.struct(*names)).alias("__l"))
    own = lists(nodes, ["node_id", "atom_type"]).select("graph_id", F.col("__l.node_id").alias("__id"), F.col("__l.atom_type").alias("__atom"))
    more = lists(edges, columns).select("graph_id", *[F.col(f"__l.{c}").alias(f"__{c}") for c in columns])
    return own.join(more, "graph_id", "left")


def node_vectors(nodes: DataFrame, adjacent: DataFrame, book: DataFrame, k: int, dim: int, read_bits: int | None = None) -> DataFrame:
    """graph_id, node_id, hv (words; dim is a multiple of 32): the majority of the node's own code and, for each node within k hops, its code bound to
    the bonds on the way and shifted by the hop. Nothing but the first read_bits bits is computed.

    A graph is small, so its nodes and edges are gathered in a row; the graphs of a batch are walked together."""
    if not 0 <= k <= 7:
        raise ValueError("k is from 0 to 7")
    known, read = codes(book), read_bits or dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            for batch in slices(whole, sizes(whole.column("__id")) * (k + 1) + sizes(whole.column("__src")) * k):
                column = lambda c: batch.column(f"__{c}")  # noqa: E731, B023
                owner, _ = counts_to_rows(sizes(column("id")))
                of_edge, _ = counts_to_rows(sizes(column("src")))
                (own, src, dst), n = places_of([owner, of_edge, of_edge], [flat(column(c)) for c in ("id", "src", "dst")])
                if len(np.unique(own)) < len(own):
                    raise ValueError("a node comes up twice in a graph")
                atoms = np.full(n, -1)
                atoms[own] = flat(column("atom"))
                hv = majorities(atoms, src, dst, flat(column("bond_type")), flat(column("edge_id")), own, known, k, read)
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(owner)), column("id").flatten(), word_lists(hv)], names=["graph_id", "node_id", "hv"])

    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("graph_id", "node_id")}
    rows = gathered(nodes, adjacent, ["src", "dst", "bond_type", "edge_id"])
    return rows.mapInArrow(run, f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, hv array<long>")


def bundled(near: DataFrame, book: DataFrame, keys: list[str], read_bits: int, also: list[str] | None = None) -> DataFrame:
    """keys, node_id, also and hv of the roots of neighbourhoods as `walked` gives them."""
    near = near.join(_code_map(book, "atom", "__codes"), F.lit(True))
    bound = bits.bind(F.col("__codes")[F.col("atom_type")], F.col("chain"))
    rows = near.select(*keys, *(also or []), F.col("root").alias("node_id"), "hop", bound.alias("bound"))
    rows = rows.select(*keys, *(also or []), "node_id", "hop", bits.permute_words(F.col("bound"), F.col("hop")).alias("hv"))
    return majority(rows, [*keys, "node_id"], "hv", F.col("hop") == 0, read_bits, also)


def nearest_code(df: DataFrame, words: str, book: DataFrame, kind: str, dim: int) -> DataFrame:
    """df with code and similarity: the codebook entry of a kind that differs in the fewest bits, ties to the lesser code.

    The codebook is an array in every row, so there is no join and no shuffle."""
    entries = F.broadcast(book.where(F.col("kind") == kind).agg(F.array_sort(F.collect_list(F.struct("code", "words"))).alias("entries")))
    found = F.array_max(F.transform("entries", lambda e: F.struct(bits.similarity(F.col(words), e["words"], dim).alias("similarity"), (-e["code"]).alias("code"))))
    return df.join(entries, F.lit(True)).withColumn("found", found).select(*df.columns, (-F.col("found.code")).alias("code"), F.col("found.similarity").alias("similarity"))


def circular_fingerprints(nodes: DataFrame, adjacent: DataFrame, radius: int, size: int) -> DataFrame:
    """graph_id and bits (sorted places): hashed neighbourhoods of each node up to a radius, folded to `size` places."""
    now = nodes.select("graph_id", "node_id", F.xxhash64(F.col("atom_type")).alias("id"))
    every = now
    for r in range(1, radius + 1):
        near = adjacent.join(now.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id"))
        around = near.agg(F.array_sort(F.collect_list(F.struct("bond_type", "id"))).alias("around"))
        now = now.join(around, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.xxhash64(F.lit(r), F.col("id"), F.to_json(F.struct("around"))).alias("id"))
        every = every.unionByName(now)
    return every.groupBy("graph_id").agg(F.array_sort(F.collect_set(F.pmod(F.col("id"), F.lit(size)).cast("int"))).alias("bits"))


def property_vectors(properties: DataFrame, size: int, hot: int, seed: int, complement: bool = True) -> DataFrame:
    """graph_id, node_id, bits: the places of all symbols of a node set, and the negations of all places after them."""
    own = bits.unpack(F.col("words"), size)
    return property_words(properties, size, hot, seed).select("graph_id", "node_id", (bits.with_complement(own) if complement else own).alias("bits"))


def property_words(properties: DataFrame, size: int, hot: int, seed: int) -> DataFrame:
    """graph_id, node_id, words: the same places, 32 in a word. A word is one OR over a node's symbols, so no place is a row."""
    words = range(-(-size // bits.WORD))
    coded = properties.select("graph_id", "node_id", bits.places_words(bits.hot_places(F.col("symbol"), hot, size, seed), size).alias("words"))
    grouped = coded.groupBy("graph_id", "node_id").agg(*[F.bit_or(F.get("words", F.lit(w))).alias(f"__w{w}") for w in words])
    return grouped.select("graph_id", "node_id", F.array(*[f"__w{w}" for w in words]).alias("words"))


def packed(rows: DataFrame, keys: list[str], bit: str, value: str) -> DataFrame:
    """keys, word, bits: a row for each 32-bit word of vectors that are given bit by bit."""
    grouped = rows.groupBy(*keys, F.floor(F.col(bit) / bits.WORD).cast("int").alias("word"))
    return grouped.agg(F.sum(F.col(value) * bits.power(F.col(bit) % bits.WORD)).alias("bits"))


def one_hot_features(nodes: DataFrame, adjacent: DataFrame, atoms: int, bonds: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed edges with x, the one-hot array of their type."""
    return (
        nodes.select("graph_id", "node_id", bits.one_hot(F.col("atom_type"), atoms).alias("x")),
        adjacent.select("graph_id", "src", "dst", bits.one_hot(F.col("bond_type"), bonds).alias("x")),
    )
