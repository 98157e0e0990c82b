"""Consolidating pairwise matches into groups by randomised contraction.

In every round each vertex hooks to the member of its closed neighbourhood that
comes first in an order that is drawn afresh, edges are relabelled, loops
dropped and repeats merged. A constant share of the vertices disappears per
round, whatever the shape of the graph, so there are O(log n) rounds of total
size O(edges). The rounds' vertex maps are then composed from the last to the
first.

The order of a round is a bijection of 64-bit integers (a Feistel network of
two rounds of hashing), so a minimum over plain longs gives the chosen
neighbour back: the aggregation stays a hash aggregation that combines
map-side, and a vertex with a third of all edges is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.workspace import BROADCAST_ROWS, broadcast_if_small, cut, drop, rows_of

#: Revisions per 64-bit mask.
BLOCK = 60

_HALF = (1 << 32) - 1


def _scrambled(half: Column, turn: int, step: int) -> Column:
    return F.xxhash64(half, F.lit(2 * turn + step)).bitwiseAND(F.lit(_HALF))


def place(x: Column, turn: int) -> Column:
    """Position of vertex ``x`` in the order of a round."""
    low = x.bitwiseAND(F.lit(_HALF))
    high = F.shiftrightunsigned(x, 32).bitwiseXOR(_scrambled(low, turn, 0))
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseXOR(_scrambled(high, turn, 1)))


def at_place(y: Column, turn: int) -> Column:
    """The vertex at a position: the inverse of :func:`place`."""
    high = F.shiftrightunsigned(y, 32)
    low = y.bitwiseAND(F.lit(_HALF)).bitwiseXOR(_scrambled(high, turn, 1))
    return F.shiftleft(high.bitwiseXOR(_scrambled(low, turn, 0)), 32).bitwiseOR(low)


def _relabel(edges: DataFrame, hooks: DataFrame, by: list[str], end: str) -> DataFrame:
    to = hooks.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("v").alias("__v"), F.col("r").alias("__r"))
    same = F.col(end) == F.col("__v")
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return edges.join(to, same).withColumn(end, F.col("__r")).drop("__v", "__r", *[f"__{c}" for c in by])


def _ordered(edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.where("a != b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contract(edges: DataFrame, by: Sequence[str] = (), few: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of ``edges`` (``by``, ``a``, ``b``; longs), separately for each value of ``by``.

    Loops, repeats and direction do not matter; rows with a null are ignored.

    :param few: vertex maps counted to have at most so many rows are broadcast, larger ones are joined by shuffles
    :returns: ``by``, ``v``, ``root``: every vertex of an edge between two different vertices,
        and a vertex of its component, the same for all. No rows for no edges.
    """
    by = list(by)
    edges = cut(edges.dropna(subset=[*by, "a", "b"]).where("a != b").select(*by, "a", "b"))
    maps: list[DataFrame] = []
    turn = 0
    while rows_of(edges):
        near = edges.select(*by, F.col("a").alias("v"), place(F.col("b"), turn).alias("h")).unionByName(edges.select(*by, F.col("b").alias("v"), place(F.col("a"), turn).alias("h")))
        first = near.groupBy(*by, "v").agg(F.min("h").alias("h"))
        hooks = cut(first.select(*by, "v", at_place(F.least("h", place(F.col("v"), turn)), turn).alias("r")))
        maps.append(hooks)
        lookup = broadcast_if_small(hooks, few)
        smaller = cut(_ordered(_relabel(_relabel(edges, lookup, by, "a"), lookup, by, "b"), by))
        drop(edges)
        edges, turn = smaller, turn + 1
    if not maps:
        return edges.select(*by, F.col("a").alias("v"), F.col("b").alias("root"))
    drop(edges)
    roots = maps.pop().withColumnRenamed("r", "root")
    while maps:
        hooks = maps.pop()
        later = broadcast_if_small(roots, few).select(*by, F.col("v").alias("r"), "root")
        longer = cut(hooks.join(later, [*by, "r"], "left").select(*by, "v", F.coalesce("root", "r").alias("root")))
        drop(hooks, roots)
        roots = longer
    return roots


def linked_groups(links: DataFrame, group: str, left: str, right: str, node_id: Column | None = None, few: int = BROADCAST_ROWS) -> DataFrame:
    """Per ``group`` (a snapshot), every node linked to another one, with the smallest node reachable over links in either direction.

    Snapshots repeat most of each other's links, so a link is kept once with a
    bit mask of the snapshots that have it. Links common to all snapshots are
    contracted once; only the others are then contracted snapshot by snapshot,
    between the groups found so far. Snapshots are taken 60 to a mask.

    Links are shuffled as pairs of 64-bit hashes of their nodes; the nodes' names travel once
    per node. Should two nodes have the same hash, which is looked for, consecutive numbers take the hashes' place.

    Rows with a null group, a null or empty node, or a node linked to itself are no links.

    :param node_id: for tests, another hash of column ``node``
    :param few: see :func:`contract`
    :returns: ``group``, ``node_id``, ``group_id``
    """
    rows = links.where(F.col(group).isNotNull() & (F.col(left) != "") & (F.col(right) != "") & (F.col(left) != F.col(right)))
    rows = rows.select(F.col(group).alias("g"), F.col(left).alias("src"), F.col(right).alias("dst"))
    # One row per snapshot: the only window without partitions.
    numbered = rows.select("g").distinct().withColumn("i", F.row_number().over(Window.orderBy("g")) - 1)
    snapshots = cut(numbered.select("g", F.floor(F.col("i") / BLOCK).cast("int").alias("block"), (F.col("i") % BLOCK).cast("int").alias("k")))
    small = broadcast_if_small(snapshots)
    bit = F.expr("shiftleft(1L, k)")
    placed = rows.join(small, "g")

    named = placed.select("block", "k", F.explode(F.array("src", "dst")).alias("node")).groupBy("block", "node").agg(F.bit_or(bit).alias("mask"))
    nodes = cut(named.withColumn("id", F.xxhash64("node") if node_id is None else node_id))
    a, b = F.xxhash64("src"), F.xxhash64("dst")
    if node_id is not None or not nodes.groupBy("block", "id").count().where("count > 1").isEmpty():
        nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
        number = nodes.select("block", "node", "id")
        placed = placed.join(number.withColumnsRenamed({"node": "src", "id": "a"}), ["block", "src"]).join(number.withColumnsRenamed({"node": "dst", "id": "b"}), ["block", "dst"])
        a, b = F.col("a"), F.col("b")
    pairs = cut(placed.select("block", "k", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).groupBy("block", "a", "b").agg(F.bit_or(bit).alias("mask")))
    whole = broadcast_if_small(snapshots.groupBy("block").agg(F.bit_or(bit).alias("whole")))
    identified = pairs.join(whole, "block").select("block", "a", "b", "mask", (F.col("mask") == F.col("whole")).alias("everywhere"))

    common = contract(identified.where("everywhere"), ["block"], few)
    known = broadcast_if_small(common, few)
    rest = identified.where("not everywhere").select("block", "a", "b", "mask")
    for end in ("a", "b"):
        rest = rest.join(known.select("block", F.col("v").alias(end), "root"), ["block", end], "left").withColumn(end, F.coalesce("root", end)).drop("root")
    rest = rest.where("a != b").groupBy("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bit_or("mask").alias("mask"))
    at = (F.col("block") * BLOCK + F.col("k")).alias("at")
    single = contract(rest.select("block", "a", "b", _bits("mask").alias("k")).select(at, "a", "b"), ["at"], few)

    rooted = cut(nodes.join(known.select("block", F.col("v").alias("id"), "root"), ["block", "id"], "left").select("block", "node", "mask", F.coalesce("root", "id").alias("root")))
    # Groups of the common links are in all snapshots or in none, other nodes by their own mask.
    parts = rooted.groupBy("block", "root").agg(F.min("node").alias("least"), F.bit_or("mask").alias("mask")).select("block", "root", "least", _bits("mask").alias("k")).withColumn("at", at)
    joined = cut(parts.join(broadcast_if_small(single, few).select("at", F.col("v").alias("root"), F.col("root").alias("top")), ["at", "root"], "left").withColumn("top", F.coalesce("top", "root")))
    names = joined.groupBy("at", "top").agg(F.min("least").alias("group_id"))
    of_root = joined.join(names, ["at", "top"]).groupBy("block", "root").agg(F.collect_list(F.struct("k", "group_id")).alias("groups"))
    out = rooted.join(of_root, ["block", "root"]).select("block", "node", F.explode("groups").alias("x"))
    out = out.select("block", F.col("x.k").alias("k"), F.col("node").alias("node_id"), F.col("x.group_id").alias("group_id"))
    drop(pairs)
    return out.join(small, ["block", "k"]).select(F.col("g").alias(group), "node_id", "group_id")


def _bits(mask: str) -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {BLOCK - 1}), k -> ({mask} & shiftleft(1L, k)) != 0)"))
