"""Operators on directed multigraphs, one graph per value of ``rev``.

Edges are bags of ``rev``, ``src``, ``dst``, ``kind``, ``confidence``,
``provenance`` and call sites. Fixpoints advance level by level: a join of the
frontier with the collapsed edges, an aggregation, an anti-join; every level is
cut (:func:`graphmill.workspace.cut`), and frontiers that were counted to be
small are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.names import EDGE_KINDS, last_segment, position, salience, tier_rank
from graphmill.workspace import broadcast_if_small, cut, drop, rows_of, unseen


@dataclass(frozen=True)
class Ambiguity:
    """Calls and bases by a name that several symbols have, factorised: the pairs of sources and candidates are never made.

    ``names`` has ``rev``, ``id``, ``hub``: the names under which a symbol can be meant; ``refs`` has ``rev``, ``src``, ``hub``: who
    uses which name. Both are cuts without repeats. What they link is weak and never observed.
    """

    names: DataFrame
    refs: DataFrame

    def reversed(self) -> Ambiguity:
        """For walks against the links."""
        return Ambiguity(self.refs.withColumnRenamed("src", "id"), self.names.withColumnRenamed("id", "src"))


def links_only(edges: DataFrame) -> DataFrame:
    """Rows with a revision, a source, and a target."""
    return edges.where(F.col("rev").isNotNull() & F.col("src").isNotNull() & (F.col("dst") != ""))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row per pair: ``rank`` of its strongest tier, ``observed`` if any row is from a run. Unknown tiers are ignored."""
    return links_only(edges).groupBy("rev", "src", "dst").agg(F.max(tier_rank(F.col("confidence"))).cast("int").alias("rank"), F.bool_or(F.coalesce(F.col("provenance") == "runtime", F.lit(False))).alias("observed")).where("rank is not null")


def best_edges(edges: DataFrame) -> DataFrame:
    """Per pair the edge that describes it best: strongest tier, then kind in fixed order, then observed first, then the smallest call site."""
    site = F.concat_ws(":", "callsite_path", F.col("callsite_line").cast("string"))
    observed = F.coalesce(F.col("provenance") == "runtime", F.lit(False))
    rated = links_only(edges).withColumns({"__r": tier_rank(F.col("confidence")), "__k": F.coalesce(position(F.col("kind"), EDGE_KINDS), F.lit(len(EDGE_KINDS))), "__s": site, "__o": observed}).where("__r is not null")
    order = F.struct((-F.col("__r")).alias("a"), F.col("__k").alias("b"), (~F.col("__o")).alias("c"), F.col("__s").alias("d"), F.coalesce("kind", F.lit("")).alias("e"))
    return rated.groupBy("rev", "src", "dst").agg(F.min(order).alias("x")).select("rev", "src", "dst", (-F.col("x.a")).cast("int").alias("rank"), F.nullif(F.col("x.e"), F.lit("")).alias("kind"), (~F.col("x.c")).alias("observed"), F.col("x.d").alias("site"))


def fan_in(edges: DataFrame, ambiguity: Ambiguity | None = None) -> DataFrame:
    """Distinct sources per target, over all kinds and provenances, and who may mean it by an ambiguous name; pairs are combined before the hot targets are.

    Of the ambiguous sources of a target only their number per name is used. Stored sources that are among them are
    taken off, and so is, for a constructor, what its own name and that of its class have in common.
    """
    pairs = links_only(edges).select("rev", "src", "dst").distinct()
    stored = pairs.groupBy("rev", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    if ambiguity is None:
        return stored
    names, refs = ambiguity.names, ambiguity.refs
    sizes = refs.groupBy("rev", "hub").agg(F.count(F.lit(1)).alias("n"))
    derived = names.join(sizes, ["rev", "hub"]).select("rev", "id", "n")
    both = cut(names.groupBy("rev", "id").agg(F.min("hub").alias("hub"), F.max("hub").alias("other")).where("hub != other"))
    met = both.select("rev", "hub", "other").distinct().join(refs, ["rev", "hub"]).join(refs.withColumnRenamed("hub", "other"), ["rev", "other", "src"]).groupBy("rev", "hub", "other").agg(F.count(F.lit(1)).alias("n"))
    twice = both.join(met, ["rev", "hub", "other"]).select("rev", "id", (-F.col("n")).alias("n"))
    covered = pairs.join(names.withColumnRenamed("id", "dst"), ["rev", "dst"]).join(refs, ["rev", "src", "hub"], "left_semi").select("rev", "src", F.col("dst").alias("id")).distinct().groupBy("rev", "id").agg((-F.count(F.lit(1))).alias("n"))
    parts = [stored.withColumnRenamed("fan_in", "n"), derived, twice, covered]
    return reduce(DataFrame.unionByName, parts).groupBy("rev", "id").agg(F.sum("n").alias("fan_in")).where("fan_in > 0")


def ranked_nodes(nodes: DataFrame, edges: DataFrame, ambiguity: Ambiguity | None = None, callers: DataFrame | None = None) -> DataFrame:
    """``rev``, ``id``, ``fan_in`` and ``salience`` of every node; ``callers`` is :func:`fan_in` where it is at hand."""
    joined = nodes.select("rev", "id", "qualname").join(fan_in(edges, ambiguity) if callers is None else callers, ["rev", "id"], "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return joined.select("rev", "id", "fan_in", F.round(salience(F.col("fan_in"), last_segment(F.col("qualname"))), 6).alias("salience"))


def _before(level: DataFrame, ambiguity: Ambiguity) -> DataFrame:
    """``rev``, ``start``, ``id`` of what may lead to a level by an ambiguous name; every name counts once per start."""
    named = broadcast_if_small(level).join(ambiguity.names, ["rev", "id"]).select("rev", "start", "hub").distinct()
    return named.join(ambiguity.refs, ["rev", "hub"]).select("rev", "start", F.col("src").alias("id")).distinct()


def reach_back(edges: DataFrame, starts: DataFrame, hops: int, ambiguity: Ambiguity | None = None) -> tuple[DataFrame, DataFrame]:
    """Bounded reverse reachability.

    Every node stays at its shortest hop, with the best (weakest tier on the
    path, all observed) among the paths of that length, compared in this order.

    :param starts: ``rev``, ``start``
    :param ambiguity: names through which weak, unobserved links lead as well
    :returns: ``rev``, ``start``, ``id``, ``hop``, ``rank``, ``observed`` for 1 <= hop <= ``hops``; and per start
        ``truncated``: whether a link from a node not reached leads into the last level
    """
    key = ["rev", "start", "id"]
    pairs = cut(collapse_edges(edges).withColumnsRenamed({"rank": "r", "observed": "o"}))
    level = first = cut(starts.select("rev", "start").distinct().select("rev", "start", F.col("start").alias("id"), F.lit(2).alias("rank"), F.lit(True).alias("observed")))
    levels, seen = [], [first]
    for hop in range(1, hops + 1):
        step = pairs.join(broadcast_if_small(level).withColumnRenamed("id", "dst"), ["rev", "dst"])
        offers = step.select("rev", "start", F.col("src").alias("id"), F.struct(F.least("rank", "r").alias("rank"), (F.col("observed") & F.col("o")).alias("observed")).alias("q"))
        if ambiguity is not None:
            offers = offers.unionByName(_before(level, ambiguity).withColumn("q", F.struct(F.lit(0).alias("rank"), F.lit(False).alias("observed"))))
        best = offers.groupBy(*key).agg(F.max("q").alias("q")).select(*key, "q.rank", "q.observed")
        level = unseen(best, seen, key)
        if not rows_of(level):
            break
        levels.append(level.select(*key, F.lit(hop).alias("hop"), "rank", "observed"))
        seen.append(level)
    further = pairs.join(broadcast_if_small(level).select("rev", "start", F.col("id").alias("dst")), ["rev", "dst"]).select("rev", "start", F.col("src").alias("id"))
    if ambiguity is not None:
        further = further.unionByName(_before(level, ambiguity))
    known = reduce(DataFrame.unionByName, [x.select(*key) for x in seen])
    cutoff = further.join(known, key, "left_anti").select("rev", "start").distinct().withColumn("truncated", F.lit(True))
    truncated = first.select("rev", "start").join(cutoff, ["rev", "start"], "left").select("rev", "start", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    if not levels:
        return first.select(*key, F.lit(0).alias("hop"), "rank", "observed").where(F.lit(False)), truncated
    return reduce(DataFrame.unionByName, levels), truncated


def _spread(edges: DataFrame, own: DataFrame) -> DataFrame:
    """What effects reach at which tier: ``rev``, ``effect``, ``tier``, ``id``, ``hops``, ``next``.

    A direct effect starts at its own tier and at every weaker one, and spreads over the calls that are as strong. All
    tiers advance together, one level of calls at a time; what is reached at a tier is final, so levels are only ever added.
    """
    key = ["rev", "effect", "tier", "id"]
    calls = cut(collapse_edges(edges.where("kind = 'CALLS'")).where("src != dst").select("rev", "src", "dst", F.col("rank").alias("r")))
    level = cut(own.select("rev", "effect", "id", F.explode(F.sequence(F.lit(0), F.col("rank"))).alias("tier"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("hops")))
    seen = [level]
    hops = 0
    while rows_of(level):
        hops += 1
        step = calls.join(broadcast_if_small(level).select("rev", "effect", "tier", F.col("id").alias("dst")), ["rev", "dst"]).where("r >= tier")
        near = step.groupBy("rev", "effect", "tier", F.col("src").alias("id")).agg(F.min("dst").alias("next"))
        level = unseen(near.select("rev", "effect", "id", "tier", "next", F.lit(hops).alias("hops")), seen, key)
        seen.append(level)
    return reduce(DataFrame.unionByName, seen)


def widest_effects(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Effects that reach a node through calls, at the widest path's tier.

    The tier of a path is the weakest of its calls and of the direct effect at
    its end; a node gets the strongest over all paths. Nodes with a direct effect
    of the kind keep that alone.

    :param edges: all kinds; only ``CALLS`` carry effects
    :param direct: ``rev``, ``id``, ``effect``, ``rank``
    :returns: ``rev``, ``id``, ``effect``, ``rank``, ``direct``
    """
    key = ["rev", "id", "effect"]
    own = cut(direct.groupBy(*key).agg(F.max("rank").cast("int").alias("rank")))
    reached = _spread(edges, own).groupBy(*key).agg(F.max("tier").alias("wide"), F.max(F.when(F.col("hops") == 0, F.col("tier"))).alias("own"))
    return reached.select(*key, F.coalesce("own", "wide").alias("rank"), F.col("own").isNotNull().alias("direct"))


def effect_witnesses(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """How each effect of :func:`widest_effects` reaches a node: fewest calls at its tier or above to a direct effect of that tier or above.

    :returns: ``rev``, ``id``, ``effect``, ``rank``, ``hops`` (0 for a direct effect), ``next``: the smallest id among the
        first steps of such ways, null for a direct effect. Following ``next`` gives the whole chain.
    """
    own = cut(direct.groupBy("rev", "id", "effect").agg(F.max("rank").cast("int").alias("rank")))
    # The strongest tier that reaches a node is the tier of its effect; a direct effect is its own, whatever else arrives.
    held = _spread(edges, own).join(own.withColumnRenamed("rank", "own"), ["rev", "id", "effect"], "left")
    best = held.where("own is null or tier = own").groupBy("rev", "id", "effect").agg(F.max(F.struct("tier", "hops", "next")).alias("x"))
    return best.select("rev", "id", "effect", F.col("x.tier").alias("rank"), "x.hops", "x.next")


def _onward(level: DataFrame, ambiguity: Ambiguity, how: Column) -> DataFrame:
    """``rev``, ``start``, ``id`` and ``o``, the least ``how``: where a level may lead by an ambiguous name; every name counts once per start."""
    named = broadcast_if_small(level).withColumn("how", how).join(ambiguity.refs.withColumnRenamed("src", "id"), ["rev", "id"]).groupBy("rev", "start", "hub").agg(F.min("how").alias("o"))
    return named.join(ambiguity.names, ["rev", "hub"]).select("rev", "start", "id", "o")


def shortest_paths(edges: DataFrame, ends: DataFrame, hops: int, ambiguity: Ambiguity | None = None) -> DataFrame:
    """Per (``rev``, ``start``, ``goal``) the shortest path of at most ``hops`` links, then the strongest, then the first by its node ids.

    :param ambiguity: names through which weak links lead as well
    :returns: ``rev``, ``start``, ``goal``, ``hops``, ``rank`` (of the weakest link), ``nodes``; no row where there is no path.
        A start that is its own goal has a path of no links.
    """
    key = ["rev", "start", "id"]
    pairs = cut(collapse_edges(edges).select("rev", "src", "dst", F.col("rank").alias("r")))
    ways = ["rev", "start", "goal"]
    wanted = cut(ends.select(*ways).distinct())
    level = cut(wanted.select("rev", "start").distinct().select("rev", "start", F.col("start").alias("id"), F.lit(2).alias("rank"), F.array("start").alias("nodes")))
    seen, arrived = [level], []
    for hop in range(hops + 1):
        if hop:
            step = pairs.join(broadcast_if_small(level).withColumnRenamed("id", "src"), ["rev", "src"])
            offers = step.select("rev", "start", F.col("dst").alias("id"), F.struct((-F.least("rank", "r")).alias("weak"), F.concat("nodes", F.array("dst")).alias("nodes")).alias("o"))
            if ambiguity is not None:
                weak = _onward(level, ambiguity, F.struct(F.lit(0).alias("weak"), "nodes"))
                offers = offers.unionByName(weak.select(*key, F.struct("o.weak", F.concat("o.nodes", F.array("id")).alias("nodes")).alias("o")))
            best = offers.groupBy(*key).agg(F.min("o").alias("o")).select(*key, (-F.col("o.weak")).alias("rank"), "o.nodes")
            level = unseen(best, seen, key)
            if not rows_of(level):
                break
            seen.append(level)
        hit = cut(wanted.join(level.withColumnRenamed("id", "goal"), ways).select(*ways, F.lit(hop).alias("hops"), "rank", "nodes"))
        arrived.append(hit)
        if rows_of(hit):  # a start all of whose goals are reached goes no further
            wanted = cut(wanted.join(broadcast_if_small(hit).select(*ways), ways, "left_anti"))
            level = cut(level.join(broadcast_if_small(wanted).select("rev", "start").distinct(), ["rev", "start"], "left_semi"))
            if not rows_of(level):
                break
    return reduce(DataFrame.unionByName, arrived)


def distances(edges: DataFrame, ends: DataFrame, ambiguity: Ambiguity | None = None) -> DataFrame:
    """Fewest links from ``start`` to ``goal`` without a limit: ``rev``, ``start``, ``goal``, ``hops``; no row where no way leads there.

    A start advances until all its goals are reached or nothing new is.
    """
    key = ["rev", "start", "goal"]
    pairs = cut(collapse_edges(edges).select("rev", "src", "dst"))
    pending = cut(ends.select(*key).distinct())
    level = cut(pending.select("rev", "start", F.col("start").alias("id")).distinct())
    seen, arrived, hops = [level], [pending.withColumn("hops", F.lit(0)).where(F.lit(False))], 0
    while rows_of(level):
        hit = cut(pending.join(level.withColumnRenamed("id", "goal"), key))
        if rows_of(hit):
            arrived.append(hit.withColumn("hops", F.lit(hops)))
            pending = cut(pending.join(broadcast_if_small(hit), key, "left_anti"))
            if not rows_of(pending):
                break
            level = cut(level.join(broadcast_if_small(pending).select("rev", "start"), ["rev", "start"], "left_semi"))
        near = pairs.join(broadcast_if_small(level).withColumnRenamed("id", "src"), ["rev", "src"]).select("rev", "start", F.col("dst").alias("id"))
        if ambiguity is not None:
            near = near.unionByName(_onward(level, ambiguity, F.lit(0)).select("rev", "start", "id"))
        level = unseen(near.distinct(), seen, ["rev", "start", "id"])
        seen.append(level)
        hops += 1
    return reduce(DataFrame.unionByName, arrived)


def farthest_sources(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Per revision the node that takes most links to the nearest of the goals (``rev``, ``goal``), then the smallest: ``rev``, ``id``, ``hops``."""
    pairs = cut(collapse_edges(edges).select("rev", "src", "dst"))
    level = cut(goals.select("rev", F.col("goal").alias("id")).distinct())
    seen, last, hops = [level], level.withColumn("hops", F.lit(0)), 0
    while True:
        near = pairs.join(broadcast_if_small(level).withColumnRenamed("id", "dst"), ["rev", "dst"]).select("rev", F.col("src").alias("id")).distinct()
        level = unseen(near, seen, ["rev", "id"])
        if not rows_of(level):
            break
        seen.append(level)
        hops += 1
        last = last.unionByName(level.groupBy("rev").agg(F.min("id").alias("id")).withColumn("hops", F.lit(hops)))
    return last.groupBy("rev").agg(F.min(F.struct((-F.col("hops")).alias("near"), "id")).alias("x")).select("rev", "x.id", (-F.col("x.near")).alias("hops"))


def _relabel(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(hooks.select("rev", F.col("id").alias(end), "to"), ["rev", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.where("a != b").select("rev", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Weakly connected components: ``rev``, ``id``, ``island`` (its smallest id), over links of every kind.

    In each round every node with a smaller neighbour hooks to the smallest
    one, chains of hooks are halved until they are flat, and the edges are rewritten
    between the nodes that are left. Only the smallest node of a component
    never hooks, so it is what the composed hooks lead to.
    """
    pairs = links_only(edges).where("src != dst").select("rev", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left = first = cut(pairs)
    maps: list[DataFrame] = []
    while rows_of(left):
        hooks = cut(left.groupBy("rev", F.col("b").alias("id")).agg(F.min("a").alias("to")))
        while True:
            onward = broadcast_if_small(hooks).select("rev", F.col("id").alias("to"), F.col("to").alias("next"))
            jumped = cut(hooks.join(onward, ["rev", "to"], "left").select("rev", "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            drop(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        maps.append(hooks)
        left = cut(_relabel(left, broadcast_if_small(hooks)))
    if not maps:
        return first.select("rev", F.col("a").alias("id"), F.col("b").alias("island"))
    labels = maps.pop().select("rev", "id", F.col("to").alias("island"))
    while maps:
        onward = broadcast_if_small(labels).select("rev", F.col("id").alias("to"), "island")
        hooks = maps.pop()
        # What hooked in a later round was no hook's id before: both kinds are kept.
        labels = cut(hooks.join(onward, ["rev", "to"], "left").select("rev", "id", F.coalesce("island", "to").alias("island")).unionByName(labels.select("rev", "id", "island")))
    roots = labels.select("rev", F.col("island").alias("id"), "island").distinct()
    return labels.unionByName(roots)


def merges_and_splits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Islands of one side that span several islands of the other, by common members.

    :param before: ``step``, ``id``, ``island``; ``after`` likewise, ``step`` saying which pairs to compare
    :returns: ``step``, ``change`` (``merge`` or ``split``), ``island``, ``n_parts``
    """
    common = before.withColumnRenamed("island", "old").join(after.withColumnRenamed("island", "new"), ["step", "id"]).select("step", "old", "new").distinct()
    merged = common.groupBy("step", F.col("new").alias("island")).agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1").withColumn("change", F.lit("merge"))
    split = common.groupBy("step", F.col("old").alias("island")).agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1").withColumn("change", F.lit("split"))
    return merged.unionByName(split).select("step", "change", "island", "n_parts")


def budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in a total order, with ``place`` and whether the group was ``truncated``.

    One row more than the limit tells whether there are more, so nothing is counted: every task keeps its own first
    rows of a group before the shuffle, and no task sorts a whole group.
    """
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= limit + 1)
    return ranked.withColumn("truncated", F.max("place").over(Window.partitionBy(*keys)) > limit).where(F.col("place") <= limit)
