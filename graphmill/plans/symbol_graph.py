"""Queries of the symbol graph over the delivered tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import names
from graphmill.functions.text import plain_sha
from graphmill.operators import evaluate, graph, hierarchy, imports, incremental, order, resolve, search, snapshots, view
from graphmill.sources import python_source
from graphmill.streaming import streams
from graphmill.workspace import broadcast_if_small, cut, table

#: Rules a project would add to the built-in catalogue: what it prints, and what it appends to lists.
PROJECT_RULES = (resolve.Rule("print", "FS_WRITE", "LOW", override=True), resolve.Rule("*.append", "GLOBAL_MUTATE", override=True))

EFFECT_RULES = (*resolve.CATALOGUE, *PROJECT_RULES)

HOPS, LIMIT, LOW_LIMIT = 3, 40, 5


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.latest_rows(_t(spark, d, "tree"))


def _revs(spark: SparkSession, d: str) -> DataFrame:
    return broadcast_if_small(cut(snapshots.delivered_revisions(_t(spark, d, "revisions"), _t(spark, d, "tree"))))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return resolve.materialize_nodes(_snapshot(spark, d), _t(spark, d, "blob_nodes"), _t(spark, d, "blobs"))


def _ambiguity(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("call", "base")) -> graph.Ambiguity:
    """Ambiguous names of every revision: who uses them, and what they may mean."""
    refs = cut(_resolved(spark, d).where(F.col("reason") == "ambiguous").where(F.col("ref_kind").isin(*kinds)).select("rev", "src", names.last_segment(F.col("name")).alias("hub")).distinct())
    means = resolve.reaching_names(_symbols(spark, d)).join(broadcast_if_small(cut(refs.select("rev", "hub").distinct())), ["rev", "hub"], "left_semi")
    return graph.Ambiguity(cut(means), refs)


def _hubs(callers: DataFrame) -> DataFrame:
    """The symbol with the most callers in each revision."""
    best = callers.groupBy("rev").agg(F.max_by("id", F.struct("fan_in", "id")).alias("start"))
    return cut(best)


# ---- sources, snapshots, stores


def tree_snapshot(spark, d):
    return _snapshot(spark, d)


def tree_overlay(spark, d):
    """The working tree from the last commit before it: paths that differ are dropped, then those of the working tree added."""
    at, revs = _snapshot(spark, d), _revs(spark, d)
    numbered = at.join(revs, "rev")
    work = numbered.where("rev = 'WORKTREE'")
    head = numbered.join(work.select((F.col("idx") - 1).alias("idx")).distinct(), "idx", "left_semi").select("path", "blob_sha")
    status = head.withColumnRenamed("blob_sha", "old").join(work.select("path", F.col("blob_sha").alias("new")), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kept = head.join(status, "path", "left_anti").withColumn("origin", F.lit("head"))
    return kept.unionByName(status.where("new is not null").select("path", F.col("new").alias("blob_sha"), F.lit("work").alias("origin")))


def content_address(spark, d):
    """Git blob ids of the delivered texts against the delivered ids."""
    content = F.encode("content", "utf-8")
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8")
    sha = F.sha1(F.concat(header, F.unhex(F.lit("00")), content))
    texts = _t(spark, d, "blob_texts").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), sha.alias("git_sha"), "n_bytes", F.octet_length(content).alias("octets")).distinct()
    return texts.withColumn("same", F.col("blob_sha") == F.col("git_sha"))


def blob_dedupe(spark, d):
    """How many paths and revisions share each text."""
    pairs = _snapshot(spark, d).groupBy("blob_sha", "path").agg(F.count(F.lit(1)).alias("k"))
    revs = _snapshot(spark, d).select("blob_sha", "rev").distinct().groupBy("blob_sha").agg(F.count(F.lit(1)).alias("n_revs"))
    return pairs.groupBy("blob_sha").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("k").alias("n_rows")).join(revs, "blob_sha")


def parse_cache_antijoin(spark, d):
    """Texts of the tree that still have to be parsed, or could not be."""
    parsed = _t(spark, d, "blobs").where("status = 'ok'").select(plain_sha(F.col("blob_sha")).alias("blob_sha"))
    return _snapshot(spark, d).select("blob_sha").distinct().join(parsed, "blob_sha", "left_anti")


def gc_removed(spark, d):
    """Texts that no row of the two last revisions uses."""
    revs = _revs(spark, d)
    last = revs.agg(F.max("idx")).first()[0] or 0
    kept = _snapshot(spark, d).join(revs.where(F.col("idx") >= last - 1), "rev").select("blob_sha")
    return _t(spark, d, "blobs").select(plain_sha(F.col("blob_sha")).alias("blob_sha")).where("blob_sha is not null").distinct().join(kept, "blob_sha", "left_anti")


def symbols(spark, d):
    return _symbols(spark, d)


def index_stats(spark, d):
    """Paths, distinct texts, parsed ones, errors, shadowed definitions, links by provenance, and open references by reason per revision."""
    at = _snapshot(spark, d)
    errors = _t(spark, d, "blobs").where("status = 'error'").select(plain_sha(F.col("blob_sha")).alias("blob_sha")).distinct().withColumn("bad", F.lit(1))
    paths = at.join(errors, "blob_sha", "left").groupBy("rev").agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_errors"))
    known = _t(spark, d, "blobs").where("status = 'ok'").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), F.lit(1).alias("ok")).distinct()
    texts = at.select("rev", "blob_sha").distinct().join(known, "blob_sha", "left").groupBy("rev").agg(F.count(F.lit(1)).alias("n_texts"), F.count("ok").alias("n_parsed"))
    open_ = _resolved(spark, d).where("reason is not null").groupBy("rev").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("unknown", "ambiguous", "external", "builtin")])
    shadowed = _symbols(spark, d).where("name_binding = 'shadowed'").groupBy("rev").agg(F.count(F.lit(1)).alias("n_shadowed"))
    links = graph.links_only(_t(spark, d, "edges")).groupBy("rev").agg(F.count_if(F.col("provenance") == "static").alias("n_static"), F.count_if(F.col("provenance") == "runtime").alias("n_runtime"))
    return paths.join(texts, "rev", "left").join(shadowed, "rev", "left").join(links, "rev", "left").join(open_, "rev", "left").na.fill(0)


# ---- names


def path_modules(spark, d):
    paths = _snapshot(spark, d).select("path").distinct().withColumn("module", names.module_of_path(F.col("path"), ("lib", "packages")))
    return paths.withColumn("package", names.package_of_path(F.col("path"), F.col("module"))).withColumn("is_test", names.is_test_path(F.col("path")))


def name_parts(spark, d):
    q = F.col("qualname")
    known = _t(spark, d, "blob_nodes").select("qualname").where(q.isNotNull()).distinct()
    return known.select("qualname", names.last_segment(q).alias("segment"), names.parent_scope(q).alias("parent"), names.is_dunder(names.last_segment(q)).alias("dunder"), names.named_scope(q).alias("scope"))


def absolute_imports(spark, d):
    """Modules named relative to the package of each path: the package, its parent, and a module in either."""
    paths = path_modules(spark, d).select("path", "package")
    levels = paths.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return levels.select("path", "level", names.absolute_module(F.lit("util"), F.col("level"), F.col("package")).alias("target"))


def symbol_lookup(spark, d):
    """Symbols for what a user types, by the first of three ways that finds any: id, qualified name, end of one; without regard to case."""
    asked = ("app/core/registry.py::Registry.get", "registry.PUT", "debug", "no_such_symbol", "log")
    q, i = F.lower("qualname"), F.lower("id")
    queries = F.explode(F.array(*[F.lit(x) for x in asked]))
    x = _symbols(spark, d).withColumn("query", queries)
    wanted = F.lower("query")
    stage = F.when(i == wanted, 1).when(q == wanted, 2).when(F.endswith(q, F.concat(F.lit("."), wanted)), 3)
    hits = x.withColumn("stage", stage).where("stage is not null")
    first = hits.groupBy("rev", "query").agg(F.min("stage").alias("stage"))
    return hits.join(first, ["rev", "query", "stage"]).select("rev", "query", "stage", "id")


# ---- resolution


def reference_owners(spark, d):
    refs = resolve.references(_t(spark, d, "blob_refs"))
    return resolve.owners(refs, _t(spark, d, "blob_nodes")).select("blob_sha", "ordinal", "name", "line", "owner")


def module_local(spark, d):
    refs = resolve.references(_t(spark, d, "blob_refs"))
    return resolve.local_targets(refs, _t(spark, d, "blob_nodes")).where("local is not null").select("blob_sha", "ordinal", "name", "local", "step")


def longest_prefix(spark, d):
    at = _snapshot(spark, d)
    dotted = at.select("rev", "blob_sha").distinct().join(resolve.references(_t(spark, d, "blob_refs")).select("blob_sha", "dotted").where("dotted is not null"), "blob_sha").select("rev", "dotted").distinct()
    return resolve.imported_targets(dotted, at, _t(spark, d, "blob_nodes"))


def last_segment_index(spark, d):
    return resolve.name_index(_symbols(spark, d))


def _resolved(spark, d):
    return resolve.resolve(_t(spark, d, "tree"), _t(spark, d, "blob_nodes"), _t(spark, d, "blob_refs"), _t(spark, d, "blobs"))


def cascade(spark, d):
    return _resolved(spark, d)


def unresolved_pivot(spark, d):
    """Names that stay open, by symbol and reason."""
    open_ = _resolved(spark, d).where("reason is not null").groupBy("rev", "src")
    return open_.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("unknown", "ambiguous", "external", "builtin")])


def unknown_rows(spark, d):
    """What is not known about each symbol: reason order, then source order, within a budget per symbol."""
    rows = _resolved(spark, d).where("reason is not null").withColumn("turn", names.position(F.col("reason"), ("unknown", "ambiguous", "external", "builtin")))
    return graph.budget(rows, ["rev", "src"], [F.col("turn"), F.col("path"), F.col("line"), F.col("name"), F.col("ordinal")], LIMIT).select("rev", "src", "place", "reason", "path", "line", "name", "candidates")


def reference_ratio(spark, d):
    """Share of reference sites, lines of a file, at which anything is linked, per revision."""
    sites = _resolved(spark, d).groupBy("rev", "path", "line").agg(F.bool_or(F.col("step").isNotNull()).alias("linked"))
    counts = sites.groupBy("rev").agg(F.count_if("linked").alias("linked"), F.count(F.lit(1)).alias("n"))
    return counts.select("rev", "linked", "n", F.round(F.col("linked") / F.col("n"), 6).alias("ratio"))


def hub_edges(spark, d, kinds=("call", "base")):
    """Ambiguous names as hubs: sources to the name, the name to its candidates; the pairs are never made."""
    open_ = _resolved(spark, d).where(F.col("reason") == "ambiguous").where(F.col("ref_kind").isin(*kinds)).select("rev", "src", names.last_segment(F.col("name")).alias("hub")).distinct()
    into = open_.select("rev", "src", F.concat(F.lit("*"), "hub").alias("dst"))
    live = _symbols(spark, d).where("name_binding = 'live' and kind != 'module'").select("rev", names.last_segment(F.col("qualname")).alias("hub"), "id")
    out = live.join(open_.select("rev", "hub").distinct(), ["rev", "hub"], "left_semi").select("rev", F.concat(F.lit("*"), "hub").alias("src"), F.col("id").alias("dst")).distinct()
    return into.unionByName(out)


def containment_division(spark, d):
    """Classes that have all methods of a class that others implement or inherit, and do not descend from it."""
    required = graph.links_only(_t(spark, d, "edges")).where("kind in ('IMPLEMENTS', 'INHERITS')").select("rev", F.col("dst").alias("protocol")).distinct()
    return resolve.containing_classes(_symbols(spark, d), required, class_ancestors(spark, d))


# ---- collapsed edges, ranks


def edge_collapse(spark, d):
    return graph.collapse_edges(_t(spark, d, "edges"))


def edge_argmin(spark, d):
    return graph.best_edges(_t(spark, d, "edges"))


def fan_in(spark, d):
    return graph.fan_in(_t(spark, d, "edges"), _ambiguity(spark, d))


def salience_score(spark, d):
    return graph.ranked_nodes(_symbols(spark, d), _t(spark, d, "edges"), _ambiguity(spark, d))


def view_edges(spark, d):
    """Links as drawn: per pair and kind the strongest tier and whether observed; links of a symbol to itself are left out."""
    x = graph.links_only(_t(spark, d, "edges")).where("src != dst")
    return x.groupBy("rev", "src", "dst", "kind").agg(F.max(names.tier_rank(F.col("confidence"))).alias("rank"), F.bool_or(F.col("provenance") == "runtime").alias("observed"))


def override_pairs(spark, d):
    """Methods that stand on both ends of an inheritance."""
    methods = _symbols(spark, d).where("kind = 'method' and name_binding = 'live'").select("rev", F.regexp_replace("id", r"\.[^.]+$", "").alias("cls"), names.last_segment(F.col("qualname")).alias("m")).distinct()
    up = graph.links_only(_t(spark, d, "edges")).where("kind in ('INHERITS', 'IMPLEMENTS')").select("rev", F.col("src").alias("sub"), F.col("dst").alias("base")).distinct()
    below = up.join(methods.withColumnRenamed("cls", "sub"), ["rev", "sub"])
    return below.join(methods.withColumnRenamed("cls", "base"), ["rev", "base", "m"], "left_semi").select("rev", "sub", "base", "m")


# ---- reach


def _reached(spark, d):
    edges, open_ = _t(spark, d, "edges"), _ambiguity(spark, d)
    callers = cut(graph.fan_in(edges, open_))
    return graph.reach_back(edges, _hubs(callers), HOPS, open_), callers


def impact_hops(spark, d):
    """What depends on the most called symbol of each revision, within three hops, ambiguous names included."""
    return _reached(spark, d)[0][0]


def impact_truncated(spark, d):
    return _reached(spark, d)[0][1]


def _impact(spark, d):
    (reached, _), callers = _reached(spark, d)
    known = graph.ranked_nodes(_symbols(spark, d), _t(spark, d, "edges"), callers=callers)
    x = reached.join(known, ["rev", "id"]).withColumn("path", F.substring_index("id", "::", 1))
    name = F.regexp_replace("id", r"^.*(::|\.)", "")
    return x.withColumns({"score": F.round(names.impact_score(F.col("hop"), F.col("rank"), F.col("salience")), 6), "test": F.startswith("path", F.lit("tests/")) | F.startswith(name, F.lit("test_"))})


def impact_ranked(spark, d):
    """The best rows: dependents, then tests in what is left of the budget; weak ones in a small budget of their own."""
    section = F.when(F.col("rank") == 0, "low_confidence").when(F.col("test"), "tests").otherwise("dependents")
    x = cut(_impact(spark, d).withColumn("section", section).withColumn("low", F.col("rank") == 0))
    best = [F.col("score").desc(), F.col("id")]
    strong = graph.budget(x.where("not low"), ["rev"], [F.col("section"), *best], LIMIT)
    weak = graph.budget(x.where("low"), ["rev"], best, LOW_LIMIT)
    return strong.unionByName(weak).select("rev", "section", "place", "id", "hop", "rank", "score")


def impact_summary(spark, d):
    x = _impact(spark, d)
    strong = F.col("rank") > 0
    return x.groupBy("rev").agg(F.count_if(strong).alias("symbols"), F.count_distinct(F.when(strong, F.col("path"))).alias("modules"), F.count_if(strong & (F.col("fan_in") == 0)).alias("entry_points"), F.count_if(~strong).alias("hidden_low"))


def direct_effects(spark, d):
    return resolve.direct_effects(_t(spark, d, "tree"), _t(spark, d, "blob_refs"), EFFECT_RULES)


def glob_best_match(spark, d):
    """Every called name with the rule that fits it best."""
    called = resolve.references(_t(spark, d, "blob_refs")).where("ref_kind = 'call'").select(F.coalesce("dotted", "name").alias("name")).distinct()
    return called.withColumn("hit", resolve.best_rule(F.col("name"), EFFECT_RULES)).where("hit is not null").select("name", "hit.effect", "hit.rank", "hit.match")


def widest_path_effects(spark, d):
    return graph.widest_effects(_t(spark, d, "edges"), direct_effects(spark, d))


def effect_witness(spark, d):
    """The way every effect takes, by its next step."""
    return graph.effect_witnesses(_t(spark, d, "edges"), direct_effects(spark, d))


def _with_hubs(spark, d, kinds=("call", "base")):
    """Links and the ambiguous calls through hubs, factorised; hubs are named ``*name``."""
    hubs = hub_edges(spark, d, kinds).select("rev", "src", "dst", F.lit("CALLS").alias("kind"), F.lit("LOW").alias("confidence"), F.lit("static").alias("provenance"))
    return cut(_t(spark, d, "edges").select("rev", "src", "dst", "kind", "confidence", "provenance").unionByName(hubs))


def effects_with_hubs(spark, d):
    """Effects that may also come through ambiguous names, weak then."""
    return graph.widest_effects(_with_hubs(spark, d, ("call",)), direct_effects(spark, d)).where("not startswith(id, '*')")


def islands_with_hubs(spark, d):
    """Islands in which ambiguous names connect as well, without the hubs themselves."""
    x = graph.connected(_with_hubs(spark, d)).where("not startswith(id, '*')")
    least = x.groupBy("rev", "island").agg(F.min("id").alias("label"))
    return x.join(least, ["rev", "island"]).select("rev", "id", F.col("label").alias("island"))


def _sides(spark, d):
    """Live symbols that left (``new`` 0) or arrived (1) at each revision."""
    here = _symbols(spark, d).where("name_binding = 'live' and kind != 'module'").join(_revs(spark, d), "rev").select("idx", "id", "kind", "body_hash").distinct()
    gone = here.join(here.select((F.col("idx") - 1).alias("idx"), "id"), ["idx", "id"], "left_anti").select((F.col("idx") + 1).alias("idx"), "id", "kind", "body_hash", F.lit(0).alias("new"))
    come = here.join(here.select((F.col("idx") + 1).alias("idx"), "id"), ["idx", "id"], "left_anti").select("idx", "id", "kind", "body_hash", F.lit(1).alias("new"))
    return gone.unionByName(come)


def _moves(spark, d):
    """Certain moves (``idx``, ``removed``, ``added``), and what left or arrived with several candidates (``idx``, ``id``)."""
    paired = cut(move_pairing(spark, d).where("body_hash is not null").join(_revs(spark, d), "rev"))
    unsure = _sides(spark, d).join(paired.where("tier = 'LOW'").select("idx", "kind", "body_hash"), ["idx", "kind", "body_hash"], "left_semi").select("idx", "id").distinct()
    return cut(paired.where("tier = 'MEDIUM'").select("idx", "removed", "added")), unsure


def _differences(rows, ids, rest, moves, last):
    """Rows gained and lost from revision to revision, after the ids before are carried over certain moves: ``idx``, ``ids``, ``rest``, ``change``."""
    columns = ["idx", *ids, *rest]
    now = cut(rows.select(*columns).distinct())
    before = now.withColumn("idx", F.col("idx") + 1).where(F.col("idx") <= last)
    for c in ids:
        before = before.join(broadcast_if_small(moves).select("idx", F.col("removed").alias(c), F.col("added").alias("__to")), ["idx", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    gained = now.where("idx > 0").join(before, columns, "left_anti").withColumn("change", F.lit("added"))
    return gained.unionByName(before.distinct().join(now, columns, "left_anti").withColumn("change", F.lit("removed")))


def _strong_differences(spark, d, moves, last):
    revs = _revs(spark, d)
    links = _strong(_t(spark, d, "edges")).join(revs, "rev").withColumn("kind", F.coalesce("kind", F.lit("")))
    effects = widest_path_effects(spark, d).where("rank > 0").join(revs, "rev")
    return _differences(links, ["src", "dst"], ["kind"], moves, last), _differences(effects, ["id"], ["effect"], moves, last)


def symbol_history(spark, d):
    """What happened to each symbol in each revision: its body, links it made or lost, links to it that came or went, effects; followed over certain moves.

    ``moved_from`` is the id it had in the revision before; where only possible moves are known, the row is
    ``lineage_ambiguous`` and nothing is followed.
    """
    revs = _revs(spark, d)
    last = revs.agg(F.max("idx")).first()[0] or 0
    moves, unsure = _moves(spark, d)
    bodies = _symbols(spark, d).where("name_binding = 'live'").join(revs, "rev").groupBy("id", "idx").agg(F.max("body_hash").alias("body_hash"))
    body = snapshots.change_events(snapshots.validity_intervals(bodies, ["id"], "body_hash"), ["id"], "body_hash", last).where("change = 'changed'")
    links, effects = _strong_differences(spark, d, moves, last)
    ends = links.select("idx", F.explode(F.array(F.struct(F.col("src").alias("id"), F.concat(F.lit("calls_"), "change").alias("what")), F.struct(F.col("dst").alias("id"), F.concat(F.lit("dependents_"), "change").alias("what")))).alias("x")).select("idx", "x.id", "x.what")
    all_ = ends.unionByName(body.select("idx", "id", F.lit("body").alias("what"))).unionByName(effects.select("idx", "id", F.concat(F.lit("effects_"), "change").alias("what")))
    all_ = all_.unionByName(moves.select("idx", F.col("added").alias("id"), F.lit("moved").alias("what"))).unionByName(unsure.select("idx", "id", F.lit("unsure").alias("what")))
    counted = all_.groupBy("idx", "id").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("body", "calls_added", "calls_removed", "dependents_added", "dependents_removed", "effects_added", "effects_removed")], F.bool_or(F.col("what") == "unsure").alias("lineage_ambiguous"))
    moved = moves.select("idx", F.col("added").alias("id"), F.col("removed").alias("moved_from"))
    return counted.join(moved, ["idx", "id"], "left").join(revs, "idx").drop("idx")


def effect_summary(spark, d):
    """Symbols per effect and tier, worst effects first by number."""
    x = widest_path_effects(spark, d).groupBy("rev", "effect", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("direct").alias("n_direct"))
    return x.withColumn("severity", names.position(F.col("effect"), names.SEVERITY))


def _strong(edges):
    return graph.links_only(edges).where("confidence in ('MEDIUM', 'HIGH')").select("rev", "src", "dst", "kind", "confidence", "provenance")


def _path_ends(edges, ambiguity):
    """To the ten most called symbols of each revision: from the symbol with the most targets, and from the one that takes most strong links to get to any of them."""
    out = graph.links_only(edges).select("rev", "src", "dst").distinct().groupBy("rev", "src").agg(F.count(F.lit(1)).alias("n")).groupBy("rev").agg(F.max_by("src", F.struct("n", "src")).alias("start"))
    goals = cut(graph.budget(graph.fan_in(edges, ambiguity), ["rev"], [F.col("fan_in").desc(), F.col("id")], 10).select("rev", F.col("id").alias("goal")))
    far = graph.farthest_sources(_strong(edges), goals).select("rev", F.col("id").alias("start"))
    return cut(out.unionByName(far).distinct().join(goals, "rev"))


def _both_ways(ends):
    return ends.unionByName(ends.select("rev", F.col("goal").alias("start"), F.col("start").alias("goal"))).distinct()


def shortest_path(spark, d):
    """Between the ends of :func:`_path_ends`, in both directions: a row reads along the links, from whichever end reaches the other."""
    edges, open_ = _t(spark, d, "edges"), _ambiguity(spark, d)
    found = graph.shortest_paths(edges, _both_ways(_path_ends(edges, open_)), 6, open_)
    return found.select("rev", "start", "goal", "hops", "rank", F.array_join("nodes", " > ").alias("path"))


def path_negative(spark, d):
    """Why there is no way of two links that are not weak, in either direction: it takes more links, or weak ones (ambiguous names included), or the islands differ, or nothing leads there.

    Longer ways are looked for in both directions until nothing new is reached; ``hops`` is the shorter one.
    """
    edges, open_ = _t(spark, d, "edges"), _ambiguity(spark, d)
    ends = _path_ends(edges, open_)
    key = ["rev", "start", "goal"]

    def shorter(links, ends, name, ambiguity=None):
        # Both walks begin at the few starts; from a goal to its start is from the start against the links.
        back = graph.distances(links.select("rev", F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "provenance"), ends, ambiguity and ambiguity.reversed())
        return cut(graph.distances(links, ends, ambiguity).unionByName(back).groupBy(*key).agg(F.min("hops").alias(name)))

    sure = shorter(_strong(edges), ends, "needed")
    x = ends.join(sure, key, "left").where("needed is null or needed > 2")
    weak = shorter(graph.links_only(edges), x.where("needed is null").select(*key), "with_weak", open_)
    islands = cut(graph.connected(edges))
    x = x.join(weak, key, "left")
    for end in ("start", "goal"):
        x = x.join(islands.select("rev", F.col("id").alias(end), F.col("island").alias(f"{end}_island")), ["rev", end], "left")
    reason = F.when(F.col("needed").isNotNull(), "hop_limit").when(F.col("with_weak").isNotNull(), "low_confidence").when(~F.col("start_island").eqNullSafe(F.col("goal_island")), "other_island").otherwise("no_path")
    return x.select(*key, reason.alias("reason"), F.coalesce("needed", "with_weak").alias("hops"))


def island_mechanisms(spark, d):
    """What else may call into each island: entry points, dunders, decorators, tests, overriding methods, nested functions, observed use."""
    x = _symbols(spark, d).where("kind != 'module'")
    decorated = _t(spark, d, "blob_nodes").where(F.size("decorators") > 0).select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "qualname").distinct()
    marked = _snapshot(spark, d).join(decorated, "blob_sha").select("rev", "path", "qualname", F.lit(True).alias("d"))
    over = override_pairs(spark, d).select("rev", F.concat("sub", F.lit("."), "m").alias("id"), F.lit(True).alias("o")).distinct()
    ran = graph.links_only(_t(spark, d, "edges")).where("provenance = 'runtime'").select("rev", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("t", F.lit(True))
    name = names.last_segment(F.col("qualname"))
    flags = {
        "entry": F.col("qualname") == "main",
        "dunder": names.is_dunder(name),
        "decorator": F.coalesce("d", F.lit(False)),
        "test": names.is_test_entry(F.col("path"), F.col("qualname")),
        "override": F.coalesce("o", F.lit(False)),
        "nested": F.contains("qualname", F.lit("<locals>")),
        "traced": F.coalesce("t", F.lit(False)),
    }
    x = x.join(marked, ["rev", "path", "qualname"], "left").join(over, ["rev", "id"], "left").join(ran, ["rev", "id"], "left")
    x = x.groupBy("rev", "id").agg(*[F.bool_or(v).alias(k) for k, v in flags.items()])
    placed = x.join(graph.connected(_t(spark, d, "edges")), ["rev", "id"], "left").groupBy("rev", F.coalesce("island", "id").alias("island"))
    summed = placed.agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(k).alias(k) for k in flags])
    listed = F.array_compact(F.array(*[F.when(F.col(k), k) for k in flags]))
    return summed.select("rev", "island", "n", F.array_join(listed, " ").alias("mechanisms"), (F.size(listed) > 0).alias("explained"))


def components(spark, d):
    return graph.connected(_t(spark, d, "edges"))


def islands_summary(spark, d):
    """Islands of symbols per revision: modules connect but are no members, and a symbol without links is an island; which were seen running, and which nothing explains."""
    traced = F.array_contains(F.split("mechanisms", " "), "traced")
    return island_mechanisms(spark, d).groupBy("rev").agg(F.sum("n").alias("symbols"), F.count(F.lit(1)).alias("islands"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(traced).alias("traced"), F.count_if(~F.col("explained")).alias("unexplained"))


def island_merge_split(spark, d):
    x = graph.connected(_t(spark, d, "edges")).join(_revs(spark, d), "rev").select(F.col("idx").alias("step"), "id", "island")
    return graph.merges_and_splits(x.withColumn("step", F.col("step") + 1), x)


def test_only_symbols(spark, d):
    """Functions outside tests that have callers, all of them in tests; not counting calls of themselves, dunders or public names."""
    calls = graph.links_only(_t(spark, d, "edges")).where("kind = 'CALLS' and src != dst").select("rev", "src", F.col("dst").alias("id")).distinct()
    judged = calls.groupBy("rev", "id").agg(F.every(names.is_test_path(F.substring_index("src", "::", 1))).alias("only"), F.count(F.lit(1)).alias("callers")).where("only")
    here = _symbols(spark, d).where("kind in ('function', 'method') and name_binding = 'live'").where(~names.is_test_path(F.col("path"))).where(~names.is_dunder(names.last_segment(F.col("qualname"))))
    return here.select("rev", "id").distinct().join(judged, ["rev", "id"]).select("rev", "id", "callers")


def token_scan(spark, d):
    """In how many texts each live name is mentioned as a word, outside the lines that define it."""
    texts = _t(spark, d, "blob_texts").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "content")
    defined = resolve.definitions(_t(spark, d, "blob_nodes")).where("kind in ('function', 'class') and name_binding = 'live' and not contains(qualname, '.')")
    # The names are few against the words, so that words are mostly dropped where they are read.
    wanted = broadcast_if_small(cut(defined.select(F.col("qualname").alias("word")).distinct()))
    spans = defined.select("blob_sha", F.col("qualname").alias("word"), "line_start", "line_end")
    hits = search.words_of(texts).join(wanted, "word", "left_semi").distinct().join(spans, ["blob_sha", "word"], "left")
    outside = hits.where("line_start is null or line < line_start or line > line_end").select("word", "blob_sha", "line").distinct()
    return outside.groupBy("word", "blob_sha").agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_lines"))


# ---- history


def _content(spark, d):
    """What a symbol is in each revision: its body and its links that are not weak."""
    strong = graph.links_only(_t(spark, d, "edges")).where("confidence in ('MEDIUM', 'HIGH')").select("rev", F.col("src").alias("id"), F.xxhash64("dst", F.lit("|"), "kind").alias("h")).distinct()
    links = strong.groupBy("rev", "id").agg(F.bit_xor("h").alias("links"), F.count(F.lit(1)).alias("n"))
    bodies = _symbols(spark, d).where("name_binding = 'live'").groupBy("rev", "id").agg(F.max("body_hash").alias("body_hash"))
    return bodies.join(links, ["rev", "id"], "left").join(_revs(spark, d), "rev").select("id", "idx", F.struct("body_hash", "links", "n").alias("state"))


def snapshot_diff(spark, d):
    """Symbols added, removed or changed (body, or links that are not weak) from revision to revision."""
    revs = _revs(spark, d)
    last = revs.agg(F.max("idx")).first()[0] or 0
    events = snapshots.change_events(snapshots.validity_intervals(_content(spark, d), ["id"], "state"), ["id"], "state", last)
    return events.join(revs, "idx").select("rev", "id", "change")


def move_pairing(spark, d):
    """Bodies that left and arrived between two revisions: a certain move if one of each, else only possible ones."""
    grouped = _sides(spark, d).groupBy("idx", "kind", "body_hash").agg(F.count_if(F.col("new") == 0).alias("n_removed"), F.count_if(F.col("new") == 1).alias("n_added"), F.min(F.when(F.col("new") == 0, F.col("id"))).alias("removed"), F.min(F.when(F.col("new") == 1, F.col("id"))).alias("added"))
    tier = F.when((F.col("n_removed") == 1) & (F.col("n_added") == 1), "MEDIUM").otherwise("LOW")
    return grouped.where("n_removed > 0 and n_added > 0").join(_revs(spark, d), "idx").select("rev", "kind", "body_hash", tier.alias("tier"), "n_removed", "n_added", "removed", "added")


def history_steps(spark, d):
    """Per revision: symbols, strong links and effects gained, lost and changed against the one before, and moves; links and effects are followed over certain moves."""
    revs = _revs(spark, d)
    last = revs.agg(F.max("idx")).first()[0] or 0
    moves, _ = _moves(spark, d)
    links, effects = _strong_differences(spark, d, moves, last)
    nodes = snapshot_diff(spark, d).join(revs, "rev").select("idx", F.concat(F.lit("symbols_"), "change").alias("c"))
    steps = nodes.unionByName(links.select("idx", F.concat(F.lit("edges_"), "change").alias("c"))).unionByName(effects.select("idx", F.concat(F.lit("effects_"), "change").alias("c"))).unionByName(moves.select("idx", F.lit("moves").alias("c")))
    counted = steps.groupBy("idx").agg(*[F.count_if(F.col("c") == c).alias(c) for c in ("symbols_added", "symbols_removed", "symbols_changed", "edges_added", "edges_removed", "effects_added", "effects_removed", "moves")])
    return counted.join(revs, "idx").drop("idx")


# ---- traces, scores, views


def trace_reconcile(spark, d):
    """Observed calls against static ones: confirmed at the first static call site, else added at the caller's own line."""
    edges = graph.links_only(_t(spark, d, "edges"))
    static = edges.where("kind = 'CALLS' and provenance = 'static'").groupBy("rev", "src", "dst").agg(F.min(F.struct("callsite_line", "callsite_path")).alias("site"))
    seen = edges.where("provenance = 'runtime'").select("rev", "src", "dst").distinct()
    at = _symbols(spark, d).groupBy("rev", F.col("id").alias("src")).agg(F.min("line_start").alias("line_start"))
    x = seen.join(static, ["rev", "src", "dst"], "left").join(at, ["rev", "src"], "left")
    return x.select("rev", "src", "dst", F.when(F.col("site").isNotNull(), "confirmed").otherwise("added").alias("status"), F.coalesce("site.callsite_path", F.substring_index("src", "::", 1)).alias("path"), F.coalesce("site.callsite_line", "line_start").alias("line"))


def trace_stale(spark, d):
    """Observed calls that no longer hold in the next revision, since a file at either end differs or is gone."""
    revs = _revs(spark, d)
    at = _snapshot(spark, d).join(revs, "rev").select("idx", "path", "blob_sha")
    changed = at.join(at.select((F.col("idx") - 1).alias("idx"), "path", F.col("blob_sha").alias("next")), ["idx", "path"], "left").where(~F.col("blob_sha").eqNullSafe(F.col("next"))).select("idx", "path")
    seen = graph.links_only(_t(spark, d, "edges")).where("provenance = 'runtime'").select("rev", "src", "dst").distinct().join(revs, "rev")
    end = lambda c: F.substring_index(c, "::", 1)
    ends = seen.select("rev", "idx", "src", "dst", F.explode(F.array_distinct(F.array(end("src"), end("dst")))).alias("path"))
    return ends.join(changed, ["idx", "path"], "left_semi").select("rev", "src", "dst").distinct()


def score_recall(spark, d):
    """Static links judged by observed ones, per revision: recall, recall without weak links, precision where the caller ran."""
    edges = graph.links_only(_t(spark, d, "edges")).where("kind = 'CALLS'")
    static = edges.where("provenance = 'static'").groupBy("rev", "src", "dst").agg(F.max(names.tier_rank(F.col("confidence"))).alias("rank"))
    seen = edges.where("provenance = 'runtime'").select("rev", "src", "dst", F.lit(True).alias("seen")).distinct()
    ran = seen.select("rev", "src", F.lit(True).alias("ran")).distinct()
    x = static.join(seen, ["rev", "src", "dst"], "full").join(ran, ["rev", "src"], "left")
    hit, strong = F.col("seen") & F.col("rank").isNotNull(), F.col("seen") & (F.col("rank") > 0)
    judged = F.col("rank").isNotNull() & F.coalesce("ran", F.lit(False))
    n = x.groupBy("rev").agg(F.count_if("seen").alias("observed"), F.count_if(hit).alias("hit"), F.count_if(strong).alias("strong"), F.count_if(judged).alias("judged"))
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    return n.select("rev", "observed", "judged", share("hit", "observed").alias("recall"), share("strong", "observed").alias("recall_strong"), share("hit", "judged").alias("precision"))


def fan_in_quartiles(spark, d):
    q = F.percentile("fan_in", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return fan_in(spark, d).groupBy("rev").agg(q.alias("q")).select("rev", *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(3)])


def _sizes(spark, d):
    texts = _t(spark, d, "blob_texts").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "n_bytes", F.size(F.split("content", "\n")).alias("lines")).groupBy("blob_sha").agg(F.max("n_bytes").alias("n_bytes"), F.max("lines").alias("lines"))
    return _snapshot(spark, d).join(texts, "blob_sha")


def lines_rollup(spark, d):
    """Lines below every folder of every revision."""
    x = _sizes(spark, d).withColumn("parts", F.split("path", "/"))
    up = x.select("rev", "lines", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("n"), "parts")
    return up.groupBy("rev", F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("folder")).agg(F.sum("lines").alias("n_lines"), F.count(F.lit(1)).alias("n_files"))


def source_budget(spark, d):
    """Files in path order while all bytes so far fit a budget of a million; the first that does not ends it."""
    summed = order.running_sums(_sizes(spark, d).select("rev", "path", "n_bytes"), "rev", ["path"], {"upto": F.col("n_bytes")})
    return summed.where("upto <= 1000000")


def preorder(spark, d):
    """Files in tree order: position, and the last position below the file's folder."""
    placed = order.running_sums(_snapshot(spark, d).select("rev", "path", F.split("path", "/").alias("parts")), "rev", ["parts"], {"pos": F.lit(1)})
    x = cut(placed.select("rev", "path", "pos", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")))
    parts = F.split("path", "/")
    below = x.select("rev", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
    return x.join(below.groupBy("rev", "folder").agg(F.max("pos").alias("folder_end")), ["rev", "folder"]).select("rev", "path", "pos", "folder_end")


# ---- parser, hierarchy, upkeep, pictures, streams


def _parsed(spark, d):
    return cut(python_source.parse_texts(_t(spark, d, "blob_texts").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "content"), hashes=False))


def parse_definitions(spark, d):
    """Definitions read from the delivered texts themselves: where they start, decorators included, and where those end that hold no other."""
    x = cut(python_source.relation(_parsed(spark, d), "nodes"))
    outer = x.select("blob_sha", names.parent_scope(F.col("qualname")).alias("qualname"), F.lit(True).alias("outer")).where("qualname is not null").distinct()
    return x.join(outer, ["blob_sha", "qualname"], "left").select("blob_sha", "qualname", "kind", F.col("decorated_from").alias("line_start"), F.when(F.col("outer").isNull(), F.col("line_end")).alias("line_end"), "name_binding", "shadow_index")


def resolve_texts(spark, d):
    """Links resolved from the delivered texts: parsed once per text, placed in every revision."""
    parsed = _parsed(spark, d)
    parts = [python_source.relation(parsed, x) for x in ("nodes", "refs", "imports", "bindings")]
    return imports.resolve_parsed(_snapshot(spark, d), *parts)[0]


def class_ancestors(spark, d):
    up = graph.links_only(_t(spark, d, "edges")).where("kind = 'INHERITS' and confidence = 'HIGH'").select("rev", F.col("src").alias("sub"), F.col("dst").alias("base"), F.coalesce("callsite_line", F.lit(0)).alias("ord"))
    return hierarchy.ancestors(up).select("rev", "cls", "anc", "depth")


def dirty_paths(spark, d):
    """What the working tree changes of the revision before it."""
    x = _snapshot(spark, d).join(_revs(spark, d), "rev")
    work = cut(x.where("rev = 'WORKTREE'"))
    head = x.join(work.select((F.col("idx") - 1).alias("idx")).distinct(), "idx", "left_semi")
    return incremental.dirty_paths(head, work)


def treemap_layout(spark, d):
    """Rectangles of the folders and files of every revision, by lines."""
    boxes = view.boxes(_sizes(spark, d).select("rev", "path", F.col("lines").alias("weight")))
    return view.treemap(boxes).select("rev", "box", *[F.bround(c).cast("long").alias(c) for c in "xywh"])


def bootstrap_ci(spark, d):
    """How many more callers observation adds to symbols, per revision, with an interval."""
    edges = graph.links_only(_t(spark, d, "edges")).where("kind = 'CALLS'").groupBy("rev", "src", "dst").agg(F.bool_or(F.col("provenance") == "static").alias("static")).groupBy("rev", "dst").agg(F.count_if("static").alias("a"), F.count(F.lit(1)).alias("b"))
    return evaluate.paired_bootstrap(edges.select(F.col("rev").alias("name"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))


def event_windows(spark, d):
    return streams.event_windows(_t(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, d):
    x = streams.user_sessions(_t(spark, d, "events"))
    return x.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        tree_snapshot, tree_overlay, content_address, blob_dedupe, parse_cache_antijoin, gc_removed, symbols, index_stats, path_modules, name_parts, absolute_imports, symbol_lookup,
        reference_owners, module_local, longest_prefix, last_segment_index, cascade, unresolved_pivot, unknown_rows, reference_ratio, hub_edges, containment_division,
        edge_collapse, edge_argmin, fan_in, salience_score, view_edges, override_pairs, impact_hops, impact_truncated, impact_ranked, impact_summary, direct_effects, glob_best_match, widest_path_effects, effect_summary, effect_witness, effects_with_hubs, islands_with_hubs, symbol_history,
        shortest_path, path_negative, island_mechanisms, components, islands_summary, island_merge_split, test_only_symbols, token_scan, snapshot_diff, move_pairing, history_steps, trace_reconcile, trace_stale, score_recall, fan_in_quartiles, lines_rollup, source_budget, preorder,
        parse_definitions, resolve_texts, class_ancestors, dirty_paths, treemap_layout, bootstrap_ci, event_windows, user_sessions,
    )
}

from graphmill.plans import symbol_graph_sql  # noqa: E402

ORACLES = symbol_graph_sql.ORACLES | symbol_graph_sql._late()
