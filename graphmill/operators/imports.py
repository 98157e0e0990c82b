"""Imports, re-exports, receivers: the whole cascade from parsed texts to links.

Every step is a join that yields (reference, target, rank); a reference keeps
the targets of its first step that has any.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.names import absolute_module, last_segment, module_of_path, package_of_path, tier_name
from graphmill.operators import hierarchy
from graphmill.operators.resolve import BUILTINS
from graphmill.workspace import broadcast_if_small, cut, drop, rows_of

#: Re-exports followed, one module after another.
REEXPORTS = 8

# Decorators that leave a call what it says.
TRANSPARENT = ("abstractmethod", "classmethod", "final", "overload", "override", "property", "staticmethod")


def import_map(tree: DataFrame, imports: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """What each name stands for in each module: ``rev``, ``path``, ``alias``, ``target``.

    The last import of a name counts; a plain ``import a.b`` binds ``a`` only if nothing else does. Stars bind nothing.
    """
    placed = tree.join(imports, "blob_sha").withColumn("here", module_of_path(F.col("path"), roots))
    package = package_of_path(F.col("path"), F.col("here"))
    base = absolute_module(F.col("module"), F.col("level"), package)
    top = F.substring_index("module", ".", 1)
    plain = F.col("name").isNull()
    alias = F.when(plain, F.coalesce("alias", top)).otherwise(F.coalesce("alias", "name"))
    target = F.when(plain & F.col("alias").isNull(), top).when(plain, F.col("module")).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), "name"))
    certain = (~plain | F.col("alias").isNotNull()).cast("int")
    rows = placed.where("name is null or name != '*'").select("rev", "path", alias.alias("alias"), target.alias("target"), certain.alias("certain"), "ordinal")
    return rows.groupBy("rev", "path", "alias").agg(F.max_by("target", F.struct("certain", "ordinal")).alias("target"))


def expand_heads(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names (``rev``, ``path``, ``name``) with ``dotted``: the first segment replaced by what it was imported as; null where it was not imported."""
    head, tail = F.substring_index("name", ".", 1), F.nullif(F.regexp_replace("name", r"^[^.]*\.?", ""), F.lit(""))
    return names.withColumn("alias", head).join(aliases, ["rev", "path", "alias"], "left").withColumn("dotted", F.when(F.col("target").isNotNull(), F.concat_ws(".", "target", tail))).drop("alias", "target")


def imported_symbols(symbols: DataFrame, aliases: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """``rev``, ``id`` of the symbols that some module imports by name: what an island may be entered through."""
    named = symbols.withColumn("dotted", F.concat_ws(".", F.nullif(module_of_path(F.col("path"), roots), F.lit("")), "qualname"))
    return named.join(aliases.select("rev", F.col("target").alias("dotted")).distinct(), ["rev", "dotted"], "left_semi").select("rev", "id").distinct()


def _splits(df: DataFrame, name: str) -> DataFrame:
    parts = F.split(name, r"\.")
    cuts = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))))
    return cuts.withColumns({"module": F.array_join(F.slice(parts, 1, F.col("n")), "."), "rest": F.array_join(F.slice(parts, F.col("n") + 1, F.size(parts)), ".")}).where("rest != ''")


def lookup_dotted(wanted: DataFrame, modules: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbols that dotted names mean: ``rev``, ``dotted``, ``dst``.

    A definition in the module with the longest name comes first; else the module's own import of the
    next part is followed, at most :data:`REEXPORTS` times and never back to a name seen before.

    :param wanted: ``rev``, ``dotted``
    :param modules: ``rev``, ``module``, ``file``
    :param symbols: ``file``, ``qualname``, ``id`` of live definitions
    :param aliases: ``file``, ``alias``, ``target``
    """
    live = symbols.select("file", F.col("qualname").alias("rest"), "id")
    state = cut(wanted.distinct().select("rev", "dotted", F.col("dotted").alias("now"), F.array("dotted").alias("seen")))
    done = None
    for _ in range(REEXPORTS + 1):
        if not rows_of(state):
            break
        split = cut(_splits(state, "now").join(modules, ["rev", "module"]))
        drop(state)
        hits = cut(split.join(live, ["file", "rest"]).groupBy("rev", "dotted").agg(F.max_by("id", "n").alias("dst")))
        done = hits if done is None else done.unionByName(hits)
        open_ = split.join(hits, ["rev", "dotted"], "left_anti").withColumn("alias", F.substring_index("rest", ".", 1))
        onward = open_.join(aliases, ["file", "alias"]).withColumn("next", F.concat_ws(".", "target", F.nullif(F.regexp_replace("rest", r"^[^.]*\.?", ""), F.lit(""))))
        fresh = onward.where(~F.array_contains("seen", F.col("next")))
        state = cut(fresh.groupBy("rev", "dotted").agg(F.max_by(F.struct("next", "seen"), "n").alias("x")).select("rev", "dotted", F.col("x.next").alias("now"), F.concat("x.seen", F.array("x.next")).alias("seen")))
        drop(split)
    return done if done is not None else wanted.join(modules, "rev").join(live, "file").select("rev", "dotted", F.col("id").alias("dst")).where(F.lit(False))


def resolve_parsed(tree: DataFrame, nodes: DataFrame, refs: DataFrame, imports: DataFrame, bindings: DataFrame, roots: Sequence[str] = (), more_steps: Sequence[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> tuple[DataFrame, DataFrame]:
    """Links and open references of parsed texts in every revision.

    Steps, the first that finds anything counts: 1 imported, 2 defined in the module, 3 ``super``, 4 ``self`` along the ancestors
    with overrides below, 5 a receiver all of whose bindings are known classes, 6 the only symbol of that last segment. A call of a
    class is also a call of the constructor it has. Calls through a decorator that may replace them are at most MEDIUM.

    Snapshots repeat each other, so whatever a text at a path decides alone (owners, aliases, what is bound and defined there) is done
    once per file, a pair of both; files, revisions and symbols travel as numbers, and names come back with the links.

    :param tree: ``rev``, ``path``, ``blob_sha``; the others are the relations of the parser
    :param more_steps: further steps, tried in turn after these: from the references (``rev``, ``path``, ``ordinal``, ``scope``, ``ref_kind``, ``name``,
        ``line``, ``src``) and the live symbols (``rev``, ``id``, ``path``, ``qualname``, ``kind``) to ``rev``, ``path``, ``ordinal``, ``dst``, ``rank``
    :returns: edges ``rev``, ``src``, ``dst``, ``kind``, ``confidence``, ``provenance``, ``callsite_path``, ``callsite_line``;
        and ``rev``, ``src``, ``path``, ``line``, ``raw_name``, ``ref_kind``, ``reason``, ``candidates``
    """
    tree = cut(tree.select("rev", "path", "blob_sha"))
    revs = broadcast_if_small(cut(tree.select("rev").distinct().withColumn("r", F.monotonically_increasing_id())))
    files = cut(tree.select("path", "blob_sha").distinct().withColumn("file", F.monotonically_increasing_id()))
    at = cut(tree.join(revs, "rev").join(files, ["path", "blob_sha"]).select("r", "file"))
    suffix = F.when(F.col("name_binding") == "shadowed", F.concat(F.lit("#"), F.col("shadow_index").cast("string"))).otherwise("")
    wraps = F.coalesce(F.exists("decorators", lambda x: ~F.substring_index(x, ".", -1).isin(*TRANSPARENT)), F.lit(False))
    symbols = cut(files.join(nodes, "blob_sha").select("file", "qualname", "kind", "line_start", "line_end", "name_binding", F.concat("path", F.lit("::"), "qualname", suffix).alias("id"), wraps.alias("wrapped")).withColumn("n", F.monotonically_increasing_id()))
    live = symbols.where("name_binding = 'live'")
    modules = cut(at.join(files.select("file", "path", module_of_path(F.col("path"), roots).alias("module")), "file").groupBy("r", "module").agg(F.min(F.struct("path", "file")).alias("x")).select(F.col("r").alias("rev"), "module", "x.file"))
    aliases = cut(import_map(files.select(F.col("file").alias("rev"), "path", "blob_sha"), imports, roots).where("alias is not null").select(F.col("rev").alias("file"), "alias", "target"))
    use = ["file", "ordinal"]
    key = ["r", *use]

    # A file with its revisions, definitions and aliases: no more than its text holds.
    defs = symbols.groupBy("file").agg(F.collect_list(F.struct("qualname", "id", "n", "line_start", "line_end", (F.col("name_binding") == "live").alias("live"))).alias("defs"))
    meanings = aliases.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("alias", "target"))).alias("aliases"))
    full = cut(files.join(at.groupBy("file").agg(F.collect_list("r").alias("rs")), "file").join(defs, "file", "left").join(meanings, "file", "left"))

    def defined(name: Column) -> Column:
        return F.get(F.filter("defs", lambda x: x["live"] & (x["qualname"] == name)), F.lit(0))["n"]

    def owners(which: Callable[[Column], Column]) -> Column:
        return F.array_min(F.transform(F.filter("defs", lambda x: (x["qualname"] == F.col("scope")) & which(x)), lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))))

    target, tail = F.col("aliases")[F.substring_index("name", ".", 1)], F.nullif(F.regexp_replace("name", r"^[^.]*\.?", ""), F.lit(""))
    # What a name means in its file: as it was imported, and defined there.
    meaning = {"dotted": F.when(target.isNotNull(), F.concat_ws(".", target, tail)), "here": defined(F.col("name"))}
    placed = refs.select("blob_sha", "ordinal", F.col("from_qualname").alias("scope"), "ref_kind", F.col("raw_name").alias("name"), "line").where("ref_kind != 'global'").join(full, "blob_sha")
    attributed = placed.withColumns({"a": owners(lambda x: F.col("line").between(x["line_start"], x["line_end"])), "b": owners(lambda x: x["live"]), "holder": F.regexp_replace("scope", r"\.[^.]+$", ""), **meaning})
    by_class = F.col("name").rlike(r"^<super>\.|^(self|cls)\.\w+$")
    uses = cut(attributed.select("file", "ordinal", "scope", "ref_kind", "name", "line", "path", F.coalesce("a.id", "b.id", F.concat("path", F.lit("::"), "scope")).alias("src"), F.coalesce("a.n", "b.n").alias("src_n"), F.when(by_class, defined(F.col("holder"))).alias("cls"), "dotted", "here", "rs"))
    calls = uses.where("ref_kind in ('call', 'value')")
    # A name that is defined in its file has its target in every revision: further steps are for the others.
    later = calls.where("here is null")

    received = later.where(F.col("name").rlike(r"^(self\.)?\w+\.\w+$") & ~F.col("name").rlike(r"^(self|cls)\.\w+$")).withColumns({"var": F.regexp_replace("name", r"\.\w+$", ""), "m": last_segment(F.col("name"))})
    there = F.when(F.startswith("var", F.lit("self.")), F.regexp_replace("scope", r"\.[^.]+$", "")).otherwise(F.col("scope"))
    scoped = received.withColumn("at", F.explode(F.array(F.struct(F.lit(0).alias("far"), there.alias("s")), F.struct(F.lit(1).alias("far"), F.lit("<module>").alias("s"))))).select(*use, "var", "m", "at.far", F.col("at.s").alias("bs"))
    # A variable that may also be None is still what else it is bound to; None alone says nothing.
    bound = bindings.where("kind != 'none'").select("blob_sha", F.col("scope").alias("bs"), F.col("name").alias("var"), F.col("kind").alias("bkind"), F.when(F.col("kind") != "opaque", F.col("type")).alias("name"))
    meant = cut(scoped.join(files.select("file", "blob_sha"), "file").join(bound, ["blob_sha", "bs", "var"]).select(*use, "m", "far", "bkind", "name").distinct())
    # One binding of the nearest scope that names no type leaves the receiver open, in every revision.
    near = meant.groupBy(*use, "far").agg(F.every(F.col("name").isNotNull()).alias("named"), F.count(F.lit(1)).alias("k")).groupBy(*use).agg(F.min(F.struct("far", "named", "k")).alias("x")).where("x.named").select(*use, "x.far", "x.k")
    known = cut(meant.join(near, [*use, "far"]).join(full.drop("blob_sha", "path"), "file").withColumns(meaning).select(*use, "m", "name", "k", "dotted", "here", "rs"))

    imported = cut(uses.unionByName(known, allowMissingColumns=True).where("dotted is not null").select("file", "name", "dotted", "here").distinct())
    found = lookup_dotted(imported.select("file", "dotted").distinct().join(at, "file").select(F.col("r").alias("rev"), "dotted"), modules, live.select("file", "qualname", F.col("n").alias("id")), aliases)
    hit = cut(imported.join(at, "file").join(found.withColumnRenamed("rev", "r"), ["r", "dotted"]).groupBy("file", "name", "dst").agg(F.collect_list("r").alias("found")))
    covered = hit.groupBy("file", "name").agg(F.flatten(F.collect_list("found")).alias("covered"))
    rest = imported.where("here is not null").join(covered, ["file", "name"], "left").join(full.select("file", "rs"), "file")
    rest = rest.select("file", "name", F.col("here").alias("dst"), F.when(F.col("covered").isNull(), F.col("rs")).otherwise(F.array_except("rs", "covered")).alias("found")).where("size(found) > 0")
    plain = cut(hit.unionByName(rest))

    def means(names: DataFrame) -> DataFrame:
        """What names mean by import or in their file: ``dst`` in the revisions ``rs``."""
        by_import = names.where("dotted is not null").drop("rs").join(plain, ["file", "name"]).withColumnRenamed("found", "rs")
        return by_import.unionByName(names.where("dotted is null and here is not null").withColumn("dst", F.col("here")))

    based = means(uses.where("ref_kind = 'base'"))
    inherits = based.where("src_n is not null").select(F.explode("rs").alias("rev"), F.col("src_n").alias("sub"), F.col("dst").alias("base"), F.col("ordinal").alias("ord"))
    roots_only = live.where("kind = 'class'").join(at, "file").select(F.col("r").alias("rev"), F.col("n").alias("cls"))
    order = hierarchy.ancestors(inherits)
    lone = roots_only.join(order.select("rev", "cls").distinct(), ["rev", "cls"], "left_anti").select("rev", "cls", F.col("cls").alias("anc"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("way"))
    order = cut(order.unionByName(lone))
    holders = live.select("file", F.col("qualname").alias("holder"), F.col("n").alias("cls"))
    held = live.where("kind = 'method'").select("file", F.regexp_replace("qualname", r"\.[^.]+$", "").alias("holder"), last_segment(F.col("qualname")).alias("m"), F.col("n").alias("id")).join(holders, ["file", "holder"])
    methods = cut(held.join(at, "file").select(F.col("r").alias("rev"), "cls", "m", "id"))
    nearest = cut(hierarchy.nearest_methods(order, methods).select(F.col("rev").alias("r"), "cls", "m", "id"))
    above, below = [x.withColumnRenamed("rev", "r") for x in (hierarchy.nearest_methods(order, methods, own=False), hierarchy.overriding_methods(order, methods))]

    in_class = later.where("cls is not null").select(*use, "cls", "name")
    to_super = in_class.where(F.startswith("name", F.lit("<super>."))).withColumn("m", F.substr("name", F.lit(9))).join(above, ["cls", "m"]).select(*key, F.col("id").alias("dst"), F.lit(3).alias("step"), F.lit(2).alias("rank"))
    on_self = in_class.where(~F.startswith("name", F.lit("<super>."))).withColumn("m", last_segment(F.col("name")))
    declared = cut(on_self.join(nearest, ["cls", "m"]).select(*key, "cls", "m", F.col("id").alias("dst"), F.lit(4).alias("step"), F.lit(2).alias("rank")))
    overridden = declared.select(*key, "cls", "m").join(below, ["r", "cls", "m"]).select(*key, F.col("id").alias("dst"), F.lit(4).alias("step"), F.lit(1).alias("rank"))
    inherited = cut(to_super.unionByName(declared.drop("cls", "m")).unionByName(overridden))

    classes = means(known).join(live.where("kind = 'class'").select(F.col("n").alias("dst")), "dst", "left_semi").select(*use, "m", "k", F.col("dst").alias("cls"), F.explode("rs").alias("r"))
    judged = classes.join(nearest.select("r", "cls", "m", F.col("id").alias("dst")), ["r", "cls", "m"])
    sure = judged.groupBy(*key, "k").agg(F.collect_set("dst").alias("targets"), F.count(F.lit(1)).alias("hit")).where("hit = k")
    by_receiver = cut(sure.select(*key, F.explode("targets").alias("dst"), F.lit(5).alias("step"), F.when(F.col("k") > 1, 1).otherwise(2).alias("rank")))

    index = cut(live.select("file", last_segment(F.col("qualname")).alias("segment"), "n").join(at, "file").groupBy("r", "segment").agg(F.count(F.lit(1)).alias("candidates"), F.min("n").alias("only")))
    alone = index.where("candidates = 1").select("r", "segment", F.col("only").alias("dst"))
    segment = later.where("ref_kind = 'call'").where(~F.col("name").isin(*BUILTINS)).select(*use, last_segment(F.col("name")).alias("segment"), "rs").join(alone.select("segment").distinct(), "segment", "left_semi")
    last = segment.select(*use, "segment", F.explode("rs").alias("r")).join(alone, ["r", "segment"]).select(*key, "dst", F.lit(6).alias("step"), F.lit(1).alias("rank"))

    # ``other`` is the id of a target that is no symbol of the revision, as only further steps can name one.
    offers = reduce(DataFrame.unionByName, [inherited, by_receiver, last]).withColumn("other", F.lit(None).cast("string"))
    if more_steps:
        by_rev = at.join(revs, "r").join(files.select("file", "path"), "file")
        ids = by_rev.join(symbols.select("file", "id", "qualname", "kind", "name_binding", "n"), "file")
        asked = by_rev.join(calls.select("file", "ordinal", "scope", "ref_kind", "name", "line", "src"), "file").select("rev", "path", "ordinal", "scope", "ref_kind", "name", "line", "src")
        for i, step in enumerate(more_steps):
            more = step(asked, ids.where("name_binding = 'live'").select("rev", "id", "path", "qualname", "kind")).select("rev", "path", "ordinal", F.col("dst").alias("id"), F.col("rank").cast("int").alias("rank"))
            more = more.join(by_rev, ["rev", "path"]).join(ids.select("rev", "id", "n"), ["rev", "id"], "left").join(later.select(*use), use, "left_semi")
            offers = offers.unionByName(more.select(*key, F.col("n").alias("dst"), F.lit(7 + i).alias("step"), "rank", F.when(F.col("n").isNull(), F.col("id")).alias("other")))
    offers = offers.join(later.where("dotted is not null").select(*use, "name").join(hit, ["file", "name"]).select(*use, F.explode("found").alias("r")), key, "left_anti")
    # A reference has few targets here: those of its receiver, or a method and what overrides it.
    first = offers.withColumn("first", F.min("step").over(Window.partitionBy(*key))).where("step = first")
    won = cut(first.groupBy(*key, "dst", "other").agg(F.max("rank").alias("rank")).groupBy(*use, "dst", "other", "rank").agg(F.collect_list("r").alias("rs")))

    site = [*use, "ref_kind", "src", "path", "line"]
    linked = means(calls).select(*site, "dst", F.lit(None).cast("string").alias("other"), F.lit(2).alias("rank"), "rs")
    linked = cut(linked.unionByName(later.select(*site).join(broadcast_if_small(won), use).select(*site, "dst", "other", "rank", "rs")))
    init = cut(nearest.where("m = '__init__'").groupBy(F.col("cls").alias("dst"), F.col("id").alias("init")).agg(F.collect_list("r").alias("with")))
    built = linked.where("other is null").join(broadcast_if_small(init), "dst").select(*site, F.col("init").alias("dst"), "other", "rank", F.array_intersect("rs", "with").alias("rs")).where("size(rs) > 0")
    parts = cut(linked.unionByName(built).groupBy(*site, "dst", "other").agg(F.collect_list(F.struct("rank", "rs")).alias("parts")))
    single, several = parts.where("size(parts) = 1"), parts.where("size(parts) > 1").withColumn("x", F.explode("parts"))
    several = several.select(*site, "dst", "other", "x.rank", F.explode("x.rs").alias("r")).groupBy(*site, "dst", "other", "r").agg(F.max("rank").alias("rank"))
    ranked = single.select(*site, "dst", "other", F.col("parts")[0]["rank"].alias("rank"), F.col("parts")[0]["rs"].alias("rs")).unionByName(several.select(*site, "dst", "other", "rank", F.array("r").alias("rs")))
    targets = symbols.select(F.col("n").alias("dst"), "id", "wrapped")
    rank = F.when((F.col("ref_kind") == "call") & F.coalesce("wrapped", F.lit(False)), F.least("rank", F.lit(1))).otherwise(F.col("rank"))
    kind = F.when(F.col("ref_kind") == "call", "CALLS").otherwise("REFERENCES")
    shape = ["rev", "src", F.coalesce("other", "id").alias("dst"), "kind", "confidence", F.lit("static").alias("provenance"), F.col("path").alias("callsite_path"), F.col("line").alias("callsite_line")]
    edges = ranked.join(targets, "dst", "left").withColumn("r", F.explode("rs")).join(revs, "r").withColumns({"kind": kind, "confidence": tier_name(rank)}).select(*shape)
    parents = based.join(targets, "dst").withColumn("r", F.explode("rs")).join(revs, "r").withColumns({"kind": F.lit("INHERITS"), "confidence": F.lit("HIGH"), "other": F.lit(None)}).select(*shape)

    done = ranked.select(*use, F.explode("rs").alias("r")).distinct()
    open_ = uses.where("ref_kind = 'call'").withColumn("r", F.explode("rs")).join(done, key, "left_anti").withColumn("segment", last_segment(F.col("name")))
    open_ = open_.join(index, ["r", "segment"], "left").join(revs, "r")
    reason = F.when(F.col("name").isin(*BUILTINS) | F.startswith("name", F.lit("open!")), "builtin").when(F.col("dotted").isNotNull(), "external").when(F.col("candidates") > 1, "ambiguous").otherwise("unknown")
    return edges.unionByName(parents), open_.select("rev", "src", "path", "line", F.col("name").alias("raw_name"), "ref_kind", reason.alias("reason"), F.when(reason == "ambiguous", F.col("candidates")).otherwise(0).alias("candidates"))
