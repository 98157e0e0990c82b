"""From references by name to links between symbols: joins with a symbol table, first match wins.

References are content-addressed, so what a name means inside its own text is
decided once per text; only imports and the index of last segments depend on
the snapshot.
"""

from __future__ import annotations

import builtins
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.names import glob_regex, last_segment, module_of_path, tier_rank
from graphmill.functions.text import plain_sha
from graphmill.operators.snapshots import latest_rows
from graphmill.workspace import broadcast_if_small, cut

BUILTINS = tuple(sorted(x for x in dir(builtins) if not x.startswith("_")))


@dataclass(frozen=True)
class Rule:
    """An effect of calling what matches a glob. Without a tier of its own: HIGH if literal, LOW if it starts with a wildcard, else MEDIUM."""

    match: str
    effect: str
    confidence: str | None = None
    override: bool = False

    @property
    def prefix(self) -> int:
        return min([self.match.find(c) for c in "*?[" if c in self.match], default=len(self.match))

    @property
    def tier(self) -> str:
        return self.confidence or ("HIGH" if self.prefix == len(self.match) else "LOW" if self.prefix == 0 else "MEDIUM")


#: The built-in catalogue: what libraries do. ``GLOBAL_MUTATE`` has no rule, it is read from the syntax.
CATALOGUE = (
    Rule("requests.*", "NETWORK"),
    *(Rule(f"requests.{verb}", "NETWORK") for verb in ("get", "post", "put", "patch", "delete", "head", "options", "request")),
    Rule("httpx.*", "NETWORK"),
    Rule("urllib.request.*", "NETWORK"),
    Rule("socket.*", "NETWORK"),
    Rule("subprocess.*", "PROCESS"),
    Rule("os.system", "PROCESS"),
    Rule("os.exec*", "PROCESS"),
    Rule("os.environ*", "ENV_READ"),
    Rule("os.getenv", "ENV_READ"),
    Rule("open", "FS_READ"),
    Rule("open!write", "FS_WRITE"),
    Rule("open!ambiguous", "FS_READ", "MEDIUM"),
    Rule("pathlib.Path.read*", "FS_READ"),
    Rule("pathlib.Path.write*", "FS_WRITE"),
    Rule("shutil.*", "FS_WRITE"),
    Rule("*.session.commit", "DB_WRITE"),
    Rule("*.session.add", "DB_WRITE"),
    Rule("*.execute", "DB_WRITE"),
    Rule("*.fetchone", "DB_READ"),
    Rule("*.fetchall", "DB_READ"),
    Rule("*.fetchmany", "DB_READ"),
    Rule("boto3.*", "DB_WRITE"),
    Rule("random.*", "NONDETERMINISM"),
    Rule("time.time", "NONDETERMINISM"),
    Rule("uuid.uuid4", "NONDETERMINISM"),
    Rule("datetime.datetime.now", "NONDETERMINISM"),
)


def best_rule(name: Column, rules: Sequence[Rule]) -> Column:
    """``struct<effect, rank, match>`` of the rule with the longest literal prefix, then overrides first, then the greatest pattern; null for none.

    Precedence does not depend on the name, so the rules form one chain of conditions: no join, no sort.
    """
    out = F.lit(None).cast("struct<effect:string,rank:int,match:string>")
    for rule in sorted(rules, key=lambda r: (r.prefix, r.override, r.match)):
        hit = name == rule.match if rule.prefix == len(rule.match) else name.rlike(glob_regex(rule.match))
        out = F.when(hit, F.struct(F.lit(rule.effect).alias("effect"), tier_rank(F.lit(rule.tier)).alias("rank"), F.lit(rule.match).alias("match"))).otherwise(out)
    return out


def definitions(nodes: DataFrame) -> DataFrame:
    """Rows of definitions once each, shas in lower case."""
    return nodes.where(F.col("qualname").isNotNull()).withColumn("blob_sha", plain_sha(F.col("blob_sha"))).where("blob_sha is not null").select("blob_sha", "ordinal", "qualname", "kind", "line_start", "line_end", "body_hash", "name_binding", "shadow_index").distinct()


def materialize_nodes(snapshot: DataFrame, nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Symbols of every revision, and a module symbol per path.

    ``id`` is ``path::qualname``, with ``#n`` for the n-th shadowed definition.
    """
    suffix = F.when(F.col("name_binding") == "shadowed", F.concat(F.lit("#"), F.coalesce(F.col("shadow_index").cast("string"), F.lit("")))).otherwise("")
    symbols = snapshot.join(definitions(nodes), "blob_sha").select("rev", F.concat("path", F.lit("::"), "qualname", suffix).alias("id"), "path", "qualname", "kind", "line_start", "line_end", "body_hash", "name_binding")
    hashes = blobs.groupBy(plain_sha(F.col("blob_sha")).alias("blob_sha")).agg(F.max("module_body_hash").alias("body_hash"))
    modules = snapshot.join(hashes, "blob_sha", "left").select("rev", F.concat("path", F.lit("::<module>")).alias("id"), "path", F.lit("<module>").alias("qualname"), F.lit("module").alias("kind"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "body_hash", F.lit("live").alias("name_binding"))
    return symbols.unionByName(modules)


def references(refs: DataFrame) -> DataFrame:
    """Rows of references once each, with a name; scope ``<module>`` where none is given."""
    scope = F.coalesce(F.nullif(F.regexp_replace("from_qualname", r"\.<locals>$", ""), F.lit("")), F.lit("<module>"))
    return refs.where(F.col("raw_name").isNotNull()).withColumn("blob_sha", plain_sha(F.col("blob_sha"))).where("blob_sha is not null").select("blob_sha", "ordinal", scope.alias("scope"), "ref_kind", F.btrim("raw_name", F.lit(" \t\n\r\x0b\x0c")).alias("name"), F.nullif("dotted", F.lit("")).alias("dotted"), "line").distinct()


def owners(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The definition a reference stands in: of its scope's name, the one whose lines hold it, else the live one.

    :returns: ``refs`` with ``owner``: the definition's local id (``qualname`` or ``qualname#n``), or the scope itself
    """
    local = F.concat("qualname", F.when(F.col("name_binding") == "shadowed", F.concat(F.lit("#"), F.coalesce(F.col("shadow_index").cast("string"), F.lit("")))).otherwise(""))
    scopes = definitions(nodes).select("blob_sha", F.col("qualname").alias("scope"), "line_start", "line_end", local.alias("local"), (F.col("name_binding") == "live").alias("live"))
    joined = refs.join(scopes, ["blob_sha", "scope"], "left")
    inside = F.col("line").between(F.col("line_start"), F.col("line_end"))
    found = joined.groupBy(*refs.columns).agg(F.min(F.when(inside, F.col("local"))).alias("__in"), F.min(F.when(F.col("live"), F.col("local"))).alias("__live"))
    return found.select(*refs.columns, F.coalesce("__in", "__live", "scope").alias("owner"))


def local_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``refs`` with ``local``, the live definition in the same text that a bare name or a ``self.`` name means, and its ``step``.

    Step 2: a bare name is a top-level definition; step 3: ``self.m`` is the method of the class that
    encloses the scope.
    """
    live = definitions(nodes).where("name_binding = 'live'").select("blob_sha", F.col("qualname").alias("local")).distinct().withColumn("there", F.lit(True))
    in_class = F.col("scope").rlike(r"(^|\.)[^.<>]+\.[^.]+$")
    method = F.when(F.col("name").rlike(r"^self\.\w+$") & in_class, F.concat(F.regexp_replace("scope", r"\.[^.]+$", ""), F.substr("name", F.lit(5))))
    wanted = refs.withColumn("local", F.when(~F.col("name").contains("."), F.col("name")).otherwise(method))
    joined = wanted.join(live, ["blob_sha", "local"], "left")
    return joined.select(*refs.columns, F.when(F.col("there"), F.col("local")).alias("local"), F.when(F.col("there"), F.when(F.col("name").contains("."), 3).otherwise(2)).alias("step"))


def imported_targets(dotted: DataFrame, snapshot: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest module prefix of dotted names: ``rev``, ``dotted``, ``dst``.

    A dotted name is split at every dot; of the splits whose first part is a module of the revision and
    whose rest is a live definition in it, the longest first part counts.
    """
    modules = snapshot.select("rev", module_of_path(F.col("path")).alias("module"), "path", "blob_sha").groupBy("rev", "module").agg(F.min(F.struct("path", "blob_sha")).alias("m")).select("rev", "module", "m.path", "m.blob_sha")
    live = definitions(nodes).where("name_binding = 'live'").select("blob_sha", F.col("qualname").alias("rest")).distinct()
    parts = F.split("dotted", r"\.")
    cuts = dotted.where(F.col("dotted").contains(".")).withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    splits = cuts.select("rev", "dotted", "n", F.array_join(F.slice(parts, 1, F.col("n")), ".").alias("module"), F.array_join(F.slice(parts, F.col("n") + 1, F.size(parts)), ".").alias("rest"))
    hits = splits.join(modules, ["rev", "module"]).join(live, ["blob_sha", "rest"])
    return hits.groupBy("rev", "dotted").agg(F.max_by(F.concat("path", F.lit("::"), "rest"), "n").alias("dst"))


def name_index(symbols: DataFrame) -> DataFrame:
    """Live symbols by last segment: ``rev``, ``segment``, ``candidates``, ``only`` (the id where there is one)."""
    live = symbols.where("name_binding = 'live' and kind != 'module'").select("rev", last_segment(F.col("qualname")).alias("segment"), "id").distinct()
    return live.groupBy("rev", "segment").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("only"))


def reaching_names(symbols: DataFrame) -> DataFrame:
    """Names under which an ambiguous reference can mean a symbol: ``rev``, ``id``, ``hub``; its own last segment, and for a constructor also its class's."""
    live = symbols.where("name_binding = 'live' and kind != 'module'").select("rev", "id", "path", "qualname", "kind").distinct()
    own = live.select("rev", "id", last_segment(F.col("qualname")).alias("hub"))
    built = live.where("kind = 'method' and endswith(qualname, '.__init__')").select("rev", "id", "path", F.regexp_replace("qualname", r"\.__init__$", "").alias("qualname"))
    classes = live.where("kind = 'class'").select("rev", "path", "qualname")
    return own.unionByName(built.join(classes, ["rev", "path", "qualname"], "left_semi").select("rev", "id", last_segment(F.col("qualname")).alias("hub"))).distinct()


def resolve(tree: DataFrame, nodes: DataFrame, refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every call and base of every revision, resolved by the first step that knows it.

    Steps: 1 imported, 2 in the module, 3 on ``self``, 4 the only symbol of that last segment. Names with
    several candidates stay ``ambiguous`` (the pairs are not listed), then come ``builtin``, ``external`` (an import of something
    outside) and ``unknown``.

    :returns: ``rev``, ``path``, ``ordinal``, ``src``, ``name``, ``ref_kind``, ``line``, ``dst``, ``step``, ``rank``, ``reason``, ``candidates``
    """
    snapshot = latest_rows(tree)
    local = local_targets(owners(references(refs).where("ref_kind in ('call', 'base')"), nodes), nodes)
    placed = cut(snapshot.join(local, "blob_sha"))
    imported = imported_targets(placed.where("dotted is not null").select("rev", "dotted").distinct(), snapshot, nodes)
    index = name_index(materialize_nodes(snapshot, nodes, blobs))
    # Most references are no dotted ones; only these are shuffled by their name.
    known = placed.where("dotted is not null").join(imported, ["rev", "dotted"], "left").select(*placed.columns, "dst")
    x = known.unionByName(placed.where("dotted is null").withColumn("dst", F.lit(None).cast("string"))).withColumn("segment", last_segment(F.col("name"))).join(index, ["rev", "segment"], "left")
    bare = F.col("name").isin(*BUILTINS)
    by_name = (F.col("candidates") == 1) & ~bare
    here = F.concat("path", F.lit("::"), "local")
    step = F.when(F.col("dst").isNotNull(), 1).when(F.col("local").isNotNull(), F.col("step")).when(by_name, 4)
    target = F.coalesce("dst", here, F.when(by_name, F.col("only")))
    reason = F.when(step.isNotNull(), F.lit(None)).when(bare, "builtin").when(F.col("dotted").isNotNull(), "external").when(F.col("candidates") > 1, "ambiguous").otherwise("unknown")
    rank = F.when(step == 4, 1).when(step.isNotNull(), 2)
    return x.select("rev", "path", "ordinal", F.concat("path", F.lit("::"), "owner").alias("src"), "name", "ref_kind", "line", target.alias("dst"), step.alias("step"), rank.alias("rank"), reason.alias("reason"), F.when(reason == "ambiguous", F.col("candidates")).otherwise(0).alias("candidates"))


def first_party_names(names: DataFrame, snapshot: DataFrame, roots: Sequence[str] = ("src",)) -> DataFrame:
    """``rev``, ``name`` of the dotted names of which any prefix, or the whole, is a module of the revision."""
    modules = snapshot.select("rev", module_of_path(F.col("path"), roots).alias("module")).where("module != ''").distinct()
    parts = F.split("name", r"\.")
    prefixes = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module"))
    return modules.join(broadcast_if_small(cut(prefixes)), "module").select("rev", "name").distinct()


def direct_effects(tree: DataFrame, refs: DataFrame, rules: Sequence[Rule], roots: Sequence[str] = ("src",)) -> DataFrame:
    """Effects of calls by rule, and of ``global`` statements: ``rev``, ``id``, ``effect``, ``rank``, ``line``; one row per symbol, effect and tier, at its first line.

    Rules that are no overrides describe libraries, so in revisions that define a module a name leads into, only overrides apply to it.
    """
    snapshot = latest_rows(tree)
    called = F.coalesce("dotted", "name")
    mutates = F.struct(F.lit("GLOBAL_MUTATE").alias("effect"), F.lit(2).alias("rank"), F.lit("").alias("match"))
    known = references(refs).where("ref_kind in ('call', 'global')").withColumn("name", F.when(F.col("ref_kind") == "call", called)).groupBy("blob_sha", "scope", "name").agg(F.min("line").alias("line"))
    hits = known.withColumns({"any": F.when(F.col("name").isNull(), mutates).otherwise(best_rule(F.col("name"), rules)), "own": F.when(F.col("name").isNull(), mutates).otherwise(best_rule(F.col("name"), [r for r in rules if r.override]))})
    hits = cut(hits.where("any is not null"))
    inside = first_party_names(hits.where("not any <=> own").select("name").distinct(), snapshot, roots).withColumn("inside", F.lit(True))
    placed = snapshot.join(hits, "blob_sha").join(broadcast_if_small(cut(inside)), ["rev", "name"], "left")
    hit = F.when(F.col("inside"), F.col("own")).otherwise(F.col("any"))
    found = placed.select("rev", F.concat("path", F.lit("::"), "scope").alias("id"), hit.alias("hit"), "line").where("hit is not null")
    return found.groupBy("rev", "id", "hit.effect", "hit.rank").agg(F.min("line").alias("line"))


def containing_classes(symbols: DataFrame, required: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Relational division: classes that have all methods of a protocol without descending from it.

    Methods count along the ancestors, for the class and for the protocol. Protocols without methods, other protocols and heirs
    of the protocol have no rows. Each protocol is looked up by its rarest method only. Pairs are more than both sides, so all that
    decides about one travels with its sides, and nothing is shuffled or written after the join: first masks of 64 bits are compared, then the
    names themselves, then the ancestors.

    :param symbols: ``rev``, ``id``, ``path``, ``qualname``, ``kind``
    :param required: ``rev``, ``protocol`` (the id of a class)
    :param order: ``rev``, ``cls``, ``anc``, ``depth``; without it only methods defined in the class itself count
    :returns: ``rev``, ``protocol``, ``id``
    """
    methods = symbols.where("kind = 'method'").select("rev", F.concat("path", F.lit("::"), F.regexp_replace("qualname", r"\.[^.]+$", "")).alias("id"), last_segment(F.col("qualname")).alias("m")).distinct()
    if order is not None:
        above = order.where("depth > 0").select("rev", F.col("cls").alias("heir"), F.col("anc").alias("id"))
        methods = methods.unionByName(above.join(methods, ["rev", "id"]).select("rev", F.col("heir").alias("id"), "m")).distinct()
    methods = cut(methods)
    protocols = required.select("rev", "protocol").distinct()
    mask = F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(m), 64L) AS int)))").alias("mask")
    sets = methods.join(protocols.withColumnRenamed("protocol", "id"), ["rev", "id"], "left_anti").groupBy("rev", "id").agg(F.collect_set("m").alias("has"), mask)
    frequency = methods.groupBy("rev", "m").agg(F.count(F.lit(1)).alias("n"))
    needs = cut(methods.join(protocols.withColumnRenamed("protocol", "id"), ["rev", "id"], "left_semi").join(frequency, ["rev", "m"]).groupBy("rev", F.col("id").alias("protocol")).agg(F.collect_set("m").alias("needs"), mask.alias("need"), F.min_by("m", F.struct("n", "m")).alias("m")))
    if order is None:
        sets = sets.withColumn("ancestors", F.lit(None).cast("array<string>"))
    else:
        sets = sets.join(above.groupBy("rev", F.col("heir").alias("id")).agg(F.collect_list(above["id"]).alias("ancestors")), ["rev", "id"], "left")
    asked = needs.select("rev", "m").distinct()
    offered = sets.withColumn("m", F.explode("has")).join(asked, ["rev", "m"], "left_semi")
    holds = (F.col("mask").bitwiseAND(F.col("need")) == F.col("need")) & F.forall("needs", lambda x: F.array_contains("has", x))
    return needs.join(offered, ["rev", "m"]).where(holds & ~F.coalesce(F.array_contains("ancestors", F.col("protocol")), F.lit(False))).select("rev", "protocol", "id")
