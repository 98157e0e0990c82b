"""The command line: ``python -m graphmill COMMAND --data FOLDER``.

Exit codes: 0 for an answer, 1 where nothing matches a name, 2 where several symbols do (all are listed), 3 for an
answer with a blocking gap under ``--strict``, 64 for a call that makes no sense. Reports are printed as text or, with ``--json``, as JSON; their rows
are within limits, everything behind them stays distributed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import names
from graphmill.functions.text import plain_sha
from graphmill.operators import graph, imports, incremental, report, resolve, snapshots, traces, view
from graphmill.operators.resolve import CATALOGUE
from graphmill.page import render_html
from graphmill.plans import reports, symbol_graph
from graphmill.sources import files, git, python_source
from graphmill.workspace import build_session, cut, table

NO_MATCH, MANY, INCOMPLETE, USAGE = 1, 2, 3, 64

#: Rows per report, hops, and matches of a name that are listed.
LIMITS = {"impact": 40, "unknowns": 40, "islands": 20, "orphans": 20, "history": 40, "diff": 40}
HOPS = {"impact": 3, "path": 6, "unknowns": 3}
MATCHES = 200

BEGIN, END = "# >>> graphmill >>>", "# <<< graphmill <<<"
GUIDE = ("Ask who depends on a symbol before changing it:", "    python -m graphmill impact SYMBOL --strict", "A code of 3 says that the answer has a gap; `unknowns SYMBOL` says where.")
HOOK = ("python -m graphmill index --quiet || true",)
SESSION_HOOK = ('test -z "$SESSION_ID" || git interpret-trailers --in-place --trailer "Session: $SESSION_ID" "$1"',)


@dataclass
class Answer:
    summary: dict
    groups: dict[str, list[dict]] = field(default_factory=dict)
    unknowns: list[dict] = field(default_factory=list)
    truncated: bool = False

    def gap(self, reason: str, detail: str = "") -> None:
        blocking, action = report.NEXT_ACTIONS.get(reason, (True, "look into it"))
        self.unknowns.append({"reason": reason, "detail": detail, "action": action, "blocking": blocking})


def show(answer: Answer, as_json: bool, strict: bool) -> int:
    if as_json:
        groups = [{"title": t, "rows": rows} for t, rows in answer.groups.items()]
        print(json.dumps({"summary": answer.summary, "groups": groups, "truncated": answer.truncated, "unknowns": answer.unknowns}, default=str))
    else:
        print(" · ".join(f"{k}: {'none' if v in (None, '', []) else v}" for k, v in answer.summary.items()))
        for title, rows in answer.groups.items():
            print(f"\n{title}")
            for row in rows:
                print("  " + "  ".join(str(v) for v in row.values() if v not in (None, "")))
        if answer.truncated:
            print("\n... more rows than listed")
        for x in answer.unknowns:
            print(f"\nunknown: {x['reason']} {x['detail']}\n  next: {x['action']}")
    blocking = [x["reason"] for x in answer.unknowns if x["blocking"]]
    if strict and blocking:
        print(f"incomplete: {', '.join(blocking)}", file=sys.stderr)
        return INCOMPLETE
    return 0


class Store:
    """The tables of a data folder, seen at one revision."""

    def __init__(self, spark: SparkSession, data: str, rev: str | None) -> None:
        self.spark, self.data = spark, data
        order = snapshots.delivered_revisions(self.table("revisions"), self.table("tree")).orderBy("idx").collect()  # one row a revision
        self.revs = [r.rev for r in order]
        if rev is not None and rev not in self.revs:
            raise LookupError(f"no revision {rev}")
        self.rev = rev or (self.revs[-1] if self.revs else "")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.data, name)

    def at(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("rev") == self.rev)

    def symbols(self) -> DataFrame:
        return self.at(symbol_graph._symbols(self.spark, self.data))

    def edges(self) -> DataFrame:
        return self.at(self.table("edges"))

    def ambiguity(self) -> graph.Ambiguity:
        a = symbol_graph._ambiguity(self.spark, self.data)
        return graph.Ambiguity(cut(self.at(a.names)), cut(self.at(a.refs)))

    def find(self, asked: str) -> list[str]:
        """Ids that a name stands for: as an id, else as a qualified name, else as the end of one; without regard to case."""
        q, i, wanted = F.lower("qualname"), F.lower("id"), asked.lower()
        stage = F.when(i == wanted, 1).when(q == wanted, 2).when(F.endswith(q, F.lit("." + wanted)), 3)
        hits = cut(self.symbols().withColumn("stage", stage).where("stage is not null").select("stage", "id").distinct())
        first = hits.agg(F.min("stage")).first()[0]
        return [r.id for r in hits.where(F.col("stage") == first).orderBy("id").limit(MATCHES).collect()] if first else []

    def one(self, asked: str) -> str:
        found = self.find(asked)
        if len(found) != 1:
            for x in found:
                print(x)
            print(f"{'several symbols match' if found else 'no symbol matches'} {asked!r}", file=sys.stderr)
            raise SystemExit(MANY if found else NO_MATCH)
        return found[0]


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict() for r in (df if limit is None else df.limit(limit)).collect()]


# ---- questions about a revision


def status(store: Store, a) -> Answer:
    return Answer({"revision": store.rev} | {k: v for r in rows(store.at(symbol_graph.index_stats(store.spark, store.data))) for k, v in r.items() if k != "rev"})


def resolve_name(store: Store, a) -> Answer:
    found = store.find(a.query)
    for x in found:
        print(x)
    raise SystemExit(0 if len(found) == 1 else MANY if found else NO_MATCH)


def effects(store: Store, a) -> Answer:
    symbol = store.one(a.symbol)
    direct = resolve.direct_effects(store.at(store.table("tree")), store.table("blob_refs"), _rules(a))
    ways = graph.effect_witnesses(store.edges(), direct).withColumn("severity", names.position(F.col("effect"), names.SEVERITY))
    mine = ways.where(F.col("id") == symbol).orderBy("severity", F.col("rank").desc(), "effect").select("effect", names.tier_name(F.col("rank")).alias("tier"), "hops", "next")
    out = Answer({"symbol": symbol, "effects": None}, {"effects": rows(mine)})
    out.summary["effects"] = ", ".join(r["effect"] for r in out.groups["effects"])
    _gaps(store, out, symbol, ("unknown", "external"))
    return out


def impact(store: Store, a) -> Answer:
    symbol = store.one(a.symbol)
    open_ = store.ambiguity()
    edges, symbols = store.edges(), store.symbols()
    reached, truncated = graph.reach_back(edges, store.spark.createDataFrame([(store.rev, symbol)], "rev string, start string"), a.hops, open_)
    known = graph.ranked_nodes(symbols, edges, open_).join(symbols.select("id", "path", "line_start").dropDuplicates(["id"]), "id")
    x = reached.drop("rev").join(known.drop("rev"), "id")
    test = F.startswith("path", F.lit("tests/")) | F.startswith(F.regexp_replace("id", r"^.*(::|\.)", ""), F.lit("test_"))
    weak = (F.col("rank") == 0) & F.lit(not a.all)
    x = x.withColumns({"score": F.round(names.impact_score(F.col("hop"), F.col("rank"), F.col("salience")), 6), "section": F.when(weak, "low_confidence").when(test, "tests").otherwise("dependents")})
    x = cut(x)
    counted = x.agg(F.count_if(~weak).alias("symbols"), F.count_distinct(F.when(~weak, F.col("path"))).alias("modules"), F.count_if(~weak & (F.col("fan_in") == 0)).alias("entry_points"), F.count_if(weak).alias("low")).first()
    kept, left = {}, a.limit
    for section, most in (("dependents", a.limit), ("tests", a.limit), ("low_confidence", min(5, a.limit))):
        budget = most if section == "low_confidence" else left
        here = rows(x.where(F.col("section") == section).orderBy(F.col("score").desc(), "id").select("id", F.concat_ws(":", "path", "line_start").alias("location"), F.concat(F.lit("hop "), "hop", F.lit(", "), names.tier_name(F.col("rank")), F.when(F.col("observed"), ", observed").otherwise("")).alias("detail"), "score"), budget)
        if here:
            kept[section] = here
        left -= len(here) if section != "low_confidence" else 0
    listed = sum(len(v) for k, v in kept.items() if k != "low_confidence")
    reach = graph.widest_effects(edges, resolve.direct_effects(store.at(store.table("tree")), store.table("blob_refs"), _rules(a))).where(F.col("id") == symbol)
    out = Answer({"symbol": symbol, "symbols": counted.symbols, "modules": counted.modules, "entry_points": counted.entry_points, "low_confidence_hidden": counted.low - len(kept.get("low_confidence", [])), "effects_reachable": ", ".join(sorted({r.effect for r in reach.select("effect").distinct().collect()}))}, kept, truncated=counted.symbols > listed)
    if truncated.first().truncated:
        out.gap("hop_limit", f"more lies beyond {a.hops} hops")
    return out


def path(store: Store, a) -> Answer:
    one, other = store.one(a.source), store.one(a.target)
    open_, edges = store.ambiguity(), store.edges()
    ends = store.spark.createDataFrame([(store.rev, one, other), (store.rev, other, one)], "rev string, start string, goal string").distinct()
    links, weak = (edges, open_) if a.all else (edges.where("confidence in ('MEDIUM', 'HIGH')"), None)
    found = graph.shortest_paths(links, ends, a.hops, weak).orderBy("hops", F.col("rank").desc(), "nodes").limit(1).collect()
    out = Answer({"from": one, "to": other, "hops": found[0].hops if found else None})
    if found:
        out.groups["path"] = [{"id": n} for n in found[0].nodes]
        return out
    if longer := graph.distances(links, ends, weak).agg(F.min("hops")).first()[0]:
        out.gap("hop_limit", f"takes {longer} hops")
    elif not a.all and (longer := graph.distances(edges, ends, open_).agg(F.min("hops")).first()[0]):
        out.gap("low_confidence", f"{longer} hops over weak links")
    else:
        islands = {r.id: r.island for r in graph.connected(edges).where(F.col("id").isin(one, other)).collect()}
        out.summary["reason"] = "no_path" if islands.get(one) is not None and islands.get(one) == islands.get(other) else "other_island"
    return out


def _rules(a):
    config = getattr(a, "config", None)
    return (*CATALOGUE, *files.read_rules(config)) if config else CATALOGUE


def _gaps(store: Store, out: Answer, symbol: str, reasons: tuple[str, ...]) -> None:
    left = store.at(symbol_graph._resolved(store.spark, store.data)).where((F.col("src") == symbol) & F.col("reason").isin(*reasons)).groupBy("reason").count().collect()  # four reasons
    for r in sorted(left, key=lambda r: reasons.index(r.reason)):
        out.gap(r.reason, f"{r['count']} references")


def unknowns(store: Store, a) -> Answer:
    symbol = store.one(a.symbol)
    order = ("unknown", "ambiguous", "external", "builtin")
    x = store.at(symbol_graph._resolved(store.spark, store.data)).where((F.col("src") == symbol) & F.col("reason").isNotNull())
    listed = graph.budget(x.withColumn("turn", names.position(F.col("reason"), order)), ["src"], [F.col("turn"), F.col("path"), F.col("line"), F.col("name"), F.col("ordinal")], a.limit)
    got = rows(listed.orderBy("place").select("reason", "name", F.concat_ws(":", "path", "line").alias("location"), "candidates", "truncated"))
    island = graph.connected(store.edges()).where(F.col("id") == symbol).select("island").first()
    out = Answer({"symbol": symbol, "unknowns": len(got), "island": island.island if island else symbol}, {"unknowns": [{k: v for k, v in r.items() if k != "truncated"} for r in got]}, truncated=any(r["truncated"] for r in got))
    _gaps(store, out, symbol, order)
    _, truncated = graph.reach_back(store.edges(), store.spark.createDataFrame([(store.rev, symbol)], "rev string, start string"), a.hops)
    if truncated.first().truncated:
        out.gap("hop_limit", f"more lies beyond {a.hops} hops")
    return out


def islands(store: Store, a) -> Answer:
    x = cut(store.at(symbol_graph.island_mechanisms(store.spark, store.data)))
    n = x.agg(F.sum("n").alias("symbols"), F.count(F.lit(1)).alias("islands"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(~F.col("explained")).alias("unexplained"), F.count_if(F.contains("mechanisms", F.lit("traced"))).alias("traced")).first()
    heads = {r.island: r.hubs for r in store.at(reports.island_hubs(store.spark, store.data)).groupBy("island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda h: h["id"]), ", ").alias("hubs")).join(x.orderBy(F.col("n").desc(), "island").limit(a.limit).select("island"), "island").collect()}
    listed = rows(x.orderBy(F.col("n").desc(), "island").select("island", "n", "mechanisms"), a.limit)
    out = Answer(n.asDict(), {"islands": [r | {"hubs": heads.get(r["island"], "")} for r in listed]}, truncated=n.islands > len(listed))
    if n.unexplained:
        out.gap("unexplained_island", f"{n.unexplained} islands")
    return out


def orphans(store: Store, a) -> Answer:
    x = cut(store.at(reports.orphans(store.spark, store.data, a.include_public, a.include_decorated)))
    return Answer({"orphans": x.count(), "basis": "recorded callers and mentions in source", "caveat": "a name put together while running leaves no mention"}, {"orphans": rows(x.orderBy("id").drop("rev"), a.limit)}, truncated=x.count() > a.limit)


# ---- questions about several revisions


def _range(store: Store, asked: str | None) -> list[str]:
    """Revisions after the first up to the last of ``base..head``; all but the first where nothing is asked."""
    if not asked:
        return store.revs[1:]
    base_, _, head = asked.partition("..")
    for x in filter(None, (base_, head)):
        if x not in store.revs:
            raise LookupError(f"no revision {x}")
    first = store.revs.index(base_) if base_ else 0
    return store.revs[first + 1 : store.revs.index(head) + 1 if head else None]


def diff(store: Store, a) -> Answer:
    """What changed from one revision to another, the two need not be neighbours."""
    base_, _, head = (a.range or "").partition("..")
    base_, head = base_ or (store.revs[-2] if len(store.revs) > 1 else store.rev), head or store.revs[-1]
    _range(store, f"{base_}..{head}")
    both = symbol_graph._content(store.spark, store.data).join(store.spark.createDataFrame([(base_, 0), (head, 1)], "rev string, side int").join(symbol_graph._revs(store.spark, store.data), "rev").select("idx", "side"), "idx")
    one, other = (both.where(F.col("side") == s).select("id", F.col("state").alias(f"s{s}")) for s in (0, 1))
    x = cut(one.join(other, "id", "full").where(~F.col("s0").eqNullSafe(F.col("s1"))).select("id", F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").otherwise("changed").alias("change")))
    near = symbol_graph._strong(store.table("edges")).where(F.col("rev").isin(base_, head) & (F.col("src") != F.col("dst"))).select("rev", "src", F.col("dst").alias("id")).distinct().groupBy("rev", "id").agg(F.count(F.lit(1)).alias("dependents"))
    ranked = x.withColumn("rev", F.when(F.col("change") == "removed", base_).otherwise(head)).join(near, ["rev", "id"], "left").select("change", "id", F.coalesce("dependents", F.lit(0)).alias("dependents"))
    counted = {r.change: r["count"] for r in x.groupBy("change").count().collect()}  # three kinds
    effects_ = cut(graph.widest_effects(store.table("edges").where(F.col("rev").isin(base_, head)), resolve.direct_effects(store.table("tree").where(F.col("rev").isin(base_, head)), store.table("blob_refs"), _rules(a))))
    touched = x.where("change != 'removed'").select("id")
    fresh = effects_.where(F.col("rev") == head).select("id", "effect").join(touched, "id", "left_semi").join(effects_.where(F.col("rev") == base_).select("id", "effect"), ["id", "effect"], "left_anti")
    summary = {"base": base_, "head": head} | {c: counted.get(c, 0) for c in ("added", "removed", "changed")} | {"new_effects": ", ".join(sorted(r.effect for r in fresh.select("effect").distinct().collect()))}
    groups = {c: rows(ranked.where(F.col("change") == c).orderBy(F.col("dependents").desc(), "id").drop("change"), a.limit) for c in ("added", "removed", "changed") if counted.get(c)}
    return Answer(summary, groups, truncated=any(counted[c] > len(g) for c, g in groups.items()))


def history(store: Store, a) -> Answer:
    wanted = a.range if a.range else a.symbol if a.symbol and ".." in a.symbol else None
    revs = _range(store, wanted)
    if a.symbol and ".." not in a.symbol:
        symbol = store.one(a.symbol)
        x = symbol_graph.symbol_history(store.spark, store.data).where(F.col("rev").isin(*revs))
        order = symbol_graph._revs(store.spark, store.data)
        placed = {r.rev: r.idx for r in order.collect()}
        found, now = [], symbol
        for rev in sorted(revs, key=placed.get, reverse=True):  # backwards over the revisions, along certain moves
            row = x.where((F.col("rev") == rev) & (F.col("id") == now)).first()
            if row is None:
                continue
            found.append({k: v for k, v in row.asDict().items() if v})
            if row.lineage_ambiguous:
                break
            now = row.moved_from or now
        out = Answer({"symbol": symbol, "revisions": len(revs), "touched": len(found), "first_id": now}, {"history": found[::-1][: a.limit]}, truncated=len(found) > a.limit)
        if found and found[-1].get("lineage_ambiguous"):
            out.gap("lineage_ambiguous", now)
        return out
    x = reports.range_report(store.spark, store.data).where(F.col("rev").isin(*revs) & (F.col("place") <= a.limit)).collect()  # at most 40 a revision
    groups: dict[str, list[dict]] = {}
    for r in sorted(x, key=lambda r: (revs.index(r.rev), r.place)):
        groups.setdefault(r.rev, []).append({"id": r.id, "detail": r.detail, "score": r.score})
    if a.islands:
        for r in symbol_graph.island_merge_split(store.spark, store.data).join(symbol_graph._revs(store.spark, store.data).withColumnRenamed("idx", "step"), "step").where(F.col("rev").isin(*revs)).orderBy("step", "change", "island").limit(a.limit).collect():
            groups.setdefault(r.rev, []).append({"id": r.island, "detail": f"islands: {r.change} of {r.n_parts}", "score": 2.5})
    return Answer({"revisions": len(revs), "changed": len(groups), "base": wanted.partition("..")[0] if wanted else store.revs[0] if store.revs else "", "head": revs[-1] if revs else ""}, groups)


# ---- keeping the tables


def _write(df: DataFrame, data: str, name: str) -> None:
    """Replace a table: written beside it first, as it may be made from what it replaces."""
    fresh, old = f"{data}/.{name}.{os.getpid()}", f"{data}/{name}.parquet"
    df.write.mode("overwrite").parquet(fresh)
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(data).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(where(old), True)
    if not fs.rename(where(fresh), where(old)):
        raise OSError(f"could not replace {old}")


def _held(spark: SparkSession, data: str, name: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{data}/{name}.parquet")
    return table(spark, data, name) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def index(spark: SparkSession, a) -> int:
    """Bring the tables up to date with a folder: texts that are new are parsed, the revision is resolved again."""
    os.makedirs(a.data, exist_ok=True)
    rev = a.rev or "WORKTREE"
    held = {} if a.rebuild else {n: _held(spark, a.data, n) for n in ("tree", "blobs", "blob_nodes", "blob_refs", "blob_imports", "blob_bindings", "blob_texts", "edges", "revisions")}
    found = cut(files.read_tree(spark, os.path.abspath(a.root), rev))
    texts = found.select("blob_sha", "content").dropDuplicates(["blob_sha"])
    parsed = cut(python_source.parse_texts(python_source.unparsed(texts, held["blobs"]) if held.get("blobs") is not None else texts))
    merged: dict[str, DataFrame] = {}

    def keep(name: str, fresh: DataFrame, old: DataFrame | None) -> None:
        merged[name] = cut(fresh if old is None else old.unionByName(fresh, allowMissingColumns=True))

    for name in ("nodes", "refs", "imports", "bindings"):
        old = held.get(f"blob_{name}")
        fresh = python_source.relation(parsed, name)
        keep(f"blob_{name}", fresh, None if old is None else incremental.replace_blobs(old, fresh.limit(0)).join(parsed.select("blob_sha"), "blob_sha", "left_anti"))
    status_ = parsed.select("blob_sha", "status", "error", "parser_version", "module_body_hash")
    keep("blobs", status_, None if held.get("blobs") is None else held["blobs"].join(status_.select("blob_sha"), "blob_sha", "left_anti"))
    keep("blob_texts", parsed.select("blob_sha").join(texts, "blob_sha").withColumn("n_bytes", F.octet_length("content").cast("long")), None if held.get("blob_texts") is None else held["blob_texts"].join(parsed.select("blob_sha"), "blob_sha", "left_anti"))
    now = F.current_timestamp().cast("timestamp_ntz")
    tree = found.select("rev", "path", "blob_sha")
    keep("tree", tree.withColumn("ingested_at", now), None if held.get("tree") is None else incremental.drop_revision(held["tree"], rev))
    links, _ = imports.resolve_parsed(tree, *[merged[f"blob_{n}"].join(tree.select("blob_sha").distinct(), "blob_sha", "left_semi") for n in ("nodes", "refs", "imports", "bindings")])
    keep("edges", links.withColumn("ingested_at", now), None if held.get("edges") is None else incremental.drop_revision(held["edges"], rev))
    at = spark.createDataFrame([(rev, "worktree" if rev == "WORKTREE" else "commit", int(time.time()), incremental.fingerprint(tree))], "rev string, kind string, materialized_at bigint, fingerprint string")
    keep("revisions", at, None if held.get("revisions") is None else incremental.drop_revision(held["revisions"], rev))
    for name, df in merged.items():
        _write(df, a.data, name)
    if not a.quiet:
        print(f"revision: {rev} · paths: {found.count()} · parsed: {parsed.count()} · errors: {parsed.where(F.col('status') == 'error').count()} · links: {merged['edges'].where(F.col('rev') == rev).count()}")
    return 0


def gc(store: Store, a) -> int:
    """Texts that no revision to keep holds go, with all that was read from them."""
    keep = a.keep or store.revs[-2:]
    gone = cut(incremental.garbage(store.table("blobs"), store.table("tree"), keep))
    for name in ("blobs", "blob_nodes", "blob_refs", "blob_imports", "blob_bindings", "blob_texts"):
        held = _held(store.spark, store.data, name)
        if held is not None:
            _write(cut(held.withColumn("__s", plain_sha(F.col("blob_sha"))).join(gone.withColumnRenamed("blob_sha", "__s"), "__s", "left_anti").select(*held.columns)), store.data, name)
    print(f"removed: {gone.count()} · kept: {', '.join(keep) or 'none'}")
    return 0


def trace(store: Store, a) -> int:
    """Take in a recorded run, or forget those of a revision: observed calls are links of their own provenance."""
    edges = store.table("edges")
    static = edges.where(~((F.col("rev") == store.rev) & (F.col("provenance") == "runtime")))
    if a.forget:
        _write(cut(static), store.data, "edges")
        print(f"forgot what ran at {store.rev}")
        return 0
    if not a.file:
        seen = graph.links_only(store.edges()).where("provenance = 'runtime'")
        print(f"observed: {seen.select('src', 'dst').distinct().count()}")
        return 0
    calls, ran = files.read_trace(store.spark, a.file)
    try:
        name, calls, ran = traces.import_trace(calls, ran, store.symbols())
    except traces.TraceMismatch as e:
        print(e, file=sys.stderr)
        return NO_MATCH
    placed = cut(traces.project(calls, store.edges().where("kind = 'CALLS' and provenance = 'static'"), store.symbols(), store.spark.createDataFrame([], "path string")))
    seen = placed.where("status in ('confirmed', 'added')").select(F.lit(store.rev).alias("rev"), "src", "dst", F.lit("CALLS").alias("kind"), F.lit("HIGH").alias("confidence"), F.lit("runtime").alias("provenance"), F.col("path").alias("callsite_path"), F.col("line").cast("int").alias("callsite_line"), F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"))
    _write(cut(static.unionByName(seen, allowMissingColumns=True)), store.data, "edges")
    print(f"run {name}: {traces.describe(placed)}")
    return 0


def visualize(store: Store, a) -> int:
    """One page of a revision: folders and files by their lines, and the heaviest links between files."""
    sized = store.at(symbol_graph._sizes(store.spark, store.data))
    boxes = cut(view.boxes(sized.select("rev", "path", F.col("lines").alias("weight"))))
    drawn = [{"id": r.box, "name": r.name, "depth": r.depth, "x": r.x, "y": r.y, "w": r.w, "h": r.h} for r in view.treemap(boxes).join(boxes.select("rev", "box", "name", "depth"), ["rev", "box"]).orderBy("depth", "box").collect()]
    ends = graph.links_only(store.edges()).select("rev", F.substring_index("src", "::", 1).alias("src"), F.substring_index("dst", "::", 1).alias("dst"), "kind", names.tier_rank(F.col("confidence")).alias("rank"))
    shown = sized.select("rev", F.col("path").alias("id"), F.col("path").alias("shown"))
    links = [{"a": r.a, "b": r.b, "rank": r["rank"]} for r in view.bundles(ends, shown).where("drawn").orderBy("a", "b", "kind", "rank").collect()]  # 120 a kind and tier
    summary = {k: v for r in rows(store.at(reports.view_summary(store.spark, store.data))) for k, v in r.items()}
    marked = []
    if a.highlight:
        with open(a.highlight) as f:
            asked = store.spark.createDataFrame([("r", f.read())], "report string, json string")
        marked = sorted({r.id.partition("::")[0] for r in report.highlighted(asked).collect()})
    source = None
    if not a.no_source:
        from graphmill.operators import order

        summed = order.running_sums(sized.select("rev", "path", "blob_sha", "n_bytes"), "rev", ["path"], {"upto": F.col("n_bytes")}).where(F.col("upto") <= a.source_budget)
        source = {r.path: r.content for r in summed.join(reports._texts(store.spark, store.data), "blob_sha").select("path", "content").collect()}  # source_budget bytes
    page = render_html(f"graphmill {store.rev}", {"boxes": drawn, "links": links, "highlight": marked, "summary": summary, "width": view.WIDTH, "height": view.HEIGHT}, source)
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(page)
    print(f"{a.out}: {len(drawn)} boxes, {len(links)} links, {len(page)} bytes")
    return 0


# ---- files around the tables


def with_block(text: str, block: tuple[str, ...], remove: bool = False) -> str:
    """A text with exactly one marked block, in the place of the first there was, else at the end; or with none. Markers that do not pair up are refused."""
    out: list[str] = []
    inside, placed = False, remove
    for line in text.split("\n"):
        if line in (BEGIN, END):
            if inside == (line == BEGIN):
                raise ValueError("markers do not pair up")
            inside = not inside
            if inside and not placed:
                out += [BEGIN, *block, END]
                placed = True
        elif not inside:
            out.append(line)
    if inside:
        raise ValueError("markers do not pair up")
    if not placed:
        while out and not out[-1]:
            out.pop()
        out += [BEGIN, *block, END, ""]
    return "\n".join(out)


def _edit(path_: str, block: tuple[str, ...], remove: bool = False, executable: bool = False) -> bool:
    """Put a block into a file, or take it out. A hook that is no shell script is left alone."""
    before = ""
    if os.path.exists(path_):
        with open(path_, "rb") as f:
            raw = f.read()
        try:
            before = raw.decode("utf-8")
        except UnicodeDecodeError:
            return False
        first = before.partition("\n")[0]
        if executable and before and not (first.startswith("#!") and "sh" in first.rpartition("/")[2]):
            return False
    elif remove:
        return True
    after = with_block(before or ("#!/bin/sh\n" if executable else ""), block, remove)
    if after != before:
        os.makedirs(os.path.dirname(path_) or ".", exist_ok=True)
        with open(path_, "w", encoding="utf-8") as f:
            f.write(after)
    if executable:
        os.chmod(path_, 0o755)
    return True


def around(a) -> int:
    """The commands that need no tables."""
    if a.command == "guide":
        print("\n".join(GUIDE))
        return 0
    if a.command == "init":
        _edit(os.path.join(a.root, "AGENTS.md"), GUIDE)
        _edit(os.path.join(a.root, ".gitignore"), (".graphmill/",))
        return 0
    hooks = os.path.join(a.root, ".git", "hooks")
    if not os.path.isdir(os.path.join(a.root, ".git")):
        print("no repository", file=sys.stderr)
        return NO_MATCH
    wanted = {"install-hooks": [("post-commit", HOOK), ("post-checkout", HOOK), ("post-merge", HOOK)], "install-session-hook": [("commit-msg", SESSION_HOOK)]}[a.command]
    for name, block in wanted:
        if not _edit(os.path.join(hooks, name), block, getattr(a, "uninstall", False), executable=True):
            print(f"{name}: not a shell script, left alone", file=sys.stderr)
    return 0


def sessions(spark: SparkSession, a) -> int:
    found = files.session_trailers(git.commit_messages(spark, a.root, a.revspec or "HEAD")).where(F.size("sessions") > 0).collect()  # one row a commit
    listed = [{"commit": r.commit, "sessions": r.sessions} for r in found]
    print(json.dumps(listed) if a.json else "\n".join(f"{x['commit'][:12]} {' '.join(x['sessions'])}" for x in listed) or "none")
    return 0


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        print(f"{self.prog}: {message}", file=sys.stderr)
        raise SystemExit(USAGE)


ASKED = {"status": status, "resolve": resolve_name, "effects": effects, "impact": impact, "path": path, "unknowns": unknowns, "islands": islands, "orphans": orphans, "diff": diff, "history": history}
KEPT = {"gc": gc, "trace": trace, "visualize": visualize}


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="graphmill")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--root", default=".")
        p.add_argument("--data", default=".graphmill")
        p.add_argument("--rev")
        for x in positional:
            p.add_argument(x.rstrip("?"), nargs="?" if x.endswith("?") else None)
        if name in LIMITS:
            p.add_argument("--limit", type=_positive, default=LIMITS[name])
        if name in HOPS:
            p.add_argument("--hops", type=_positive, default=HOPS[name])
        if name in ASKED:
            p.add_argument("--json", action="store_true")
            p.add_argument("--strict", action="store_true")
            p.add_argument("--config")
        return p

    command("status")
    for x in ("--rebuild", "--quiet"):
        (i := command("index") if x == "--rebuild" else i).add_argument(x, action="store_true")
    command("resolve", "query")
    command("effects", "symbol")
    command("impact", "symbol").add_argument("--all", action="store_true")
    command("path", "source", "target").add_argument("--all", action="store_true")
    command("unknowns", "symbol")
    command("islands")
    o = command("orphans")
    o.add_argument("--include-public", action="store_true")
    o.add_argument("--include-decorated", action="store_true")
    command("diff", "range?")
    command("history", "symbol?", "range?").add_argument("--islands", action="store_true")
    command("gc").add_argument("--keep", action="append", default=[])
    command("init")
    command("trace", "file?").add_argument("--forget", action="store_true")
    v = command("visualize")
    v.add_argument("--out", default="graphmill.html")
    v.add_argument("--highlight")
    v.add_argument("--no-source", action="store_true")
    v.add_argument("--source-budget", type=int, default=1_000_000)
    command("guide")
    command("install-hooks")
    command("sessions", "revspec?").add_argument("--json", action="store_true")
    command("install-session-hook").add_argument("--uninstall", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
        if a.command in ("guide", "init", "install-hooks", "install-session-hook"):
            return around(a)
        spark = spark or build_session(os.environ.get("GRAPHMILL_MASTER", "local[*]"), **{"spark.log.level": "ERROR"})
        if a.command == "index":
            return index(spark, a)
        if a.command == "sessions":
            return sessions(spark, a)
        store = Store(spark, a.data, a.rev)
        if a.command in KEPT:
            return KEPT[a.command](store, a)
        return show(ASKED[a.command](store, a), a.json, a.strict)
    except LookupError as e:
        print(e, file=sys.stderr)
        return NO_MATCH
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 1
