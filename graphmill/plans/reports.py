"""Reports over the delivered tables: what is not used, what a revision changed, what is at the heart of islands, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import names
from graphmill.functions.text import plain_sha
from graphmill.operators import graph, search, snapshots
from graphmill.plans import symbol_graph as base
from graphmill.plans import symbol_graph_sql as sql
from graphmill.workspace import broadcast_if_small, cut, table

#: Source roots of the project; the empty one holds every path.
ROOTS = ("", "src")

#: Rows of a revision in the report of a range, and of an island's most called symbols.
RANGE_LIMIT, ISLAND_HUBS = 40, 3


def _texts(spark, d):
    return table(spark, d, "blob_texts").select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "content").where("blob_sha is not null").groupBy("blob_sha").agg(F.max("content").alias("content"))


def _callers(spark, d, only=None):
    """Distinct callers per symbol, ambiguous ones included and the symbol itself not; of those that ``only`` accepts by their path."""
    path = lambda c: F.substring_index(c, "::", 1)
    wanted = (lambda c: F.lit(True)) if only is None else (lambda c: only(path(c)))
    edges = table(spark, d, "edges").where("kind = 'CALLS' and src != dst").where(wanted(F.col("src")))
    open_ = base._ambiguity(spark, d, ("call",))
    refs = cut(open_.refs.where(wanted(F.col("src"))))
    counted = graph.fan_in(edges, graph.Ambiguity(open_.names, refs))
    itself = open_.names.join(refs.withColumnRenamed("src", "id"), ["rev", "id", "hub"], "left_semi").select("rev", "id").distinct().withColumn("self", F.lit(1))
    return counted.join(itself, ["rev", "id"], "left").select("rev", "id", (F.col("fan_in") - F.coalesce("self", F.lit(0))).alias("callers")).where("callers > 0")


def orphans(spark, d, include_public=False, include_decorated=False, roots=ROOTS):
    """Functions outside tests all of whose recorded callers are tests, and whose names no other source text mentions.

    Recorded are calls and ambiguous calls, of others than the function itself. Dunders never count; public names (without a
    leading underscore) and decorated functions count only if asked for. A mention is a word in a text that is no test, outside
    the definitions of that name in its own file. A list to look at, not to delete.
    """
    own = names.last_segment(F.col("qualname"))
    here = base._symbols(spark, d).where("kind in ('function', 'method') and name_binding = 'live'").where(~names.is_test_path(F.col("path")) & names.under_source_root(F.col("path"), roots) & ~names.is_dunder(own))
    if not include_public:
        here = here.where(F.startswith(own, F.lit("_")))
    if not include_decorated:
        decorated = table(spark, d, "blob_nodes").where(F.size("decorators") > 0).select(plain_sha(F.col("blob_sha")).alias("blob_sha"), "qualname").distinct()
        here = here.join(base._snapshot(spark, d).join(decorated, "blob_sha").select("rev", "path", "qualname"), ["rev", "path", "qualname"], "left_anti")
    others = _callers(spark, d, lambda p: ~names.is_test_path(p))
    judged = here.select("rev", "id", "path", own.alias("word"), "line_start", "line_end").join(_callers(spark, d), ["rev", "id"]).join(others.select("rev", "id"), ["rev", "id"], "left_anti")
    candidates = cut(judged)
    wanted = broadcast_if_small(cut(candidates.select("word").distinct()))
    mentions = cut(search.words_of(_texts(spark, d)).join(wanted, "word", "left_semi"))
    sources = base._snapshot(spark, d).where(~names.is_test_path(F.col("path")) & names.under_source_root(F.col("path"), roots))
    placed = sources.join(mentions, "blob_sha").join(broadcast_if_small(cut(candidates.select("rev", "word").distinct())), ["rev", "word"], "left_semi")
    spans = candidates.select("rev", "path", "word", "line_start", "line_end")
    held = placed.join(spans, ["rev", "path", "word"], "left").groupBy("rev", "path", "word", "line").agg(F.max(F.coalesce(F.col("line").between(F.col("line_start"), F.col("line_end")), F.lit(False))).alias("inside"))
    mentioned = held.where("not inside").select("rev", "word").distinct()
    return candidates.join(mentioned, ["rev", "word"], "left_anti").select("rev", "id", "callers")


def relationships(spark, d):
    """How many pairs of a source and an ambiguous name each revision leaves open."""
    return base._ambiguity(spark, d).refs.groupBy("rev").agg(F.count(F.lit(1)).alias("deferred"))


def island_hubs(spark, d):
    """The most called symbols of every island of two or more: modules connect, but are not listed."""
    calls = graph.fan_in(table(spark, d, "edges"), base._ambiguity(spark, d))
    members = base._symbols(spark, d).where("kind != 'module'").select("rev", "id").distinct().join(graph.connected(table(spark, d, "edges")), ["rev", "id"])
    ranked = members.join(calls, ["rev", "id"], "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    return graph.budget(ranked, ["rev", "island"], [F.col("fan_in").desc(), F.col("id")], ISLAND_HUBS).select("rev", "island", "place", "id", "fan_in")


def view_summary(spark, d):
    """The numbers above a picture of a revision: files, bytes, links stored and drawn, by kind and by tier, observed ones, and names left open."""
    drawn = base.view_edges(spark, d)
    kinds = [F.count_if(F.col("kind") == k).alias(f"kind_{k.lower()}") for k in names.EDGE_KINDS]
    tiers = [F.count_if(F.col("rank") == i).alias(f"tier_{t.lower()}") for i, t in enumerate(names.TIERS)]
    counted = drawn.groupBy("rev").agg(F.count(F.lit(1)).alias("edges_drawn"), F.count_if("observed").alias("observed"), *kinds, *tiers)
    stored = graph.links_only(table(spark, d, "edges")).groupBy("rev").agg(F.count(F.lit(1)).alias("edges_stored"))
    files = base._sizes(spark, d).groupBy("rev").agg(F.count(F.lit(1)).alias("files"), F.sum("n_bytes").alias("source_bytes"))
    x = files.join(stored, "rev", "left").join(counted, "rev", "left").join(relationships(spark, d), "rev", "left")
    return x.na.fill(0)


def _changes(spark, d):
    """What each revision added, removed and changed (bodies): ``idx``, ``id``, ``change``."""
    revs = base._revs(spark, d)
    last = revs.agg(F.max("idx")).first()[0] or 0
    bodies = base._symbols(spark, d).where("name_binding = 'live'").join(revs, "rev").groupBy("id", "idx").agg(F.max("body_hash").alias("body_hash"))
    return cut(snapshots.change_events(snapshots.validity_intervals(bodies, ["id"], "body_hash"), ["id"], "body_hash", last)), revs, last


def range_report(spark, d):
    """Per revision the rows that matter most: symbols added, moved, removed and changed, then effects, then links gained and lost."""
    changes, revs, last = _changes(spark, d)
    moves, _ = base._moves(spark, d)
    links, effects = base._strong_differences(spark, d, moves, last)
    came, left = moves.select("idx", F.col("added").alias("id"), F.col("removed").alias("before")), moves.select("idx", F.col("removed").alias("id"), F.lit(True).alias("moved"))
    x = changes.join(came, ["idx", "id"], "left").join(left, ["idx", "id"], "left").where("change != 'removed' or moved is null")
    detail = F.when((F.col("change") == "added") & F.col("before").isNotNull(), F.concat(F.lit("moved from "), "before")).when(F.col("change") == "changed", "body changed").otherwise(F.col("change"))
    word = F.when(F.col("change") == "added", "gained").otherwise("lost")
    rows = x.select("idx", "id", detail.alias("detail"), F.lit(3.0).alias("score"))
    rows = rows.unionByName(effects.select("idx", "id", F.concat(F.lit("effect "), word, F.lit(": "), "effect").alias("detail"), F.lit(2.0).alias("score")))
    rows = rows.unionByName(links.select("idx", F.concat("src", F.lit(" -> "), "dst").alias("id"), F.concat(F.lit("edge "), word, F.lit(": "), "kind").alias("detail"), F.lit(1.0).alias("score")))
    return graph.budget(rows, ["idx"], [F.col("score").desc(), F.col("id"), F.col("detail")], RANGE_LIMIT).join(revs, "idx").select("rev", "place", "id", "detail", "score")


def diff_effects(spark, d):
    """Effects, weak ones too, that symbols added or changed by a revision have and had not before."""
    changes, revs, _ = _changes(spark, d)
    effects = cut(base.widest_path_effects(spark, d).join(revs, "rev").select("idx", "id", "effect"))
    touched = changes.where("change != 'removed'").select("idx", "id")
    fresh = effects.join(touched, ["idx", "id"], "left_semi").join(effects.withColumn("idx", F.col("idx") + 1), ["idx", "id", "effect"], "left_anti")
    return fresh.join(revs, "idx").select("rev", "id", "effect")


def diff_dependents(spark, d):
    """How many others depend, by links that are not weak, on each symbol a revision removed (as it was before) or changed."""
    changes, revs, _ = _changes(spark, d)
    strong = base._strong(table(spark, d, "edges")).where("src != dst").select("rev", "src", F.col("dst").alias("id")).distinct().groupBy("rev", "id").agg(F.count(F.lit(1)).alias("n")).join(revs, "rev").select("idx", "id", "n")
    x = changes.where("change != 'added'").withColumn("at", F.col("idx") - (F.col("change") == "removed").cast("int"))
    return x.join(strong.withColumnRenamed("idx", "at"), ["at", "id"], "left").join(revs, "idx").select("rev", "id", "change", F.coalesce("n", F.lit(0)).alias("dependents"))


def effects_report(spark, d):
    """The effects of every symbol, worst first: tier, calls to the nearest evidence, the next step there, and the line of direct ones."""
    direct = cut(base.direct_effects(spark, d))
    ways = graph.effect_witnesses(table(spark, d, "edges"), direct)
    lines = direct.groupBy("rev", "id", "effect", "rank").agg(F.min("line").alias("line"))
    x = ways.join(lines, ["rev", "id", "effect", "rank"], "left").withColumn("line", F.when(F.col("hops") == 0, F.col("line"))).withColumn("severity", names.position(F.col("effect"), names.SEVERITY))
    return graph.budget(x, ["rev", "id"], [F.col("severity"), F.col("rank").desc(), F.col("effect")], len(names.SEVERITY)).select("rev", "id", "place", "effect", "rank", "hops", "next", "line")


def hit_scopes(spark, d):
    """Where the texts of each revision mention its most called symbol by name, and the innermost definition around each mention."""
    edges = table(spark, d, "edges")
    asked = base._hubs(graph.fan_in(edges, base._ambiguity(spark, d))).select("rev", names.last_segment(F.regexp_replace("start", r"^.*::", "")).alias("word"))
    wanted = broadcast_if_small(cut(asked.select("word").distinct()))
    found = cut(search.words_of(_texts(spark, d)).join(wanted, "word", "left_semi"))
    hits = base._snapshot(spark, d).join(found, "blob_sha").join(broadcast_if_small(cut(asked)), ["rev", "word"], "left_semi")
    keyed = hits.select(F.concat_ws("\x00", "rev", "path").alias("path"), "line", "word")
    spans = base._symbols(spark, d).where("kind != 'module'").select(F.concat_ws("\x00", "rev", "path").alias("path"), "id", "line_start", "line_end")
    placed = search.attribute_hits(keyed.distinct(), spans)
    return placed.select(F.substring_index("path", "\x00", 1).alias("rev"), F.substring_index("path", "\x00", -1).alias("path"), "line", "word", "scope")


QUERIES = {f.__name__: f for f in (orphans, relationships, island_hubs, view_summary, range_report, diff_effects, diff_dependents, effects_report, hit_scopes)}


def _callers_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT rev, id, count(DISTINCT src) AS callers FROM (SELECT rev, src, dst AS id FROM l WHERE kind = 'CALLS' UNION ALL SELECT c.rev, c.src, n.id FROM call_hubs c JOIN node_hubs n USING (rev, hub)) WHERE src <> id AND {where} GROUP BY ALL)"


def _oracles() -> dict[str, str]:
    is_test = lambda x: sql._TESTS.format(x)
    segment = "regexp_extract(qualname, '[^.]*$')"
    dunder = f"(regexp_matches({segment}, '^__.+__$') AND length({segment}) > 4)"
    word = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
    base_sql = f"{sql._RESOLVED}, {sql._MAYBE}, {sql._LINKS}"
    history = sql.history_sql()
    body = f"bd AS (SELECT idx, item, '' AS target, content.b AS content FROM content), be AS ({sql._diff('bd', 'body')})"
    lines = "ln2 AS (SELECT sha, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM (SELECT lower(blob_sha) AS sha, max(content) AS content FROM blob_texts WHERE blob_sha <> '' GROUP BY ALL))"
    return {
        "orphans": rf"""WITH {base_sql}, call_hubs AS (SELECT DISTINCT rev, src, regexp_extract(name, '[^.]*$') AS hub FROM resolved WHERE reason = 'ambiguous' AND ref_kind = 'call'),
            {_callers_sql("anyone", "true")}, {_callers_sql("others", f"NOT {is_test('''string_split(src, '::')[1]''')}")},
            de AS (SELECT DISTINCT rev, path, b.qualname FROM snap JOIN blob_nodes b ON lower(b.blob_sha) = sha WHERE len(b.decorators) > 0),
            cand AS (SELECT rev, id, path, {segment} AS word, line_start, line_end, callers FROM symbols JOIN anyone USING (rev, id) WHERE kind IN ('function', 'method') AND name_binding = 'live' AND NOT {is_test("path")} AND NOT {dunder} AND starts_with({segment}, '_')
                AND (rev, path, qualname) NOT IN (SELECT (rev, path, qualname) FROM de) AND (rev, id) NOT IN (SELECT (rev, id) FROM others)),
            {lines}, w AS (SELECT DISTINCT sha, line, unnest(regexp_extract_all(text, '{word}')) AS word FROM ln2),
            said AS (SELECT DISTINCT s.rev, w.word FROM snap s JOIN w USING (sha) WHERE NOT {is_test("s.path")} AND (s.rev, w.word) IN (SELECT (rev, word) FROM cand) AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.rev = s.rev AND c.path = s.path AND c.word = w.word AND w.line BETWEEN c.line_start AND c.line_end))
            SELECT rev, id, callers FROM cand WHERE (rev, word) NOT IN (SELECT (rev, word) FROM said)""",
        "relationships": f"WITH {base_sql} SELECT rev, count(*) AS deferred FROM ref_hubs GROUP BY ALL",
        "island_hubs": f"""WITH RECURSIVE {base_sql}, {sql._FAN}, {sql._SYM}, {sql._CC}
            SELECT rev, island, row_number() OVER (PARTITION BY rev, island ORDER BY coalesce(fan_in, 0) DESC, id) AS place, id, coalesce(fan_in, 0) AS fan_in FROM (SELECT DISTINCT rev, id FROM symbols WHERE kind <> 'module') JOIN cc USING (rev, id) LEFT JOIN fan USING (rev, id) QUALIFY place <= {ISLAND_HUBS}""",
        "view_summary": f"""WITH {base_sql}, {sql._SIZED}, v AS (SELECT rev, src, dst, kind, max(rank) AS rank, bool_or(provenance = 'runtime') AS observed FROM l WHERE src <> dst GROUP BY ALL),
            dr AS (SELECT rev, count(*) AS edges_drawn, count(*) FILTER (observed) AS observed, {", ".join(f"count(*) FILTER (kind = '{k}') AS kind_{k.lower()}" for k in names.EDGE_KINDS)}, {", ".join(f"count(*) FILTER (rank = {i}) AS tier_{t.lower()}" for i, t in enumerate(names.TIERS))} FROM v GROUP BY rev),
            st AS (SELECT rev, count(*) AS edges_stored FROM l GROUP BY rev), fl AS (SELECT rev, count(*) AS files, sum(n_bytes)::BIGINT AS source_bytes FROM sized GROUP BY rev), df AS (SELECT rev, count(*) AS deferred FROM ref_hubs GROUP BY rev)
            SELECT rev, files, source_bytes, coalesce(edges_stored, 0) AS edges_stored, coalesce(edges_drawn, 0) AS edges_drawn, coalesce(observed, 0) AS observed, {", ".join(f"coalesce({x}, 0) AS {x}" for x in (*(f"kind_{k.lower()}" for k in names.EDGE_KINDS), *(f"tier_{t.lower()}" for t in names.TIERS)))}, coalesce(deferred, 0) AS deferred FROM fl LEFT JOIN st USING (rev) LEFT JOIN dr USING (rev) LEFT JOIN df USING (rev)""",
        "range_report": f"""{history}, {body},
            listed AS (SELECT be.idx, item AS id, CASE WHEN change = 'added' AND a.removed IS NOT NULL THEN 'moved from ' || a.removed WHEN change = 'changed' THEN 'body changed' ELSE change END AS detail, 3.0::DOUBLE AS score FROM be LEFT JOIN moves a ON a.idx = be.idx AND a.added = item LEFT JOIN moves b ON b.idx = be.idx AND b.removed = item WHERE change <> 'removed' OR b.idx IS NULL
                UNION ALL SELECT idx, id, 'effect ' || CASE change WHEN 'added' THEN 'gained' ELSE 'lost' END || ': ' || effect, 2.0 FROM ee UNION ALL SELECT idx, src || ' -> ' || dst, 'edge ' || CASE change WHEN 'added' THEN 'gained' ELSE 'lost' END || ': ' || kind, 1.0 FROM le)
            SELECT rev, row_number() OVER (PARTITION BY idx ORDER BY score DESC, id, detail) AS place, id, detail, score FROM listed JOIN revs USING (idx) QUALIFY place <= {RANGE_LIMIT}""",
        "diff_effects": f"{history}, {body}, en2 AS (SELECT DISTINCT idx, id, effect FROM best JOIN revs USING (rev)) SELECT rev, n.id, n.effect FROM en2 n JOIN be ON be.idx = n.idx AND be.item = n.id AND change <> 'removed' JOIN revs ON revs.idx = n.idx WHERE (n.idx - 1, n.id, n.effect) NOT IN (SELECT (idx, id, effect) FROM en2)",
        "diff_dependents": f"""WITH {sql._STATE}, {body}, sd AS (SELECT idx, dst AS id, count(DISTINCT src) AS n FROM strong JOIN revs USING (rev) WHERE src <> dst GROUP BY ALL)
            SELECT rev, item AS id, change, coalesce(n, 0) AS dependents FROM be JOIN revs USING (idx) LEFT JOIN sd ON sd.id = item AND sd.idx = be.idx - (change = 'removed')::INT WHERE change <> 'added'""",
        "effects_report": f"""{sql._late()["effect_witness"].replace("SELECT b.rev, b.id, b.effect, b.tier AS rank, b.hops, min(n.id) AS next", ", ways AS (SELECT b.rev, b.id, b.effect, b.tier AS rank, b.hops, min(n.id) AS next")}),
            lines AS (SELECT rev, id, effect, rank, min(line) AS line FROM direct GROUP BY ALL)
            SELECT w.rev, w.id, row_number() OVER (PARTITION BY w.rev, w.id ORDER BY list_position({list(names.SEVERITY)}, w.effect), w.rank DESC) AS place, w.effect, w.rank, w.hops, w.next, CASE WHEN w.hops = 0 THEN line END AS line FROM ways w LEFT JOIN lines USING (rev, id, effect, rank)""",
        "hit_scopes": rf"""WITH {base_sql}, {sql._HUBS}, ask AS (SELECT rev, regexp_extract(regexp_replace(start, '^.*::', ''), '[^.]*$') AS word FROM hubs), {lines},
            w AS (SELECT DISTINCT sha, line, unnest(regexp_extract_all(text, '{word}')) AS word FROM ln2), h AS (SELECT s.rev, s.path, w.line, w.word FROM snap s JOIN w USING (sha) JOIN ask a ON a.rev = s.rev AND a.word = w.word)
            SELECT h.rev, h.path, h.line, h.word, arg_max(s.id, {{'a': s.line_start, 'b': -s.line_end, 'c': s.id}}) AS scope FROM h LEFT JOIN symbols s ON s.rev = h.rev AND s.path = h.path AND s.kind <> 'module' AND h.line BETWEEN s.line_start AND s.line_end GROUP BY ALL""",
    }


ORACLES = _oracles()
