"""DuckDB SQL of the symbol graph queries, over the delivered tables."""

from __future__ import annotations

from graphmill.functions.names import EDGE_KINDS, SEVERITY, TIER_WEIGHTS
from graphmill.operators.resolve import BUILTINS
from graphmill.plans.core_data import _TREE, _diff

_LINKS = "l AS (SELECT *, list_position(['LOW', 'MEDIUM', 'HIGH'], confidence) - 1 AS rank FROM edges WHERE rev IS NOT NULL AND src IS NOT NULL AND dst <> '')"
_PAIRS = f"{_LINKS}, pairs AS (SELECT rev, src, dst, max(rank)::INT AS rank, coalesce(bool_or(provenance = 'runtime'), false) AS observed FROM l GROUP BY ALL HAVING max(rank) IS NOT NULL)"
_FAN = "fan AS (SELECT rev, dst AS id, count(DISTINCT src) AS fan_in FROM (SELECT rev, src, dst FROM l UNION ALL SELECT rev, src, dst FROM maybe) GROUP BY ALL)"
_HUBS = f"{_FAN}, hubs AS (SELECT rev, id AS start FROM fan QUALIFY row_number() OVER (PARTITION BY rev ORDER BY fan_in DESC, id DESC) = 1)"
_DEFS = "defs AS (SELECT DISTINCT lower(blob_sha) AS sha, ordinal, qualname, kind, line_start, line_end, body_hash, name_binding, shadow_index FROM blob_nodes WHERE qualname IS NOT NULL AND blob_sha <> '')"
_SYMBOLS = f"""{_TREE}, {_DEFS},
    symbols AS (
        SELECT rev, path || '::' || qualname || CASE WHEN name_binding = 'shadowed' THEN '#' || coalesce(shadow_index::VARCHAR, '') ELSE '' END AS id, path, qualname, kind, line_start, line_end, body_hash, name_binding FROM snap JOIN defs USING (sha)
        UNION ALL
        SELECT rev, path || '::<module>', path, '<module>', 'module', 1, 1, h, 'live' FROM snap LEFT JOIN (SELECT lower(blob_sha) AS sha, max(module_body_hash) AS h FROM blobs GROUP BY ALL) USING (sha)
    )"""
_REFS = r"""refs AS (
        SELECT DISTINCT lower(blob_sha) AS sha, ordinal, coalesce(nullif(regexp_replace(from_qualname, '\.<locals>$', ''), ''), '<module>') AS scope, ref_kind, trim(raw_name, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS name, nullif(dotted, '') AS dotted, line
        FROM blob_refs WHERE raw_name IS NOT NULL AND blob_sha <> ''
    )"""
_OWNED = r"""scopes AS (SELECT sha, qualname AS scope, line_start, line_end, qualname || CASE WHEN name_binding = 'shadowed' THEN '#' || coalesce(shadow_index::VARCHAR, '') ELSE '' END AS local, name_binding = 'live' AS live FROM defs),
    owned AS (
        SELECT r.sha, r.ordinal, r.scope, r.ref_kind, r.name, r.dotted, r.line, coalesce(min(s.local) FILTER (r.line BETWEEN s.line_start AND s.line_end), min(s.local) FILTER (s.live), r.scope) AS owner
        FROM refs r LEFT JOIN scopes s USING (sha, scope) GROUP BY r.sha, r.ordinal, r.scope, r.ref_kind, r.name, r.dotted, r.line
    ),
    wanted AS (SELECT *, CASE WHEN NOT contains(name, '.') THEN name WHEN regexp_matches(name, '^self\.\w+$') AND regexp_matches(scope, '(^|\.)[^.<>]+\.[^.]+$') THEN regexp_replace(scope, '\.[^.]+$', '') || substr(name, 5) END AS cand FROM owned),
    located AS (SELECT w.*, d.local, CASE WHEN d.local IS NOT NULL THEN CASE WHEN contains(name, '.') THEN 3 ELSE 2 END END AS lstep FROM wanted w LEFT JOIN (SELECT DISTINCT sha, qualname AS local FROM defs WHERE name_binding = 'live') d ON d.sha = w.sha AND d.local = w.cand)"""
_MODULE = r"replace(regexp_replace(regexp_replace({0}, '\.py$', ''), '(^|/)__init__$', ''), '/', '.')"
_IMPORTED = f"""modules AS (SELECT rev, {_MODULE.format("path")} AS module, min(path) AS path, arg_min(sha, path) AS sha FROM snap GROUP BY ALL),
    names AS (SELECT DISTINCT rev, dotted FROM snap JOIN refs USING (sha) WHERE contains(dotted, '.')),
    cuts AS (SELECT rev, dotted, unnest(range(1, len(string_split(dotted, '.')))) AS n FROM names),
    imported AS (
        SELECT c.rev, c.dotted, arg_max(m.path || '::' || d.qualname, c.n) AS dst FROM cuts c
        JOIN modules m ON m.rev = c.rev AND m.module = array_to_string(string_split(c.dotted, '.')[1:c.n], '.')
        JOIN (SELECT DISTINCT sha, qualname FROM defs WHERE name_binding = 'live') d ON d.sha = m.sha AND d.qualname = array_to_string(string_split(c.dotted, '.')[c.n + 1:], '.')
        GROUP BY ALL
    )"""
_INDEX = r"idx_names AS (SELECT rev, regexp_extract(qualname, '[^.]*$') AS segment, count(DISTINCT id) AS candidates, min(id) AS \"only\" FROM symbols WHERE name_binding = 'live' AND kind <> 'module' GROUP BY ALL)".replace('\\"', '"')
_RESOLVED = f"""{_SYMBOLS}, {_REFS}, {_OWNED}, {_IMPORTED}, {_INDEX},
    j AS (
        SELECT s.rev, s.path, o.*, i.dst AS idst, n.candidates AS c, n."only", o.name IN ({", ".join(f"'{x}'" for x in BUILTINS)}) AS bare
        FROM snap s JOIN located o USING (sha) LEFT JOIN imported i ON i.rev = s.rev AND i.dotted = o.dotted LEFT JOIN idx_names n ON n.rev = s.rev AND n.segment = regexp_extract(o.name, '[^.]*$') WHERE o.ref_kind IN ('call', 'base')
    ),
    k AS (SELECT *, CASE WHEN idst IS NOT NULL THEN 1 WHEN local IS NOT NULL THEN lstep WHEN c = 1 AND NOT bare THEN 4 END AS step FROM j),
    res AS (
        SELECT rev, path, ordinal, path || '::' || owner AS src, name, ref_kind, line, coalesce(idst, path || '::' || local, CASE WHEN c = 1 AND NOT bare THEN "only" END) AS dst, step, CASE step WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS rank,
               CASE WHEN step IS NOT NULL THEN NULL WHEN bare THEN 'builtin' WHEN dotted IS NOT NULL THEN 'external' WHEN c > 1 THEN 'ambiguous' ELSE 'unknown' END AS reason
        , c FROM k
    ),
    resolved AS (SELECT rev, path, ordinal, src, name, ref_kind, line, dst, step, rank, reason, CASE WHEN reason = 'ambiguous' THEN c ELSE 0 END AS candidates FROM res)"""


# What ambiguous names may link, as pairs, and all links with these.
_MAYBE = r"""ref_hubs AS (SELECT DISTINCT rev, src, regexp_extract(name, '[^.]*$') AS hub FROM resolved WHERE reason = 'ambiguous'),
    alive AS (SELECT DISTINCT rev, id, path, qualname, kind FROM symbols WHERE name_binding = 'live' AND kind <> 'module'),
    node_hubs AS (SELECT rev, id, regexp_extract(qualname, '[^.]*$') AS hub FROM alive UNION SELECT m.rev, m.id, regexp_extract(c.qualname, '[^.]*$') FROM alive m JOIN alive c ON c.rev = m.rev AND c.path = m.path AND c.kind = 'class' AND m.kind = 'method' AND m.qualname = c.qualname || '.__init__'),
    maybe AS (SELECT DISTINCT r.rev, r.src, n.id AS dst FROM ref_hubs r JOIN node_hubs n USING (rev, hub))"""
_ALL_PAIRS = "all_pairs AS (SELECT rev, src, dst, max(rank)::INT AS rank, bool_or(observed) AS observed FROM (SELECT * FROM pairs UNION ALL SELECT rev, src, dst, 0, false FROM maybe) GROUP BY ALL)"


def _rules() -> str:
    """The rules as a relation, and each called name's best rule of all and of the overrides, by glob."""
    from graphmill.functions.names import TIERS
    from graphmill.plans.symbol_graph import EFFECT_RULES

    values = ", ".join(f"('{r.match}', '{r.effect}', {TIERS.index(r.tier)}, {str(r.override).lower()}, {r.prefix})" for r in EFFECT_RULES)
    best = "arg_max({'effect': effect, 'rank': rank::INT, 'match': match}, {'p': prefix, 'o': override, 'm': match})"
    return f"""rules(match, effect, rank, override, prefix) AS (VALUES {values}),
    called AS (SELECT DISTINCT coalesce(dotted, name) AS name FROM refs WHERE ref_kind = 'call'),
    ruled AS (SELECT name, {best} AS a, {best} FILTER (override) AS o FROM called JOIN rules ON name GLOB match GROUP BY name)"""


def _direct() -> str:
    """Rules that describe libraries do not hold where the name leads into a module of the revision."""
    return rf"""{_rules()}, mods AS (SELECT DISTINCT rev, {_MODULE.format("regexp_replace(path, '^src/', '')")} AS m FROM snap),
    prefixes AS (SELECT name, array_to_string(string_split(name, '.')[1:n], '.') AS m FROM (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS n FROM ruled)),
    inside AS (SELECT DISTINCT rev, name FROM prefixes JOIN mods USING (m) WHERE m <> ''),
    hits AS (SELECT snap.rev, path || '::' || scope AS id, line, CASE WHEN ref_kind = 'global' THEN {{'effect': 'GLOBAL_MUTATE', 'rank': 2, 'match': ''}} WHEN i.name IS NOT NULL THEN ruled.o ELSE ruled.a END AS h
        FROM refs JOIN snap USING (sha) LEFT JOIN ruled ON ref_kind = 'call' AND ruled.name = coalesce(dotted, refs.name) LEFT JOIN inside i ON i.rev = snap.rev AND i.name = ruled.name WHERE ref_kind IN ('call', 'global')),
    direct AS (SELECT rev, id, h.effect AS effect, h.rank AS rank, min(line) AS line FROM hits WHERE h IS NOT NULL GROUP BY ALL)"""


def _levels() -> str:
    out = "l0 AS (SELECT rev, start, start AS id, 2 AS rank, true AS observed FROM hubs)"
    for k in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT rev, start, id FROM l{i}" for i in range(k))
        out += f""", x{k} AS (SELECT p.rev, x.start, p.src AS id, max({{'r': least(x.rank, p.rank), 'o': (x.observed AND p.observed)}}) AS q FROM all_pairs p JOIN l{k - 1} x ON x.rev = p.rev AND x.id = p.dst GROUP BY ALL),
        l{k} AS (SELECT rev, start, id, q.r AS rank, q.o AS observed FROM x{k} ANTI JOIN ({seen}) USING (rev, start, id))"""
    return out


def _paths(hops: int, p: str = "p", pairs: str = "all_pairs") -> str:
    out = f"{p}0 AS (SELECT DISTINCT rev, start, start AS id, 2 AS rank, [start] AS nodes FROM ends)"
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT rev, start, id FROM {p}{i}" for i in range(k))
        out += f""", {p}y{k} AS (SELECT p.rev, x.start, p.dst AS id, min({{'w': -least(x.rank, p.rank), 'n': list_append(x.nodes, p.dst)}}) AS o FROM {pairs} p JOIN {p}{k - 1} x ON x.rev = p.rev AND x.id = p.src GROUP BY ALL),
        {p}{k} AS (SELECT rev, start, id, -o.w AS rank, o.n AS nodes FROM {p}y{k} ANTI JOIN ({seen}) USING (rev, start, id))"""
    return out


# Ends of paths: to the ten most called symbols, from the symbol with the most targets and from the one farthest from all of them; both directions.
_ENDS = """sp AS (SELECT rev, src, dst, max(rank) AS rank FROM l WHERE rank > 0 GROUP BY ALL),
        goals AS (SELECT rev, id AS goal FROM fan QUALIFY row_number() OVER (PARTITION BY rev ORDER BY fan_in DESC, id) <= 10),
        back(rev, id, hops) USING KEY (rev, id) AS (SELECT rev, goal, 0 FROM goals UNION SELECT DISTINCT sp.rev, sp.src, back.hops + 1 FROM back JOIN sp ON sp.rev = back.rev AND sp.dst = back.id WHERE (sp.rev, sp.src) NOT IN (SELECT (rev, id) FROM recurring.back)),
        starts AS (SELECT rev, src AS start FROM (SELECT rev, src, count(DISTINCT dst) AS n FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rev ORDER BY n DESC, src DESC) = 1
            UNION SELECT rev, id FROM back QUALIFY row_number() OVER (PARTITION BY rev ORDER BY hops DESC, id) = 1),
        one_way AS (SELECT rev, start, goal FROM starts JOIN goals USING (rev)), ends AS (SELECT rev, start, goal FROM one_way UNION SELECT rev, goal, start FROM one_way)"""


def _distances(name: str, pairs: str) -> str:
    return f"""{name}(rev, start, id, hops) USING KEY (rev, start, id) AS (SELECT DISTINCT rev, start, start, 0 FROM ends
        UNION SELECT DISTINCT p.rev, d.start, p.dst, d.hops + 1 FROM {name} d JOIN {pairs} p ON p.rev = d.rev AND p.src = d.id WHERE (p.rev, d.start, p.dst) NOT IN (SELECT (rev, start, id) FROM recurring.{name})),
        {name}_least AS (SELECT o.rev, o.start, o.goal, min(d.hops) AS hops FROM one_way o JOIN {name} d ON d.rev = o.rev AND ((d.start = o.start AND d.id = o.goal) OR (d.start = o.goal AND d.id = o.start)) GROUP BY ALL)"""


_REACHED = f"{_PAIRS}, {_RESOLVED}, {_MAYBE}, {_ALL_PAIRS}, {_HUBS}, {_levels()}, reached AS ({' UNION ALL '.join(f'SELECT rev, start, id, {k} AS hop, rank, observed FROM l{k}' for k in (1, 2, 3))})"
_SALIENCE = r"known AS (SELECT rev, id, coalesce(fan_in, 0) AS fan_in, round(CASE WHEN coalesce(fan_in, 0) = 0 THEN 0.5 ELSE 0 END + CASE WHEN starts_with(regexp_extract(qualname, '[^.]*$'), '_') THEN 0 ELSE 0.3 END + least(coalesce(fan_in, 0), 10) / 20, 6) AS salience FROM symbols LEFT JOIN fan USING (rev, id))"
_IMPACT = rf"""{_REACHED}, {_SALIENCE},
    impact AS (SELECT *, string_split(id, '::')[1] AS path, round(1.0::DOUBLE / hop * [{", ".join(f"{w}::DOUBLE" for w in TIER_WEIGHTS)}][rank + 1] * (1 + salience), 6) AS score, starts_with(id, 'tests/') OR starts_with(regexp_replace(id, '^.*(::|\.)', ''), 'test_') AS test FROM reached JOIN known USING (rev, id))"""
_TESTS = r"(regexp_matches({0}, '(^|/)tests?/') OR regexp_matches({0}, '(^|/)(conftest|test_[^/]*|[^/]*_test)\.py$'))"
_CC = """cc(rev, id, island) USING KEY (rev, id) AS (
        SELECT DISTINCT rev, a, a FROM sym
        UNION
        SELECT n.rev, n.id, n.low FROM (SELECT s.rev, s.b AS id, min(c.island) AS low FROM cc c JOIN sym s ON s.rev = c.rev AND s.a = c.id GROUP BY ALL) n JOIN recurring.cc r ON r.rev = n.rev AND r.id = n.id WHERE n.low < r.island
    )"""
_SYM = "sym AS (SELECT DISTINCT rev, src AS a, dst AS b FROM l WHERE src <> dst UNION SELECT DISTINCT rev, dst, src FROM l WHERE src <> dst)"
_SIZED = "sized AS (SELECT rev, path, n_bytes, lines FROM snap JOIN (SELECT lower(blob_sha) AS sha, max(n_bytes) AS n_bytes, max(len(string_split(content, chr(10)))) AS lines FROM blob_texts GROUP BY ALL) USING (sha))"
_STATE = f"""{_SYMBOLS}, {_LINKS},
    strong AS (SELECT DISTINCT rev, src, dst, kind FROM l WHERE confidence IN ('MEDIUM', 'HIGH')),
    outgoing AS (SELECT rev, src AS id, list_sort(list(dst || '|' || kind)) AS links FROM strong GROUP BY ALL),
    content AS (SELECT idx, id AS item, '' AS target, {{'b': max(body_hash), 'l': any_value(links)}} AS content FROM symbols LEFT JOIN outgoing USING (rev, id) JOIN revs USING (rev) WHERE name_binding = 'live' GROUP BY idx, id)"""

_ANCESTORS = f"""{_LINKS}, up AS (SELECT DISTINCT rev, src AS sub, dst AS base FROM l WHERE kind = 'INHERITS' AND confidence = 'HIGH' AND src <> dst),
            a(rev, cls, anc, depth) USING KEY (rev, cls, anc) AS (SELECT rev, c, c, 0 FROM (SELECT rev, sub AS c FROM up UNION SELECT rev, base FROM up) UNION
                SELECT DISTINCT a.rev, a.cls, up.base, a.depth + 1 FROM a JOIN up ON up.rev = a.rev AND up.sub = a.anc WHERE (a.rev, a.cls, up.base) NOT IN (SELECT (rev, cls, anc) FROM recurring.a))"""

_MOVES = """r AS (SELECT DISTINCT idx, id, kind, body_hash FROM symbols JOIN revs USING (rev) WHERE name_binding = 'live' AND kind <> 'module'),
        g AS (SELECT a.idx + 1 AS idx, a.kind, a.body_hash, a.id, 0 AS new FROM r a WHERE (a.idx + 1, a.id) NOT IN (SELECT (idx, id) FROM r) UNION ALL SELECT b.idx, b.kind, b.body_hash, b.id, 1 FROM r b WHERE (b.idx - 1, b.id) NOT IN (SELECT (idx, id) FROM r)),
        p AS (SELECT idx, kind, body_hash, count(*) FILTER (new = 0) AS n_removed, count(*) FILTER (new = 1) AS n_added, min(id) FILTER (new = 0) AS removed, min(id) FILTER (new = 1) AS added FROM g GROUP BY ALL)"""

ORACLES = {
    "tree_snapshot": f"WITH {_TREE} SELECT rev, path, sha AS blob_sha FROM snap",
    "tree_overlay": f"WITH {_TREE}, n AS (SELECT * FROM snap JOIN revs USING (rev)), w AS (SELECT * FROM n WHERE rev = 'WORKTREE'), h AS (SELECT * FROM n WHERE idx = (SELECT max(idx) - 1 FROM w)) SELECT w.path, w.sha AS blob_sha, CASE WHEN h.sha = w.sha THEN 'head' ELSE 'work' END AS origin FROM w LEFT JOIN h USING (path)",
    "content_address": "SELECT DISTINCT lower(blob_sha) AS blob_sha, sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS git_sha, n_bytes, strlen(content) AS octets, lower(blob_sha) = sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS same FROM blob_texts",
    "blob_dedupe": f"WITH {_TREE} SELECT sha AS blob_sha, count(DISTINCT path) AS n_paths, count(*) AS n_rows, count(DISTINCT rev) AS n_revs FROM snap GROUP BY ALL",
    "parse_cache_antijoin": f"WITH {_TREE} SELECT DISTINCT sha AS blob_sha FROM snap WHERE sha NOT IN (SELECT lower(blob_sha) FROM blobs WHERE status = 'ok' AND blob_sha IS NOT NULL)",
    "gc_removed": f"WITH {_TREE} SELECT DISTINCT lower(blob_sha) AS blob_sha FROM blobs WHERE blob_sha <> '' AND lower(blob_sha) NOT IN (SELECT sha FROM snap JOIN revs USING (rev) WHERE idx >= (SELECT max(idx) - 1 FROM revs))",
    "symbols": f"WITH {_SYMBOLS} SELECT * FROM symbols",
    "index_stats": f"""WITH {_RESOLVED}, {_LINKS},
        t AS (SELECT rev, count(DISTINCT sha) AS n_texts, count(DISTINCT sha) FILTER (sha IN (SELECT lower(blob_sha) FROM blobs WHERE status = 'ok' AND blob_sha IS NOT NULL)) AS n_parsed FROM snap GROUP BY rev),
        o AS (SELECT rev, {", ".join(f"count(*) FILTER (reason = '{r}') AS n_{r}" for r in ("unknown", "ambiguous", "external", "builtin"))} FROM resolved GROUP BY rev),
        p AS (SELECT rev, count(*) AS n_paths, count(*) FILTER (sha IN (SELECT lower(blob_sha) FROM blobs WHERE status = 'error' AND blob_sha IS NOT NULL)) AS n_errors FROM snap GROUP BY ALL),
        s AS (SELECT rev, count(*) AS n_shadowed FROM symbols WHERE name_binding = 'shadowed' GROUP BY ALL),
        e AS (SELECT rev, count(*) FILTER (provenance = 'static') AS n_static, count(*) FILTER (provenance = 'runtime') AS n_runtime FROM l GROUP BY ALL)
        SELECT rev, n_paths, n_errors, n_texts, n_parsed, coalesce(n_shadowed, 0) AS n_shadowed, coalesce(n_static, 0) AS n_static, coalesce(n_runtime, 0) AS n_runtime, {", ".join(f"coalesce(n_{r}, 0) AS n_{r}" for r in ("unknown", "ambiguous", "external", "builtin"))} FROM p JOIN t USING (rev) LEFT JOIN s USING (rev) LEFT JOIN e USING (rev) LEFT JOIN o USING (rev)""",
    "path_modules": rf"""WITH {_TREE}, p AS (SELECT DISTINCT path FROM snap), m AS (SELECT path, {_MODULE.format("regexp_replace(path, '^(lib|packages)/', '')")} AS module FROM p)
        SELECT path, module, CASE WHEN regexp_matches(path, '(^|/)__init__\.py$') THEN module ELSE regexp_replace(module, '\.?[^.]*$', '') END AS package, {_TESTS.format("path")} AS is_test FROM m""",
    "name_parts": r"""SELECT DISTINCT qualname, regexp_extract(qualname, '[^.]*$') AS segment, nullif(regexp_replace(regexp_extract(qualname, '^(.*)\.[^.]*$', 1), '\.<locals>$', ''), '') AS parent,
        regexp_matches(regexp_extract(qualname, '[^.]*$'), '^__.+__$') AND length(regexp_extract(qualname, '[^.]*$')) > 4 AS dunder, nullif(regexp_replace(qualname, '((^|\.)(<locals>\.)?<(genexpr|listcomp|setcomp|dictcomp|lambda)>)+$', ''), '') AS scope FROM blob_nodes WHERE qualname IS NOT NULL""",
    "absolute_imports": rf"""WITH {_TREE}, p AS (SELECT DISTINCT path FROM snap), m AS (SELECT path, {_MODULE.format("regexp_replace(path, '^(lib|packages)/', '')")} AS module FROM p),
        g AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)__init__\.py$') THEN module ELSE regexp_replace(module, '\.?[^.]*$', '') END AS package FROM m)
        SELECT path, level::INT AS level, CASE level WHEN 0 THEN 'util' WHEN 1 THEN ltrim(package || '.util', '.') ELSE ltrim(regexp_replace(package, '\.?[^.]*$', '') || '.util', '.') END AS target FROM g, range(3) t(level)""",
    "symbol_lookup": f"""WITH {_SYMBOLS}, q AS (SELECT unnest(['app/core/registry.py::Registry.get', 'registry.PUT', 'debug', 'no_such_symbol', 'log']) AS query),
        h AS (SELECT rev, query, id, CASE WHEN lower(id) = lower(query) THEN 1 WHEN lower(qualname) = lower(query) THEN 2 WHEN ends_with(lower(qualname), '.' || lower(query)) THEN 3 END AS stage FROM symbols, q)
        SELECT rev, query, stage, id FROM h WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY rev, query)""",
    "reference_owners": f"WITH {_DEFS}, {_REFS}, {_OWNED} SELECT sha AS blob_sha, ordinal, name, line, owner FROM owned",
    "module_local": f"WITH {_DEFS}, {_REFS}, {_OWNED} SELECT sha AS blob_sha, ordinal, name, local, lstep AS step FROM (SELECT DISTINCT * EXCLUDE (owner) FROM located) WHERE local IS NOT NULL",
    "longest_prefix": f"WITH {_TREE}, {_DEFS}, {_REFS}, {_IMPORTED} SELECT * FROM imported",
    "last_segment_index": f"WITH {_SYMBOLS}, {_INDEX} SELECT * FROM idx_names",
    "cascade": f"WITH {_RESOLVED} SELECT * FROM resolved",
    "unresolved_pivot": f"WITH {_RESOLVED} SELECT rev, src, {', '.join(f'''count(*) FILTER (reason = '{r}') AS {r}''' for r in ('unknown', 'ambiguous', 'external', 'builtin'))} FROM resolved WHERE reason IS NOT NULL GROUP BY ALL",
    "unknown_rows": f"WITH {_RESOLVED} SELECT rev, src, row_number() OVER (PARTITION BY rev, src ORDER BY list_position(['unknown', 'ambiguous', 'external', 'builtin'], reason), path, line, name, ordinal) AS place, reason, path, line, name, candidates FROM resolved WHERE reason IS NOT NULL QUALIFY place <= 40",
    "reference_ratio": f"WITH {_RESOLVED}, sites AS (SELECT rev, path, line, count(step) > 0 AS linked FROM resolved GROUP BY ALL) SELECT rev, count(*) FILTER (linked) AS linked, count(*) AS n, round(count(*) FILTER (linked) / count(*), 6) AS ratio FROM sites GROUP BY rev",
    "hub_edges": f"""WITH {_RESOLVED}, o AS (SELECT DISTINCT rev, src, regexp_extract(name, '[^.]*$') AS hub FROM resolved WHERE reason = 'ambiguous')
        SELECT rev, src, '*' || hub AS dst FROM o UNION ALL SELECT DISTINCT rev, '*' || regexp_extract(qualname, '[^.]*$'), id FROM symbols WHERE name_binding = 'live' AND kind <> 'module' AND (rev, regexp_extract(qualname, '[^.]*$')) IN (SELECT (rev, hub) FROM o)""",
    "edge_collapse": f"WITH {_PAIRS} SELECT * FROM pairs",
    "edge_argmin": f"""WITH {_LINKS}, o AS (SELECT *, coalesce(list_position({list(EDGE_KINDS)}, kind) - 1, {len(EDGE_KINDS)}) AS k, coalesce(provenance = 'runtime', false) AS observed, concat_ws(':', callsite_path, callsite_line) AS site FROM l WHERE rank IS NOT NULL)
        SELECT rev, src, dst, rank, kind, observed, site FROM o QUALIFY row_number() OVER (PARTITION BY rev, src, dst ORDER BY rank DESC, k, observed DESC, site, kind) = 1""",
    "fan_in": f"WITH {_LINKS}, {_RESOLVED}, {_MAYBE}, {_FAN} SELECT * FROM fan",
    "salience_score": f"WITH {_LINKS}, {_RESOLVED}, {_MAYBE}, {_FAN}, {_SALIENCE} SELECT * FROM known",
    "view_edges": f"WITH {_LINKS} SELECT rev, src, dst, kind, max(rank) AS rank, bool_or(provenance = 'runtime') AS observed FROM l WHERE src <> dst GROUP BY ALL",
    "override_pairs": rf"""WITH {_SYMBOLS}, {_LINKS}, ms AS (SELECT DISTINCT rev, regexp_replace(id, '\.[^.]+$', '') AS cls, regexp_extract(qualname, '[^.]*$') AS m FROM symbols WHERE kind = 'method' AND name_binding = 'live'),
        up AS (SELECT DISTINCT rev, src AS sub, dst AS base FROM l WHERE kind IN ('INHERITS', 'IMPLEMENTS'))
        SELECT up.rev, up.sub, up.base, a.m FROM up JOIN ms a ON a.rev = up.rev AND a.cls = up.sub JOIN ms b ON b.rev = up.rev AND b.cls = up.base AND b.m = a.m""",
    "impact_hops": f"WITH {_REACHED} SELECT * FROM reached",
    "impact_truncated": f"""WITH {_REACHED}, seen AS (SELECT rev, start, id FROM l0 UNION ALL SELECT rev, start, id FROM reached), more AS (SELECT DISTINCT rev, start FROM (SELECT p.rev, x.start, p.src AS id FROM all_pairs p JOIN l3 x ON x.rev = p.rev AND x.id = p.dst) ANTI JOIN seen USING (rev, start, id))
        SELECT rev, start, (rev, start) IN (SELECT (rev, start) FROM more) AS truncated FROM hubs""",
    "impact_ranked": f"""WITH {_IMPACT}, s AS (SELECT *, CASE WHEN rank = 0 THEN 'low_confidence' WHEN test THEN 'tests' ELSE 'dependents' END AS section FROM impact)
        SELECT rev, section, row_number() OVER (PARTITION BY rev, rank = 0 ORDER BY section, score DESC, id) AS place, id, hop, rank, score FROM s QUALIFY place <= CASE WHEN rank = 0 THEN 5 ELSE 40 END""",
    "impact_summary": f"WITH {_IMPACT} SELECT rev, count(*) FILTER (rank > 0) AS symbols, count(DISTINCT path) FILTER (rank > 0) AS modules, count(*) FILTER (rank > 0 AND fan_in = 0) AS entry_points, count(*) FILTER (rank = 0) AS hidden_low FROM impact GROUP BY ALL",
    "shortest_path": f"""WITH RECURSIVE {_PAIRS}, {_RESOLVED}, {_MAYBE}, {_ALL_PAIRS}, {_FAN}, {_ENDS},
        {_paths(6)}, found AS ({" UNION ALL ".join(f"SELECT rev, start, id AS goal, {k} AS hops, rank, nodes FROM p{k}" for k in range(7))})
        SELECT rev, start, goal, hops, rank, array_to_string(nodes, ' > ') AS path FROM found SEMI JOIN ends USING (rev, start, goal)""",
    "path_negative": f"""WITH RECURSIVE {_PAIRS}, {_RESOLVED}, {_MAYBE}, {_ALL_PAIRS}, {_FAN}, {_ENDS}, {_distances("sd", "sp")}, {_distances("wd", "all_pairs")}, {_SYM}, {_CC}
        SELECT e.rev, e.start, e.goal, CASE WHEN s.hops IS NOT NULL THEN 'hop_limit' WHEN w.hops IS NOT NULL THEN 'low_confidence' WHEN a.island IS DISTINCT FROM b.island THEN 'other_island' ELSE 'no_path' END AS reason, coalesce(s.hops, w.hops) AS hops
        FROM one_way e LEFT JOIN sd_least s USING (rev, start, goal) LEFT JOIN wd_least w USING (rev, start, goal) LEFT JOIN cc a ON a.rev = e.rev AND a.id = e.start LEFT JOIN cc b ON b.rev = e.rev AND b.id = e.goal WHERE s.hops IS NULL OR s.hops > 2""",
    "island_mechanisms": rf"""WITH RECURSIVE {_SYMBOLS}, {_LINKS}, {_SYM}, {_CC},
        ms AS (SELECT DISTINCT rev, regexp_replace(id, '\.[^.]+$', '') AS cls, regexp_extract(qualname, '[^.]*$') AS m FROM symbols WHERE kind = 'method' AND name_binding = 'live'),
        ov AS (SELECT DISTINCT u.rev, u.src || '.' || a.m AS id FROM l u JOIN ms a ON a.rev = u.rev AND a.cls = u.src JOIN ms b ON b.rev = u.rev AND b.cls = u.dst AND b.m = a.m WHERE u.kind IN ('INHERITS', 'IMPLEMENTS')),
        ran AS (SELECT rev, src AS id FROM l WHERE provenance = 'runtime' UNION SELECT rev, dst FROM l WHERE provenance = 'runtime'),
        de AS (SELECT DISTINCT rev, path, b.qualname FROM snap JOIN blob_nodes b ON lower(b.blob_sha) = sha WHERE len(b.decorators) > 0),
        x AS (SELECT rev, id, bool_or(qualname = 'main') AS entry, bool_or(regexp_matches(regexp_extract(qualname, '[^.]*$'), '^__.+__$') AND length(regexp_extract(qualname, '[^.]*$')) > 4) AS dunder, bool_or((rev, path, qualname) IN (SELECT (rev, path, qualname) FROM de)) AS decorator,
            bool_or(regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\.py$') AND (regexp_matches(qualname, '^test[^.]*$') OR regexp_matches(qualname, '^Test[^.]*\.test[^.]*$'))) AS test, bool_or((rev, id) IN (SELECT (rev, id) FROM ov)) AS override, bool_or(contains(qualname, '<locals>')) AS nested, bool_or((rev, id) IN (SELECT (rev, id) FROM ran)) AS traced FROM symbols WHERE kind <> 'module' GROUP BY ALL),
        s AS (SELECT rev, coalesce(island, id) AS island, count(*) AS n, {", ".join(f"bool_or({k}) AS {k}" for k in ("entry", "dunder", "decorator", "test", "override", "nested", "traced"))} FROM x LEFT JOIN cc USING (rev, id) GROUP BY rev, coalesce(island, id))
        SELECT rev, island, n, concat_ws(' ', {", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in ("entry", "dunder", "decorator", "test", "override", "nested", "traced"))}) AS mechanisms, (entry OR dunder OR decorator OR test OR override OR nested OR traced) AS explained FROM s""",
    "components": f"WITH RECURSIVE {_LINKS}, {_SYM}, {_CC} SELECT * FROM cc",
    "island_merge_split": f"""WITH RECURSIVE {_TREE}, {_LINKS}, {_SYM}, {_CC}, n AS (SELECT idx, id, island FROM cc JOIN revs USING (rev)), c AS (SELECT DISTINCT b.idx AS step, a.island AS old, b.island AS new FROM n a JOIN n b ON b.id = a.id AND b.idx = a.idx + 1)
        SELECT step, 'merge' AS change, new AS island, count(*) AS n_parts FROM c GROUP BY ALL HAVING n_parts > 1 UNION ALL SELECT step, 'split', old, count(*) AS n_parts FROM c GROUP BY ALL HAVING n_parts > 1""",
    "test_only_symbols": rf"""WITH {_SYMBOLS}, {_LINKS}, c AS (SELECT DISTINCT rev, src, dst AS id FROM l WHERE kind = 'CALLS' AND src <> dst), j AS (SELECT rev, id, count(*) AS callers FROM c GROUP BY ALL HAVING bool_and({_TESTS.format("string_split(src, '::')[1]")}))
        SELECT DISTINCT rev, id, callers FROM symbols JOIN j USING (rev, id) WHERE kind IN ('function', 'method') AND name_binding = 'live' AND NOT {_TESTS.format("path")} AND NOT (regexp_matches(regexp_extract(qualname, '[^.]*$'), '^__.+__$') AND length(regexp_extract(qualname, '[^.]*$')) > 4)""",
    "token_scan": rf"""WITH {_DEFS}, own AS (SELECT sha, qualname AS word, line_start, line_end FROM defs WHERE kind IN ('function', 'class') AND name_binding = 'live' AND NOT contains(qualname, '.')),
        ln AS (SELECT sha, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM (SELECT DISTINCT lower(blob_sha) AS sha, content FROM blob_texts)),
        w AS (SELECT DISTINCT sha, line, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')) AS word FROM ln),
        o AS (SELECT DISTINCT w.word, w.sha, w.line FROM w LEFT JOIN own USING (sha, word) WHERE w.word IN (SELECT word FROM own) AND (own.line_start IS NULL OR w.line < own.line_start OR w.line > own.line_end))
        SELECT word, count(DISTINCT sha) AS n_texts, count(*) AS n_lines FROM o GROUP BY ALL""",
    "snapshot_diff": f"WITH {_STATE}, events AS ({_diff('content', 'symbol')}) SELECT rev, item AS id, change FROM events JOIN revs USING (idx)",
    "move_pairing": f"""WITH {_SYMBOLS}, {_MOVES}
        SELECT rev, kind, body_hash, CASE WHEN n_removed = 1 AND n_added = 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier, n_removed, n_added, removed, added FROM p JOIN revs USING (idx) WHERE n_removed > 0 AND n_added > 0""",
    "trace_reconcile": f"""WITH {_SYMBOLS}, {_LINKS}, st AS (SELECT rev, src, dst, min({{'a': callsite_line, 'b': callsite_path}}) AS site FROM l WHERE kind = 'CALLS' AND provenance = 'static' GROUP BY ALL), own AS (SELECT rev, id AS src, min(line_start) AS line_start FROM symbols GROUP BY ALL)
        SELECT s.rev, s.src, s.dst, CASE WHEN site IS NULL THEN 'added' ELSE 'confirmed' END AS status, coalesce(site.b, string_split(s.src, '::')[1]) AS path, coalesce(site.a, line_start) AS line FROM (SELECT DISTINCT rev, src, dst FROM l WHERE provenance = 'runtime') s LEFT JOIN st USING (rev, src, dst) LEFT JOIN own ON own.rev = s.rev AND own.src = s.src""",
    "trace_stale": f"""WITH {_TREE}, {_LINKS}, n AS (SELECT idx, path, sha FROM snap JOIN revs USING (rev)), ch AS (SELECT a.idx, a.path FROM n a LEFT JOIN n b ON b.path = a.path AND b.idx = a.idx + 1 WHERE a.sha IS DISTINCT FROM b.sha)
        SELECT DISTINCT l.rev, src, dst FROM l JOIN revs USING (rev) JOIN ch ON ch.idx = revs.idx AND ch.path IN (string_split(src, '::')[1], string_split(dst, '::')[1]) WHERE provenance = 'runtime'""",
    "score_recall": f"""WITH {_LINKS}, st AS (SELECT rev, src, dst, max(rank) AS rank FROM l WHERE kind = 'CALLS' AND provenance = 'static' GROUP BY ALL), rt AS (SELECT DISTINCT rev, src, dst, true AS seen FROM l WHERE kind = 'CALLS' AND provenance = 'runtime'), ran AS (SELECT DISTINCT rev, src, true AS ran FROM rt),
        x AS (SELECT * FROM st FULL JOIN rt USING (rev, src, dst) LEFT JOIN ran USING (rev, src)),
        n AS (SELECT rev, count(*) FILTER (seen) AS observed, count(*) FILTER (seen AND rank IS NOT NULL) AS hit, count(*) FILTER (seen AND rank > 0) AS strong, count(*) FILTER (rank IS NOT NULL AND ran) AS judged FROM x GROUP BY ALL)
        SELECT rev, observed, judged, round(CASE WHEN observed = 0 THEN 1.0 ELSE hit / observed END, 6) AS recall, round(CASE WHEN observed = 0 THEN 1.0 ELSE strong / observed END, 6) AS recall_strong, round(CASE WHEN judged = 0 THEN 1.0 ELSE hit / judged END, 6) AS "precision" FROM n""",
    "fan_in_quartiles": f"WITH {_LINKS}, {_RESOLVED}, {_MAYBE}, {_FAN} SELECT rev, round(quantile_cont(fan_in, 0.25), 6) AS q1, round(quantile_cont(fan_in, 0.5), 6) AS q2, round(quantile_cont(fan_in, 0.75), 6) AS q3 FROM fan GROUP BY ALL",
    "lines_rollup": f"""WITH {_TREE}, {_SIZED}, u AS (SELECT rev, lines, string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS n FROM sized)
        SELECT rev, array_to_string(parts[1:n], '/') AS folder, sum(lines)::BIGINT AS n_lines, count(*) AS n_files FROM u GROUP BY ALL""",
    "source_budget": f"WITH {_TREE}, {_SIZED} SELECT rev, path, n_bytes, sum(n_bytes) OVER (PARTITION BY rev ORDER BY path)::BIGINT AS upto FROM sized QUALIFY upto <= 1000000",
    "preorder": rf"""WITH {_TREE}, p AS (SELECT rev, path, row_number() OVER (PARTITION BY rev ORDER BY string_split(path, '/')) AS pos, regexp_replace(path, '/?[^/]*$', '') AS folder FROM snap)
        SELECT rev, path, pos, (SELECT max(b.pos) FROM p b WHERE b.rev = p.rev AND (p.folder = '' OR starts_with(b.path, p.folder || '/'))) AS folder_end FROM p""",
}


def history_sql() -> str:
    """What revisions change: links (``le``) and effects (``ee``) gained and lost after certain moves (``moves``)."""
    direct = _direct()
    own = "calls AS (SELECT rev, src, dst, max(rank) AS rank FROM l WHERE kind = 'CALLS' AND src <> dst GROUP BY ALL HAVING max(rank) IS NOT NULL), own AS (SELECT rev, id, effect, max(rank) AS rank FROM direct GROUP BY ALL)"
    spread = "w AS (SELECT rev, id, effect, rank FROM own UNION SELECT c.rev, c.src, w.effect, least(w.rank, c.rank) FROM w JOIN calls c ON c.rev = w.rev AND c.dst = w.id), best AS (SELECT w.rev, w.id, w.effect, coalesce(any_value(own.rank), max(w.rank)) AS rank, any_value(own.rank) IS NOT NULL AS direct FROM w LEFT JOIN own USING (rev, id, effect) GROUP BY ALL)"
    return f"""WITH RECURSIVE {_STATE}, {_REFS}, {direct}, {own}, {spread}, {_MOVES}, moves AS (SELECT idx, removed, added FROM p WHERE n_removed = 1 AND n_added = 1 AND body_hash IS NOT NULL), last AS (SELECT max(idx) AS i FROM revs),
            ln AS (SELECT DISTINCT idx, src, dst, coalesce(kind, '') AS kind FROM strong JOIN revs USING (rev)),
            lb AS (SELECT DISTINCT n.idx + 1 AS idx, coalesce(a.added, n.src) AS src, coalesce(b.added, n.dst) AS dst, kind FROM ln n LEFT JOIN moves a ON a.idx = n.idx + 1 AND a.removed = n.src LEFT JOIN moves b ON b.idx = n.idx + 1 AND b.removed = n.dst, last WHERE n.idx < last.i),
            le AS (SELECT *, 'added' AS change FROM (SELECT * FROM ln WHERE idx > 0 EXCEPT SELECT * FROM lb) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM lb EXCEPT SELECT * FROM ln)),
            en AS (SELECT DISTINCT idx, id, effect FROM best JOIN revs USING (rev) WHERE rank > 0), eb AS (SELECT DISTINCT n.idx + 1 AS idx, coalesce(a.added, n.id) AS id, effect FROM en n LEFT JOIN moves a ON a.idx = n.idx + 1 AND a.removed = n.id, last WHERE n.idx < last.i),
            ee AS (SELECT *, 'added' AS change FROM (SELECT * FROM en WHERE idx > 0 EXCEPT SELECT * FROM eb) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM eb EXCEPT SELECT * FROM en))"""


def _late() -> dict[str, str]:
    islands = ORACLES["island_mechanisms"]
    at = islands.rindex("        SELECT rev, island, n, concat_ws")
    direct, history = _direct(), history_sql()
    return {
        "islands_summary": islands[:at] + "SELECT rev, sum(n)::BIGINT AS symbols, count(*) AS islands, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (traced) AS traced, count(*) FILTER (NOT (entry OR dunder OR decorator OR test OR override OR nested OR traced)) AS unexplained FROM s GROUP BY rev",
        "direct_effects": f"WITH {_TREE}, {_REFS}, {direct} SELECT * FROM direct",
        "glob_best_match": f"WITH {_REFS}, {_rules()} SELECT name, a.effect AS effect, a.rank AS rank, a.match AS \"match\" FROM ruled",
        "widest_path_effects": (wide := f"""WITH RECURSIVE {_TREE}, {_REFS}, {direct}, {_LINKS}, calls AS (SELECT rev, src, dst, max(rank) AS rank FROM l WHERE kind = 'CALLS' AND src <> dst GROUP BY ALL HAVING max(rank) IS NOT NULL), own AS (SELECT rev, id, effect, max(rank) AS rank FROM direct GROUP BY ALL),
            w AS (SELECT rev, id, effect, rank FROM own UNION SELECT c.rev, c.src, w.effect, least(w.rank, c.rank) FROM w JOIN calls c ON c.rev = w.rev AND c.dst = w.id),
            best AS (SELECT w.rev, w.id, w.effect, coalesce(any_value(own.rank), max(w.rank)) AS rank, any_value(own.rank) IS NOT NULL AS direct FROM w LEFT JOIN own USING (rev, id, effect) GROUP BY ALL)""")
        + " SELECT * FROM best",
        "effect_witness": f"""WITH RECURSIVE {_TREE}, {_REFS}, {direct}, {_LINKS}, calls AS (SELECT rev, src, dst, max(rank) AS r FROM l WHERE kind = 'CALLS' AND src <> dst GROUP BY ALL HAVING max(rank) IS NOT NULL), own AS (SELECT rev, id, effect, max(rank) AS own FROM direct GROUP BY ALL),
            f(rev, effect, tier, id, hops) USING KEY (rev, effect, tier, id) AS (SELECT rev, effect, t, id, 0 FROM own, range(3) x(t) WHERE t <= own UNION
                SELECT DISTINCT f.rev, f.effect, f.tier, c.src, f.hops + 1 FROM f JOIN calls c ON c.rev = f.rev AND c.dst = f.id AND c.r >= f.tier WHERE (f.rev, f.effect, f.tier, c.src) NOT IN (SELECT (rev, effect, tier, id) FROM recurring.f)),
            b AS (SELECT f.* FROM f LEFT JOIN own USING (rev, id, effect) WHERE own IS NULL OR tier = own QUALIFY row_number() OVER (PARTITION BY rev, id, effect ORDER BY tier DESC) = 1)
            SELECT b.rev, b.id, b.effect, b.tier AS rank, b.hops, min(n.id) AS next FROM b LEFT JOIN calls c ON c.rev = b.rev AND c.src = b.id AND c.r >= b.tier AND b.hops > 0
            LEFT JOIN f n ON n.rev = c.rev AND n.id = c.dst AND n.effect = b.effect AND n.tier = b.tier AND n.hops = b.hops - 1 GROUP BY ALL""",
        "effects_with_hubs": (hubs := f"""WITH RECURSIVE {_RESOLVED}, {direct}, {_LINKS}, o AS (SELECT DISTINCT rev, src, regexp_extract(name, '[^.]*$') AS hub FROM resolved WHERE reason = 'ambiguous'),
            hub AS (SELECT rev, src, '*' || hub AS dst FROM o UNION ALL SELECT DISTINCT rev, '*' || regexp_extract(qualname, '[^.]*$'), id FROM symbols WHERE name_binding = 'live' AND kind <> 'module' AND (rev, regexp_extract(qualname, '[^.]*$')) IN (SELECT (rev, hub) FROM o)),
            calls AS (SELECT rev, src, dst, max(rank) AS rank FROM (SELECT rev, src, dst, rank FROM l WHERE kind = 'CALLS' UNION ALL SELECT rev, src, dst, 0 FROM hub) WHERE src <> dst GROUP BY ALL HAVING max(rank) IS NOT NULL), own AS (SELECT rev, id, effect, max(rank) AS rank FROM direct GROUP BY ALL)""")
        .replace("FROM resolved WHERE reason = 'ambiguous')", "FROM resolved WHERE reason = 'ambiguous' AND ref_kind = 'call')")
        + """, w AS (SELECT rev, id, effect, rank FROM own UNION SELECT c.rev, c.src, w.effect, least(w.rank, c.rank) FROM w JOIN calls c ON c.rev = w.rev AND c.dst = w.id)
            SELECT w.rev, w.id, w.effect, coalesce(any_value(own.rank), max(w.rank)) AS rank, any_value(own.rank) IS NOT NULL AS direct FROM w LEFT JOIN own USING (rev, id, effect) WHERE NOT starts_with(w.id, '*') GROUP BY ALL""",
        "islands_with_hubs": hubs + f""", all_l AS (SELECT rev, src, dst FROM l UNION ALL SELECT rev, src, dst FROM hub), {_SYM.replace("FROM l ", "FROM all_l ")}, {_CC}
            SELECT rev, id, min(id) OVER (PARTITION BY rev, island) AS island FROM cc WHERE NOT starts_with(id, '*')""",
        "symbol_history": f"""{history}, bd AS (SELECT idx, item, '' AS target, content.b AS content FROM content), be AS ({_diff('bd', 'body')}),
            e AS (SELECT idx, item AS id, 'body' AS what FROM be WHERE change = 'changed' UNION ALL SELECT idx, src, 'calls_' || change FROM le UNION ALL SELECT idx, dst, 'dependents_' || change FROM le UNION ALL SELECT idx, id, 'effects_' || change FROM ee
                UNION ALL SELECT idx, added, 'moved' FROM moves UNION ALL SELECT DISTINCT g.idx, g.id, 'unsure' FROM g SEMI JOIN (SELECT * FROM p WHERE n_removed > 0 AND n_added > 0 AND n_removed + n_added > 2 AND body_hash IS NOT NULL) u ON u.idx = g.idx AND u.kind = g.kind AND u.body_hash = g.body_hash),
            n AS (SELECT idx, id, {", ".join(f"count(*) FILTER (what = '{w}') AS {w}" for w in ("body", "calls_added", "calls_removed", "dependents_added", "dependents_removed", "effects_added", "effects_removed"))}, bool_or(what = 'unsure') AS lineage_ambiguous FROM e GROUP BY ALL)
            SELECT n.* EXCLUDE (idx), m.removed AS moved_from, rev FROM n LEFT JOIN moves m ON m.idx = n.idx AND m.added = n.id JOIN revs ON revs.idx = n.idx""",
        "history_steps": f"""{history}, events AS (SELECT idx, 'symbols_' || change AS c FROM ({_diff('content', 'symbols')}) UNION ALL SELECT idx, 'edges_' || change FROM le UNION ALL SELECT idx, 'effects_' || change FROM ee UNION ALL SELECT idx, 'moves' FROM moves)
            SELECT rev, {", ".join(f"count(*) FILTER (c = '{c}') AS {c}" for c in ("symbols_added", "symbols_removed", "symbols_changed", "edges_added", "edges_removed", "effects_added", "effects_removed", "moves"))} FROM events JOIN revs USING (idx) GROUP BY rev""",
        "containment_division": rf"""WITH RECURSIVE {_SYMBOLS}, {_ANCESTORS}, own_m AS (SELECT DISTINCT rev, path || '::' || regexp_replace(qualname, '\.[^.]+$', '') AS id, regexp_extract(qualname, '[^.]*$') AS m FROM symbols WHERE kind = 'method'),
            ms AS (SELECT rev, id, m FROM own_m UNION SELECT a.rev, a.cls, m.m FROM a JOIN own_m m ON m.rev = a.rev AND m.id = a.anc),
            pr AS (SELECT DISTINCT rev, dst AS protocol FROM l WHERE kind IN ('IMPLEMENTS', 'INHERITS')), req AS (SELECT rev, protocol, m FROM pr JOIN ms USING (rev) WHERE ms.id = protocol), size AS (SELECT rev, protocol, count(*) AS n FROM req GROUP BY ALL)
            SELECT req.rev, req.protocol, ms.id FROM req JOIN ms ON ms.rev = req.rev AND ms.m = req.m JOIN size ON size.rev = req.rev AND size.protocol = req.protocol
            WHERE (ms.rev, ms.id) NOT IN (SELECT (rev, protocol) FROM pr) AND (ms.rev, ms.id, req.protocol) NOT IN (SELECT (rev, cls, anc) FROM a) GROUP BY req.rev, req.protocol, ms.id, n HAVING count(*) = n""",
        "class_ancestors": f"WITH RECURSIVE {_ANCESTORS} SELECT * FROM a",
        "dirty_paths": f"""WITH {_TREE}, n AS (SELECT * FROM snap JOIN revs USING (rev)), w AS (SELECT * FROM n WHERE rev = 'WORKTREE'), h AS (SELECT * FROM n WHERE idx = (SELECT max(idx) - 1 FROM w))
            SELECT coalesce(w.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM h FULL JOIN w ON w.path = h.path WHERE h.sha IS DISTINCT FROM w.sha""",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
        "user_sessions": """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS begins FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
            SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, k""",
        "effect_summary": f"{wide} SELECT rev, effect, rank, count(*) AS n, count(*) FILTER (direct) AS n_direct, list_position({list(SEVERITY)}, effect) - 1 AS severity FROM best GROUP BY rev, effect, rank",
    }
