"""Queries of the general data problems: hot keys (p1) and snapshot changes (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.text import normalized_names
from graphmill.operators import skew, snapshots
from graphmill.workspace import table

#: Quantiles reported per key.
QUANTILES = (0.25, 0.5, 0.75, 0.9)


def _keyed(spark: SparkSession, d: str, link_columns: dict[str, str], name_columns: dict[str, str]) -> DataFrame:
    """``field``, ``key_value`` and the given columns: the links of ``edges`` by ``dst`` and the rows of ``blob_refs`` by name."""
    edges = table(spark, d, "edges").where(F.col("dst") != "")
    names = normalized_names(table(spark, d, "blob_refs"), "raw_name", "name")
    links = edges.select(F.lit("edges.dst").alias("field"), F.col("dst").alias("key_value"), *[F.col(c).alias(a) for a, c in link_columns.items()])
    return links.unionByName(names.select(F.lit("blob_refs.raw_name").alias("field"), F.col("name").alias("key_value"), *[F.col(c).alias(a) for a, c in name_columns.items()]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys on at least 1 % of the rows of their table that have a key."""
    return skew.frequent_keys(_keyed(spark, d, {}, {}), "field", "key_value", one_in=100).select("field", "key_value")


def p1_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct callers per symbol, rows and distinct texts per name."""
    return skew.per_key_counts(_keyed(spark, d, {"member": "src"}, {"member": "blob_sha"}), ["field", "key_value"], "member")


def p1_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of the line of use per symbol and per name."""
    rows = _keyed(spark, d, {"line": "callsite_line"}, {"line": "line"})
    return skew.exact_quantiles(rows, ["field", "key_value"], "line", QUANTILES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths, symbols and linked pairs that differ between neighbouring delivered revisions."""
    return snapshots.revision_changes(table(spark, d, "revisions"), table(spark, d, "tree"), table(spark, d, "blob_nodes"), table(spark, d, "edges"))


def p2_validity(spark: SparkSession, d: str) -> DataFrame:
    """Validity intervals of every path's text, by numbers of delivered revisions."""
    revs = snapshots.delivered_revisions(table(spark, d, "revisions"), table(spark, d, "tree"))
    return snapshots.tree_intervals(table(spark, d, "tree"), revs)


QUERIES = {"p1_found": p1_found, "p1_key_counts": p1_key_counts, "p1_key_quantiles": p1_key_quantiles, "p2_found": p2_found, "p2_validity": p2_validity}

_KEYED = r"""
    SELECT 'edges.dst' AS field, dst AS key_value, src AS member, callsite_line AS line FROM edges WHERE dst <> ''
    UNION ALL
    SELECT 'blob_refs.raw_name', nfc_normalize(regexp_replace(raw_name, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')), blob_sha, line FROM blob_refs WHERE raw_name IS NOT NULL
"""

_TREE = r"""
    spelled AS (SELECT rev, trim(regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\.?/)+', '\1', 'g'), '(^|/)\.$', ''), '/') AS path, coalesce(lower(blob_sha), '') AS sha, ingested_at FROM tree WHERE rev IS NOT NULL AND path IS NOT NULL),
    snap AS (SELECT rev, path, sha FROM (SELECT *, row_number() OVER (PARTITION BY rev, path ORDER BY ingested_at DESC NULLS LAST, sha DESC) AS n FROM spelled) WHERE n = 1 AND sha <> ''),
    revs AS (SELECT rev, row_number() OVER (ORDER BY min(materialized_at) NULLS FIRST, rev) - 1 AS idx FROM revisions WHERE rev IN (SELECT rev FROM tree) GROUP BY rev)
"""


def _diff(rows: str, record: str) -> str:
    """SQL of the changes of a relation (idx, item, target, content)."""
    return f"""
        SELECT coalesce(b.idx, a.idx + 1) AS idx, '{record}' AS record, coalesce(b.item, a.item) AS item, coalesce(b.target, a.target) AS target,
               CASE WHEN a.item IS NULL THEN 'added' WHEN b.item IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM {rows} a FULL JOIN {rows} b ON b.idx = a.idx + 1 AND b.item = a.item AND b.target = a.target
        WHERE (a.item IS NULL OR b.item IS NULL OR a.content IS DISTINCT FROM b.content) AND coalesce(b.idx, a.idx + 1) BETWEEN 1 AND (SELECT max(idx) FROM revs)
    """


ORACLES = {
    "p1_found": f"WITH k AS ({_KEYED}), n AS (SELECT field, key_value, count(*) AS c FROM k GROUP BY ALL) SELECT field, key_value FROM n QUALIFY c * 100 >= sum(c) OVER (PARTITION BY field)",
    "p1_key_counts": f"SELECT field, key_value, count(*) AS n_rows, count(DISTINCT member) AS n_members FROM ({_KEYED}) GROUP BY ALL",
    "p1_key_quantiles": f"""
        WITH r AS (SELECT field, key_value, line, row_number() OVER (PARTITION BY field, key_value ORDER BY line) AS k, count(*) OVER (PARTITION BY field, key_value) AS n_values FROM ({_KEYED}) WHERE line IS NOT NULL)
        SELECT field, key_value, prob, line::BIGINT AS "value", n_values FROM r, (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in QUANTILES)}]) AS prob) WHERE k = greatest(1, ceil(prob * n_values))
    """,
    "p2_found": f"""
        WITH {_TREE},
        paths AS (SELECT idx, path AS item, '' AS target, sha AS content FROM snap JOIN revs USING (rev)),
        live AS (SELECT lower(blob_sha) AS sha, qualname, arg_max(body_hash, ordinal) AS body_hash FROM blob_nodes WHERE name_binding = 'live' GROUP BY ALL),
        symbols AS (SELECT idx, item || '::' || qualname AS item, '' AS target, body_hash AS content FROM paths JOIN live ON live.sha = paths.content),
        links AS (SELECT idx, src AS item, dst AS target, list_sort(list(DISTINCT coalesce(kind, '?') || '|' || coalesce(confidence, '?'))) AS content FROM edges JOIN revs USING (rev) WHERE dst <> '' AND src IS NOT NULL GROUP BY ALL),
        events AS ({_diff("paths", "tree")} UNION ALL {_diff("symbols", "symbol")} UNION ALL {_diff("links", "edge")})
        SELECT rev, record, item, target, change FROM events JOIN revs USING (idx)
    """,
    "p2_validity": f"""
        WITH {_TREE},
        marked AS (SELECT path, sha, idx, CASE WHEN lag(idx) OVER w = idx - 1 AND lag(sha) OVER w = sha THEN 0 ELSE 1 END AS begins FROM snap JOIN revs USING (rev) WINDOW w AS (PARTITION BY path ORDER BY idx)),
        numbered AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY idx) AS island FROM marked)
        SELECT path, sha AS blob_sha, min(idx) AS valid_from, max(idx) AS valid_to FROM numbered GROUP BY path, sha, island
    """,
}
