"""Recorded runs: taking them in, holding them against the tree, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.operators.incremental import drop_revision, fingerprint


class TraceMismatch(ValueError):
    """Nothing in a recorded run is known to the revision: it belongs to another tree."""


def path_of(symbol: Column) -> Column:
    return F.substring_index(symbol, "::", 1)


def import_trace(calls: DataFrame, executed: DataFrame, symbols: DataFrame) -> tuple[str, DataFrame, DataFrame]:
    """A run (``src``, ``dst``; ``id``) as the revision with ``symbols`` (``id``) knows it.

    :returns: an id that depends on what was recorded alone, the calls without repeats and self-calls, and
        what ran. Calls whose ends are unknown are kept, since a later revision may know them; only a run of which not a single
        symbol is known is refused.
    """
    links = calls.where("src != dst").select("src", "dst").distinct()
    ran = executed.where("id is not null").select("id").distinct()
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).union(ran).distinct()
    if ends.join(symbols.select("id"), "id", "left_semi").isEmpty():
        raise TraceMismatch("no recorded symbol is in this revision")
    both = links.select("src", "dst").union(ran.select(F.lit("").alias("src"), F.col("id").alias("dst")))
    return fingerprint(both)[:16], links, ran


def forget(rev: str, *relations: DataFrame) -> tuple[DataFrame, ...]:
    """The relations of recorded runs without those of one revision."""
    return tuple(drop_revision(x, rev) for x in relations)


def touched_paths(calls: DataFrame, executed: DataFrame) -> DataFrame:
    """``path`` of every file at either end of a call, or in which something ran."""
    ids = calls.select(F.explode(F.array("src", "dst")).alias("id")).union(executed.select("id"))
    return ids.select(path_of(F.col("id")).alias("path")).where("path is not null").distinct()


def stale_paths(recorded: DataFrame, tree: DataFrame) -> DataFrame:
    """``path`` of recorded files (``path``, ``blob_sha``) that the tree no longer holds as they were."""
    now = tree.select("path", F.col("blob_sha").alias("now"))
    return recorded.join(now, "path", "left").where(~F.col("blob_sha").eqNullSafe(F.col("now"))).select("path").distinct()


def observed_nodes(executed: DataFrame, stale: DataFrame) -> DataFrame:
    """What ran and still stands as it ran: ``id``."""
    return executed.select("id", path_of(F.col("id")).alias("path")).join(stale, "path", "left_anti").select("id").distinct()


def project(calls: DataFrame, static: DataFrame, symbols: DataFrame, stale: DataFrame) -> DataFrame:
    """What each recorded call is now: ``src``, ``dst``, ``status``, ``path``, ``line``.

    ``stale`` if a file at either end differs; ``unmodelable`` if an end is no symbol, or what is called is no function, method or
    class; ``confirmed`` if a static call says the same, at its first site; else ``added``, at the line of the caller.

    :param static: ``src``, ``dst``, ``callsite_path``, ``callsite_line`` of static calls; :param symbols: ``id``, ``kind``, ``line_start``
    """
    known = symbols.groupBy("id").agg(F.min("line_start").alias("line_start"), F.bool_or(F.col("kind").isin("function", "method", "class")).alias("callable"))
    sites = static.groupBy("src", "dst").agg(F.min(F.struct("callsite_line", "callsite_path")).alias("site"))
    gone = stale.select(F.col("path").alias("__p"), F.lit(True).alias("gone"))
    x = calls.select("src", "dst").distinct()
    for end in ("src", "dst"):
        x = x.withColumn("__p", path_of(F.col(end))).join(gone.withColumnRenamed("gone", f"{end}_gone"), "__p", "left").drop("__p")
    x = x.join(known.select(F.col("id").alias("src"), "line_start", F.lit(True).alias("src_known")), "src", "left").join(known.select(F.col("id").alias("dst"), "callable"), "dst", "left").join(sites, ["src", "dst"], "left")
    status = (
        F.when(F.col("src_gone").isNotNull() | F.col("dst_gone").isNotNull(), "stale")
        .when(F.col("src_known").isNull() | ~F.coalesce("callable", F.lit(False)), "unmodelable")
        .when(F.col("site").isNotNull(), "confirmed")
        .otherwise("added")
    )
    placed = status.isin("confirmed", "added")
    return x.select("src", "dst", status.alias("status"), F.when(placed, F.coalesce("site.callsite_path", path_of(F.col("src")))).alias("path"), F.when(placed, F.coalesce("site.callsite_line", "line_start")).alias("line"))


def describe(projected: DataFrame) -> str:
    """One line on a projected run; ``none`` where nothing was recorded, and a plain word where all of it is out of date."""
    n = {r.status: r["count"] for r in projected.groupBy("status").count().collect()}  # four rows
    if not n:
        return "none"
    if set(n) == {"stale"}:
        return f"all {n['stale']} recorded calls are of files that changed since; record the run again"
    return ", ".join(f"{n.get(s, 0)} {s}" for s in ("confirmed", "added", "stale", "unmodelable"))
