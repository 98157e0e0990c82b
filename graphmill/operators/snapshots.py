"""What changed between full snapshots.

A record is a key with a content (any hashable value) in some snapshots.
Neighbouring snapshots with the same content form an island, the islands of a
key are its validity intervals, and the borders of the intervals are the
changes: a start is an addition, an end a removal, and two intervals that touch
are a change of content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import plain_path, plain_sha
from graphmill.workspace import broadcast_if_small, cut


def delivered_revisions(revisions: DataFrame, delivered: DataFrame) -> DataFrame:
    """``rev``, ``idx`` (0, 1, ...) of the delivered revisions in order of their earliest ``materialized_at``.

    Only revisions that occur in ``delivered.rev`` count. Equal times are
    ordered by ``rev``; a revision without a time comes first; null revs are ignored.
    A table of one row per snapshot: the window without partitions sorts just that.
    """
    known = revisions.where(F.col("rev").isNotNull()).groupBy("rev").agg(F.min("materialized_at").alias("at"))
    seen = delivered.where(F.col("rev").isNotNull()).select("rev").distinct()
    order = Window.orderBy(F.col("at").asc_nulls_first(), "rev")
    return known.join(seen, "rev", "left_semi").select("rev", (F.row_number().over(order) - 1).alias("idx"))


def latest_rows(tree: DataFrame) -> DataFrame:
    """The snapshot of each revision: ``rev``, ``path`` (plain), ``blob_sha`` (lower case).

    Of several rows of a (rev, path) the one with the latest ``ingested_at``
    counts (null is earliest; at the same moment the greatest sha); where that
    row has a null or empty sha the path is absent. Rows without rev or path are ignored.
    """
    rows = tree.where(F.col("rev").isNotNull() & F.col("path").isNotNull()).select("rev", plain_path(F.col("path")).alias("path"), F.struct("ingested_at", F.coalesce(plain_sha(F.col("blob_sha")), F.lit("")).alias("sha")).alias("row"))
    return rows.groupBy("rev", "path").agg(F.max("row").alias("row")).where("row.sha != ''").select("rev", "path", F.col("row.sha").alias("blob_sha"))


def validity_intervals(rows: DataFrame, keys: Sequence[str], content: str, idx: str = "idx") -> DataFrame:
    """Islands of equal content in consecutive snapshots: ``keys``, ``content``, ``valid_from``, ``valid_to`` (inclusive).

    ``rows`` has at most one row per key and snapshot. Null keys match each
    other and null contents are equal. A key has no more rows than there are
    snapshots, so no group grows with the data.
    """
    by_time = Window.partitionBy(*keys).orderBy(idx)
    starts = F.lag(idx).over(by_time).isNull() | (F.col(idx) != F.lag(idx).over(by_time) + 1) | ~F.col(content).eqNullSafe(F.lag(content).over(by_time))
    numbered = rows.select(*keys, content, idx).withColumn("__start", starts).withColumn("__island", F.sum(F.col("__start").cast("int")).over(by_time))
    return numbered.groupBy(*keys, "__island").agg(F.first(content).alias(content), F.min(idx).alias("valid_from"), F.max(idx).alias("valid_to")).drop("__island")


def change_events(intervals: DataFrame, keys: Sequence[str], content: str, last: int) -> DataFrame:
    """Changes from validity intervals: ``keys``, ``idx`` (of the later snapshot), ``change``.

    Intervals of a key may touch with equal content (then nothing changes
    there) but must not overlap. ``last`` is the number of the last snapshot.
    What starts at snapshot 0 is not an addition.
    """
    by_time = Window.partitionBy(*keys).orderBy("valid_from")
    before, after = F.lag("valid_to").over(by_time), F.lead("valid_from").over(by_time)
    touching = before == F.col("valid_from") - 1
    other = ~F.col(content).eqNullSafe(F.lag(content).over(by_time))
    marked = intervals.withColumn("__begin", F.when(touching & other, "changed").when((before.isNull() | ~touching) & (F.col("valid_from") > 0), "added"))
    marked = marked.withColumn("__end", F.when((after.isNull() | (after > F.col("valid_to") + 1)) & (F.col("valid_to") < last), "removed"))
    both = F.array(
        F.struct(F.col("valid_from").alias("idx"), F.col("__begin").alias("change")),
        F.struct((F.col("valid_to") + 1).alias("idx"), F.col("__end").alias("change")),
    )
    return marked.select(*keys, F.explode(F.filter(both, lambda x: x["change"].isNotNull())).alias("e")).select(*keys, "e.idx", "e.change")


def tree_intervals(tree: DataFrame, revs: DataFrame) -> DataFrame:
    """Validity of each path's text: ``path``, ``blob_sha``, ``valid_from``, ``valid_to``."""
    rows = latest_rows(tree).join(revs, "rev").select("path", "blob_sha", "idx")
    return validity_intervals(rows, ["path"], "blob_sha")


def live_symbols(nodes: DataFrame) -> DataFrame:
    """``blob_sha``, ``qualname``, ``body_hash`` of live definitions; of several of one name the last by ordinal."""
    live = nodes.where((F.col("name_binding") == "live") & F.col("blob_sha").isNotNull() & F.col("qualname").isNotNull())
    return live.groupBy(F.lower("blob_sha").alias("blob_sha"), "qualname").agg(F.max(F.struct("ordinal", "body_hash")).alias("x")).select("blob_sha", "qualname", F.col("x.body_hash").alias("body_hash"))


def symbol_intervals(intervals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Validity of symbols (``path``, ``qualname``) from the validity of the paths' texts.

    Joined by text, so an unchanged file costs one row and not one per
    snapshot. A text that very many paths share makes its side of the join
    skewed; adaptive execution splits that partition.
    """
    return intervals.join(live_symbols(nodes), "blob_sha").select("path", "qualname", "body_hash", "valid_from", "valid_to")


def edge_states(edges: DataFrame, revs: DataFrame) -> DataFrame:
    """One row per (src, dst, snapshot) with ``state``, a hash of its set of distinct (kind, confidence).

    One shuffle, by (src, dst): distinct rows, set hash, and whatever windows
    follow all use it. The set hash adds up two independent 32-bit halves and
    XORs a 64-bit hash over the distinct members, so order and repeats do not matter.
    """
    links = edges.where(F.col("src").isNotNull() & (F.col("dst") != "") & F.col("rev").isNotNull()).join(revs, "rev")
    member = F.xxhash64(F.coalesce("kind", F.lit("\x00")), F.lit("|"), F.coalesce("confidence", F.lit("\x00")))
    once = links.select("src", "dst", "idx", member.alias("m")).repartition("src", "dst").groupBy("src", "dst", "idx", "m").agg(F.lit(1).alias("one"))
    state = F.struct(F.bit_xor("m").alias("x"), F.sum(F.shiftrightunsigned("m", 34)).alias("s"))
    return once.groupBy("src", "dst", "idx").agg(state.alias("state"))


def revision_changes(revisions: DataFrame, tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every path, symbol and linked pair added, removed or changed from one delivered revision to the next.

    :returns: ``rev`` (the later one), ``record`` (``tree``, ``symbol``, ``edge``), ``item``, ``target``, ``change``
    """
    revs = broadcast_if_small(cut(delivered_revisions(revisions, tree)))
    last = revs.agg(F.max("idx")).first()[0] or 0
    paths = cut(tree_intervals(tree, revs))
    none = F.lit("").alias("target")
    events = (
        change_events(paths, ["path"], "blob_sha", last).select(F.lit("tree").alias("record"), F.col("path").alias("item"), none, "idx", "change"),
        change_events(symbol_intervals(paths, nodes), ["path", "qualname"], "body_hash", last).select(F.lit("symbol").alias("record"), F.concat_ws("::", "path", "qualname").alias("item"), none, "idx", "change"),
        change_events(validity_intervals(edge_states(edges, revs), ["src", "dst"], "state"), ["src", "dst"], "state", last).select(F.lit("edge").alias("record"), F.col("src").alias("item"), F.col("dst").alias("target"), "idx", "change"),
    )
    union = events[0].unionByName(events[1]).unionByName(events[2])
    return union.join(revs, "idx").select("rev", "record", "item", "target", "change")
