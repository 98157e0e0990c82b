"""Reports as relations, and what is said about what they leave out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why an answer may be incomplete, whether that blocks, and what to do about it.
NEXT_ACTIONS = {
    "unknown": (True, "name the target at the call, or record a run"),
    "ambiguous": (True, "give the receiver a type, or list weak links too"),
    "external": (False, "nothing; the target is outside the tree"),
    "builtin": (False, "nothing; the target belongs to the language"),
    "unexplained_island": (True, "record a run, or look for use by name"),
    "hop_limit": (True, "allow more hops"),
    "low_confidence": (True, "list weak links too"),
    "lineage_ambiguous": (True, "follow one of the possible moves by hand"),
}


def envelope(reason: Column) -> Column:
    """``struct<reason, action, blocking>`` of a reason; an unheard-of reason blocks."""
    action, blocking = F.lit("look into it"), F.lit(True)
    for name, (blocks, what) in NEXT_ACTIONS.items():
        action = F.when(reason == name, what).otherwise(action)
        blocking = F.when(reason == name, F.lit(blocks)).otherwise(blocking)
    return F.struct(reason.alias("reason"), action.alias("action"), blocking.alias("blocking"))


def is_incomplete(reasons: DataFrame) -> DataFrame:
    """Per ``rev``, ``id``: whether any of its reasons blocks."""
    return reasons.groupBy("rev", "id").agg(F.bool_or(envelope(F.col("reason"))["blocking"]).alias("incomplete"))


def grouped_report(rows: DataFrame, keys: Sequence[str], section: str, place: str, fields: Sequence[str]) -> DataFrame:
    """One report per key as nested values: ``groups``, an array of (title, rows), with rows in place order.

    The rows of a report are those of a budget, so the arrays are short.
    """
    inner = rows.groupBy(*keys, section).agg(F.array_sort(F.collect_list(F.struct(place, *fields))).alias("rows"))
    return inner.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(section).alias("title"), "rows"))).alias("groups"))


def as_json(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    return report.select(*keys, F.to_json(F.struct(*[c for c in report.columns if c not in keys])).alias("json"))


def summary_line(values: dict[str, Column]) -> Column:
    """``key: value`` pairs on one line; an empty list, or null, reads ``none``."""
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("none"))) for k, v in values.items()])


def highlighted(reports: DataFrame) -> DataFrame:
    """Symbols a report in JSON speaks of: ids in its rows, and ``symbol``, ``from``, ``to`` of its summary. ``report``, ``id``."""
    schema = "summary struct<symbol:string,`from`:string,`to`:string>, groups array<struct<title:string,rows:array<struct<id:string>>>>"
    x = reports.select("report", F.from_json("json", schema).alias("r"))
    ids = F.concat(F.flatten(F.transform(F.coalesce("r.groups", F.array()), lambda g: F.transform(F.coalesce(g["rows"], F.array()), lambda y: y["id"]))), F.array("r.summary.symbol", "r.summary.from", "r.summary.to"))
    return x.select("report", F.explode(ids).alias("id")).where("contains(id, '::')").distinct()


def report_label(reports: DataFrame) -> DataFrame:
    """``report``, ``label``: what a report in JSON is about, the first of its ``symbol``, ``from`` and ``to``, else the titles of its groups."""
    x = reports.select("report", F.from_json("json", "summary struct<symbol:string,`from`:string,`to`:string>, groups array<struct<title:string>>").alias("r"))
    titles = F.array_join(F.transform(F.coalesce("r.groups", F.array()), lambda g: g["title"]), ", ")
    return x.select("report", F.coalesce("r.summary.symbol", "r.summary.from", "r.summary.to", F.nullif(titles, F.lit(""))).alias("label"))


def with_sessions(rows: DataFrame, sessions: DataFrame, commit: str = "rev") -> DataFrame:
    """Rows of a history with ``sessions``, the pointers of their commit (``commit``, ``sessions``); an empty list where there are none."""
    known = sessions.select(F.col("commit").alias(commit), "sessions").dropDuplicates([commit])
    return rows.join(known, commit, "left").withColumn("sessions", F.coalesce("sessions", F.array().cast("array<string>")))


def replace_marked(lines: Column, begin: str, end: str, block: Sequence[str]) -> Column:
    """Lines of a text with exactly one marked block: the first is replaced in place, others are removed, and it is added at the end where there is none.

    Null where the markers do not pair up: such a text is not touched.
    """
    new = F.array(F.lit(begin), *map(F.lit, block), F.lit(end))
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x == begin, i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(lines, lambda x, i: F.when(x == end, i)), lambda i: i.isNotNull())
    paired = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    following = F.forall(F.sequence(F.lit(0), F.size(starts) - 1), lambda k: (F.get(ends, k) > F.get(starts, k)) & ((k == 0) | (F.get(starts, k) > F.coalesce(F.get(ends, k - 1), F.lit(-1)))))
    sound = (F.size(starts) == F.size(ends)) & ((F.size(starts) == 0) | following)
    outside = F.transform(lines, lambda x, i: F.when(~F.exists(paired, lambda p: (i >= p["s"]) & (i <= p["e"])), F.array(x)).when(i == F.get(starts, F.lit(0)), new).otherwise(F.array().cast("array<string>")))
    return F.when(sound, F.when(F.size(starts) == 0, F.concat(lines, new)).otherwise(F.flatten(outside)))
