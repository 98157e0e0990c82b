"""Text search as a way to callers: hits, the definitions around them, and their names in turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.names import last_segment
from graphmill.workspace import cut, rows_of, unseen

#: A word: letters of any script, digits and underscores.
WORD = r"(?U)\w+"


def words_of(texts: DataFrame) -> DataFrame:
    """``blob_sha``, ``line``, ``word``: the distinct words of every line of ``texts`` (``blob_sha``, ``content``)."""
    lines = texts.select("blob_sha", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return lines.select("blob_sha", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))


def attribute_hits(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits (``path``, ``line`` and whatever else) with ``scope``, the id of the innermost definition whose lines hold them; null at the level of the module.

    Innermost is what starts last, then what ends first.

    :param spans: ``path``, ``id``, ``line_start``, ``line_end``
    """
    keys = hits.columns
    inside = hits.join(spans.select("path", "id", "line_start", "line_end"), "path", "left")
    held = F.when(F.col("line").between(F.col("line_start"), F.col("line_end")), F.struct("line_start", (-F.col("line_end")).alias("e"), "id"))
    return inside.groupBy(*keys).agg(F.max(held).alias("x")).select(*keys, F.col("x.id").alias("scope"))


def grep_rounds(words: DataFrame, spans: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Who may call a name, by text alone: the definitions around its hits, then those around hits of their names, and so on.

    A hit outside all definitions ends its branch, and a definition does not call itself by its own lines.

    :param words: ``path``, ``line``, ``word``; :param spans: see :func:`attribute_hits`; :param starts: ``start``, ``word``
    :returns: ``start``, ``id``, ``hop``: the first round each definition is found in
    """
    asked = starts.select("start", "word").distinct()
    found: list[DataFrame] = []
    levels = []
    for hop in range(1, hops + 1):
        hits = words.join(asked, "word").select("path", "line", "start", "word")
        around = attribute_hits(hits.distinct(), spans).where("scope is not null")
        own = last_segment(F.regexp_replace("scope", r"^.*::", "")) == F.col("word")
        near = unseen(around.where(~own).select("start", F.col("scope").alias("id")).distinct(), found, ["start", "id"])
        if not rows_of(near):
            break
        found.append(near)
        levels.append(near.withColumn("hop", F.lit(hop)))
        asked = cut(near.select("start", last_segment(F.regexp_replace("id", r"^.*::", "")).alias("word")).distinct())
    if not levels:
        return asked.select("start", F.col("word").alias("id"), F.lit(0).alias("hop")).where(F.lit(False))
    return reduce(DataFrame.unionByName, levels)


def search_box(rows: DataFrame, asked: str | Column, columns: tuple[str, ...] = ("id",), limit: int = 500) -> DataFrame:
    """Rows in one of whose columns the text asked for stands, without regard to case; the first by these columns, at most ``limit``."""
    wanted = F.lower(F.lit(asked) if isinstance(asked, str) else asked)
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), wanted) for c in columns])).orderBy(*columns).limit(limit)
