"""Ancestors of classes, and what methods mean along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.names import last_segment
from graphmill.workspace import broadcast_if_small, cut, rows_of


def ancestors(inherits: DataFrame) -> DataFrame:
    """Breadth-first order of every class's ancestors, the class itself first; cycles end where they close.

    :param inherits: ``rev``, ``sub``, ``base``, ``ord`` (place among the bases)
    :returns: ``rev``, ``cls``, ``anc``, ``depth``, ``way`` (places of the bases on the first way to it);
        compare ``depth``, then ``way``
    """
    up = cut(inherits.where("sub != base").groupBy("rev", "sub", "base").agg(F.min("ord").cast("int").alias("ord")))
    classes = up.select("rev", F.col("sub").alias("cls")).union(up.select("rev", "base")).distinct()
    level = cut(classes.select("rev", "cls", F.col("cls").alias("anc"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("way")))
    found = level
    depth = 0
    while rows_of(level):
        depth += 1
        step = broadcast_if_small(level).join(up.select("rev", F.col("sub").alias("anc"), "base", "ord"), ["rev", "anc"])
        next_ = step.groupBy("rev", "cls", F.col("base").alias("anc")).agg(F.min(F.concat("way", F.array("ord"))).alias("way"))
        level = cut(next_.join(found.select("rev", "cls", "anc"), ["rev", "cls", "anc"], "left_anti").select("rev", "cls", "anc", F.lit(depth).alias("depth"), "way"))
        found = cut(found.unionByName(level)) if rows_of(level) else found
    return found


def methods_of(symbols: DataFrame) -> DataFrame:
    """``rev``, ``cls``, ``m``, ``id`` of live methods."""
    live = symbols.where("kind = 'method' and name_binding = 'live'")
    return live.select("rev", F.regexp_replace("id", r"\.[^.]+$", "").alias("cls"), last_segment(F.col("qualname")).alias("m"), "id").distinct()


def nearest_methods(order: DataFrame, methods: DataFrame, own: bool = True) -> DataFrame:
    """The definition each method name means on each class: ``rev``, ``cls``, ``m``, ``id``, ``depth``; without the class itself if not ``own``."""
    visible = order.where("true" if own else "depth > 0").join(methods.withColumnRenamed("cls", "anc"), ["rev", "anc"])
    return visible.groupBy("rev", "cls", "m").agg(F.min(F.struct("depth", "way", "id")).alias("x")).select("rev", "cls", "m", "x.id", "x.depth")


def overriding_methods(order: DataFrame, methods: DataFrame) -> DataFrame:
    """Definitions of each class's methods further down: ``rev``, ``cls``, ``m``, ``id``."""
    below = order.where("depth > 0").select("rev", F.col("anc").alias("cls"), F.col("cls").alias("sub"))
    return below.join(methods.withColumnRenamed("cls", "sub"), ["rev", "sub"]).select("rev", "cls", "m", "id").distinct()
