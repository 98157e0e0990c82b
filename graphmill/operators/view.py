"""Boxes for a picture of a tree: folders, files and symbols, sized by their lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.workspace import cut

# The extent of a picture, and the share of a box's shorter side that stays free around its children.
WIDTH, HEIGHT, MARGIN = 1_000_000.0, 562_500.0, 0.055


def boxes(leaves: DataFrame) -> DataFrame:
    """Folders and files above weighted paths: ``rev``, ``box``, ``parent``, ``name``, ``weight``, ``depth``.

    A folder that holds nothing but one other folder is drawn as one box with it, named by both.
    Weights below 1, and nulls, count as 1.
    """
    parts = F.split("path", "/")
    up = leaves.select("rev", "path", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).alias("weight"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    at = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    all_ = up.groupBy("rev", at(F.col("depth")).alias("box"), F.when(F.col("depth") > 0, at(F.col("depth") - 1)).alias("parent"), "depth").agg(F.sum("weight").alias("weight"), F.bool_or(F.col("depth") == F.size("parts")).alias("leaf"))
    all_ = cut(all_)
    children = all_.where("parent is not null").groupBy("rev", F.col("parent").alias("box")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("leaf").alias("any_leaf"))
    folded = all_.join(children, ["rev", "box"], "left").withColumn("folded", F.coalesce((F.col("n") == 1) & ~F.col("any_leaf") & (F.col("depth") > 0), F.lit(False)))
    # The nearest box above that is drawn: paths name their ancestors, so no walk is needed.
    drawn = folded.where("not folded")
    ancestors = drawn.where("depth > 0").select("rev", "box", "weight", "depth", "leaf", F.split("box", "/").alias("parts")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    above = ancestors.select("rev", "box", "d", F.array_join(F.slice("parts", 1, F.col("d")), "/").alias("above")).join(drawn.select("rev", F.col("box").alias("above")), ["rev", "above"])
    parent = above.groupBy("rev", "box").agg(F.max_by("above", "d").alias("parent"))
    joined = drawn.select("rev", "box", "weight", "depth", "leaf").join(parent, ["rev", "box"], "left")
    name = F.when(F.col("parent").isNull(), F.lit("")).when(F.col("parent") == "", F.col("box")).otherwise(F.substr("box", F.length("parent") + 2))
    return joined.select("rev", "box", "parent", name.alias("name"), "weight", "depth", "leaf")


def _strip_layout(weights: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Squarified strips: weights, in falling order, fill a rectangle; a strip grows while its worst side ratio improves."""
    total = sum(weights)
    scale = w * h / total if total else 0
    areas = [a * scale for a in weights]
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(areas):
        side = min(w, h)
        row, best = 0.0, float("inf")
        j = i
        while j < len(areas):
            grown = row + areas[j]
            if side <= 0 or grown <= 0:
                j = len(areas)
                break
            thick = grown / side
            worst = max(max(thick / (a / thick), (a / thick) / thick) for a in (areas[i], areas[j]) if a > 0)
            if worst > best:
                break
            row, best, j = grown, worst, j + 1
        row = sum(areas[i:j])
        thick = row / side if side > 0 else 0.0
        along = 0.0
        for a in areas[i:j]:
            length = a / thick if thick else 0.0
            out.append((x + along, y, length, thick) if w <= h else (x, y + along, thick, length))
            along += length
        if w <= h:
            y, h = y + thick, h - thick
        else:
            x, w = x + thick, w - thick
        i = j
    return out


def treemap(drawn: DataFrame) -> DataFrame:
    """A rectangle inside its parent's for every box: ``rev``, ``box``, ``x``, ``y``, ``w``, ``h``.

    Levels are laid out from the root down, all containers of a level at once; a container's own children are
    one sequential packing, as large as the folder.
    """
    schema = "rev string, box string, x double, y double, w double, h double"
    drawn = cut(drawn)
    level = cut(drawn.where("parent is null").select("rev", "box", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h")))
    out = level

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["weight", "box"], ascending=[False, True], kind="stable")
        x, y, w, h = (float(group[k].iloc[0]) for k in ("x", "y", "w", "h"))
        m = MARGIN * min(w, h)
        rects = _strip_layout(group["weight"].astype(float).tolist(), x + m, y + m, w - 2 * m, h - 2 * m)
        return pd.DataFrame([(r, b, *box) for r, b, box in zip(group["rev"], group["box"], rects)], columns=["rev", "box", "x", "y", "w", "h"])

    while True:
        children = drawn.join(level.withColumnRenamed("box", "parent"), ["rev", "parent"]).select("rev", "box", "parent", "weight", "x", "y", "w", "h")
        level = cut(children.groupBy("rev", "parent").applyInPandas(place, schema))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def bundles(edges: DataFrame, visible: DataFrame, quota: int = 120) -> DataFrame:
    """Links between what is visible: each end counts for its nearest visible box, and of each (kind, tier) the ``quota`` heaviest bundles are drawn.

    :param edges: ``rev``, ``src``, ``dst``, ``kind``, ``rank``
    :param visible: ``rev``, ``id``, ``shown``
    :returns: ``rev``, ``a``, ``b``, ``kind``, ``rank``, ``n``, ``drawn``; what is not drawn is listed with ``drawn`` false
    """
    from pyspark.sql import Window

    ends = edges.join(visible.withColumnsRenamed({"id": "src", "shown": "a"}), ["rev", "src"]).join(visible.withColumnsRenamed({"id": "dst", "shown": "b"}), ["rev", "dst"])
    summed = ends.where("a != b").groupBy("rev", "a", "b", "kind", "rank").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("rev", "kind", "rank").orderBy(F.col("n").desc(), "a", "b"))
    return summed.withColumn("drawn", place <= quota)
