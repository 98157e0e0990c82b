"""Filling containers of a fixed capacity with items, harmonically.

Lengths fall into reciprocal classes: class j holds the lengths in
(C / (j + 1), C / j], and a container of class j takes exactly j of them, so
workers need no word from each other. Each worker packs its own hash share of the
items, longest class first.

By the count alone (``fill_up=False``) containers need no search either, but a class's
containers stay empty by up to C / (j + 1) each. To leave little room unused,
the room that the fixed count leaves is then given to the longest waiting item of any
lower class that fits, found by one look at a bit set of the waiting lengths; items up to
C / CLASSES, the last class, fill what room they find and then containers of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths up to C / CLASSES are short.
CLASSES = 12

#: Items that one worker packs.
ITEMS_PER_WORKER = 50_000

#: Copies of an item that are numbered in one row.
COPIES_PER_ROW = 10_000


def pieces(items: DataFrame, item: str, length: str, capacity: int) -> DataFrame:
    """``item``, ``copy``, ``piece``, ``start``, ``length``: items of positive length, the ones longer than ``capacity`` cut into pieces of it and a rest.

    Null lengths and lengths of 0 or less take no room and are left out. ``copy`` numbers equal items, which
    spreads an item that occurs very often.
    """
    counted = items.where(F.col(length) > 0).groupBy(F.col(item).alias("item"), F.col(length).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    # An item with very many copies is first split in rows of some of them, and these are spread over the workers.
    step = F.lit(COPIES_PER_ROW).cast("long")
    runs = counted.select("item", "n", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), step)).alias("first"))
    if counted.where(F.col("copies") > COPIES_PER_ROW).limit(1).count():
        runs = runs.repartition(F.col("item"), F.col("first"))
    copies = runs.select("item", "n", F.explode(F.sequence(F.col("first"), F.least(F.col("copies"), F.col("first") + COPIES_PER_ROW - 1))).alias("copy"))
    starts = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long")))
    cutted = copies.select("item", "copy", "n", starts.alias("piece", "start"))
    return cutted.select("item", "copy", "piece", "start", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start")).alias("length"))


def _pack_counts(lengths: np.ndarray, capacity: int, classes: int) -> np.ndarray:
    """Container number of each item (longest first) by the fixed counts alone; the last class is filled one after another."""
    kind = np.minimum(capacity // lengths, classes)
    out = np.empty(len(lengths), dtype=np.int64)
    number = 0
    for j in range(1, classes):
        own = np.flatnonzero(kind == j)
        out[own] = number + np.arange(len(own)) // j
        number += -(-len(own) // j)
    room = 0
    number -= 1
    for i in np.flatnonzero(kind == classes):
        if lengths[i] > room:
            number, room = number + 1, capacity
        out[i] = number
        room -= lengths[i]
    return out


def _pack(lengths: np.ndarray, capacity: int, classes: int) -> np.ndarray:
    """Container number of each item, the room that the counts leave filled up; every length is between 1 and ``capacity``.

    ``waiting`` has the items by length, ``open_`` a bit per length that is waiting: the longest
    length that still fits is the highest bit of its lower part.
    """
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        waiting.setdefault(n, []).append(i)
    open_ = 0
    for n in waiting:
        open_ |= 1 << n
    out = np.empty(len(lengths), dtype=np.int64)
    number = -1
    for j in range(1, classes + 1):
        shortest = capacity // (j + 1) + 1 if j < classes else 1
        while (top := open_.bit_length() - 1) >= shortest:
            number += 1
            room, taken = capacity, 0
            while True:
                # First the class's own items, as many as its number says, then whatever fits longest.
                n = top if taken < j and top >= shortest else (open_ & ((2 << room) - 1)).bit_length() - 1
                if n < 1 or n > room:
                    break
                same = waiting[n]
                out[same.pop()] = number
                if not same:
                    open_ ^= 1 << n
                    top = open_.bit_length() - 1
                room -= n
                taken += 1
    return out


def harmonic_containers(items: DataFrame, item: str, length: str, capacity: int, classes: int = CLASSES, per_worker: int = ITEMS_PER_WORKER, fill_up: bool = True) -> DataFrame:
    """One row per piece in its container: ``container_id``, ``item``, ``piece``, ``start``, ``length``.

    Every item of positive length is in exactly one container, or, if longer than
    ``capacity``, in several, cut at multiples of it; no container holds more than
    ``capacity``. The outcome depends only on the items: a worker's share is
    chosen by hash and sorted. ``fill_up=False`` packs by the fixed counts alone. Items that repeat are packed as often as they occur;
    an empty table gives no rows.
    """
    parts = pieces(items, item, length, capacity)
    workers = max(1, -(-items.count() // per_worker))
    kinds = dict(parts.dtypes)
    schema = f"container_id string, item {kinds['item']}, piece int, start bigint, length bigint"

    def pack(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["length", "item", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
        numbers = (_pack if fill_up else _pack_counts)(share["length"].to_numpy(np.int64), capacity, classes)
        prefix = f"{int(share['share'].iloc[0])}-"
        return pd.DataFrame({"container_id": [prefix + str(x) for x in numbers], "item": share["item"], "piece": share["piece"], "start": share["start"], "length": share["length"]})

    shared = parts.withColumn("share", F.pmod(F.xxhash64("item", "piece", "copy"), F.lit(workers)).cast("int"))
    return shared.groupBy("share").applyInPandas(pack, schema)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row per container: ``container_id``, ``n_items``, ``used``, ``fill``, ``items``."""
    return packed.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("length").alias("used"),
        F.round(F.sum("length") / capacity, 6).alias("fill"),
        F.array_sort(F.collect_list(F.struct("item", "piece", "start", "length"))).alias("items"),
    )
