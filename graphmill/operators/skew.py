"""Per-key results when a few keys hold most rows.

Counts per key go through two partial aggregations, so that no task sees more
of a hot key than the groups of one map task. Order statistics per key come
from :func:`exact_quantiles`, a distributed exact selection: histograms of the
values are refined around the wanted ranks until each rank is down to one value.
A histogram is a set of (key, bucket, count) rows that merges by addition, so
hot keys are combined before every shuffle and their values never meet in one
place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.workspace import BROADCAST_ROWS, cut

#: Buckets per key and round: 2 to this power.
BITS_PER_ROUND = 12

#: Bits of the map of open buckets: 2 to this power, in words of 64.
MAP_BITS = 22


def per_key_counts(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Rows and distinct non-null members per key.

    Null keys form a group of their own. The first aggregation is by key *and*
    member, which spreads a hot key over the cluster; the second adds up one row
    per pair, combined map-side.
    """
    pairs = df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), F.count(member).alias("n_members"))


def nearest_ranks(probs: Sequence[float]) -> Callable[[Column], Column]:
    """Ranks of quantiles by the nearest-rank rule: the smallest value with at least that share of rows at or below it."""
    return lambda n: F.array_distinct(F.array(*[F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * n)) for p in probs]))


def spaced_ranks(one_in: int) -> Callable[[Column], Column]:
    """Every m-th rank, m = ceil(n / one_in): a value on at least m rows holds one of them."""
    return lambda n: F.sequence(F.ceil(n / one_in), n, F.ceil(n / one_in))


def exact_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column], bits: int | None = None) -> DataFrame:
    """The values at given ranks of each key's sorted values, exactly.

    :param df: one row per observation; rows with a null value are left out
    :param value: an integral column; ``bits`` is the width of its range, measured by one more pass where it
        isn't given (it sets the width of the first buckets; results do not depend on it)
    :param ranks: from a key's number of values to an array of 1-based ranks
    :returns: ``keys``, ``rank``, ``value``, ``n_equal`` (rows of the key with that value), ``n_values``.
        Null keys count as a key; an empty input gives no rows; equal values share their ranks.

    Each round reads the observations once, keeps those in buckets that still
    hold an open rank, and counts them by 2^12 narrower buckets. The list of
    open buckets is broadcast if it was counted to be small. Beyond that a bit map of their hashes is,
    whose size is fixed: it lets few other rows pass, and these go when the exact list is joined to
    the aggregated histogram, where no key is hot any more.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("__v"))
    if bits is None:
        low, high = data.agg(F.min("__v"), F.max("__v")).first()
        bits = max(abs(low or 0), abs(high or 0)).bit_length() + 1
    shift = max(0, bits - BITS_PER_ROUND)
    order = lambda *extra: Window.partitionBy(*keys, *extra).orderBy("__b")
    histogram = _histogram(data, keys, shift)
    whole = Window.partitionBy(*keys)
    counted = histogram.withColumn("__upto", F.sum("__n").over(order())).withColumn("n_values", F.sum("__n").over(whole))
    state = counted.withColumn("__r", ranks(F.col("n_values")))
    done: DataFrame | None = None
    while True:
        inside = F.filter("__r", lambda r: (r > F.col("__upto") - F.col("__n")) & (r <= F.col("__upto")))
        state = cut(state.withColumn("__r", inside).where(F.size("__r") > 0))
        solved = state.where("__min = __max").select(*keys, F.explode("__r").alias("rank"), F.col("__min").alias("value"), F.col("__n").alias("n_equal"), "n_values")
        done = solved if done is None else done.unionByName(solved)
        open_ = state.where("__min < __max").select(*keys, F.col("__b").alias("__p"), (F.col("__upto") - F.col("__n")).alias("__below"), "__r", "n_values")
        if shift == 0 or open_.isEmpty():
            return done
        finer = max(0, shift - BITS_PER_ROUND)
        few = open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        lookup = open_.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__kp"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        if few:
            kept = data.join(F.broadcast(lookup), same & (F.shiftright("__v", shift) == F.col("__kp")), "left_semi")
            histogram = _histogram(kept, keys, finer)
        else:
            histogram = _histogram(_maybe_open(data, open_, keys, shift), keys, finer)
        histogram = histogram.withColumn("__p", F.shiftright("__b", shift - finer))
        right = open_.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__kp"), "__below", "__r", "n_values")
        joined = histogram.join(F.broadcast(right) if few else right, same & (F.col("__p") == F.col("__kp")))
        state = joined.withColumn("__upto", F.col("__below") + F.sum("__n").over(order("__p"))).select(*keys, "__b", "__n", "__min", "__max", "__upto", "n_values", "__r")
        shift = finer


def _maybe_open(data: DataFrame, open_: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """The observations whose bucket's hash is marked in a bit map of the open ones: all of these, and few others. The map has 2^16 words at most."""
    place = lambda bucket: F.pmod(F.xxhash64(*keys, bucket), F.lit(1 << MAP_BITS))
    marked = open_.select(place(F.col("__p")).alias("__at"))
    bits = marked.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 as int))")).alias("__bits"))
    rows = data.withColumn("__at", place(F.shiftright("__v", shift))).withColumn("__word", F.shiftright("__at", 6))
    return rows.join(F.broadcast(bits), "__word").where(F.expr("(__bits & shiftleft(1L, cast(__at & 63 as int))) != 0")).select(*keys, "__v")


def _histogram(data: DataFrame, keys: list[str], shift: int) -> DataFrame:
    bucket = F.shiftright("__v", shift) if shift else F.col("__v")
    return data.groupBy(*keys, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bits: int | None = None) -> DataFrame:
    """Exact quantiles (nearest rank) per key: ``keys``, ``prob``, ``value``, ``n_values``."""
    keys = list(keys)
    found = exact_ranks(df, keys, value, nearest_ranks(probs), bits)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    ranked = found.withColumn("prob", wanted)
    return ranked.where(F.col("rank") == F.greatest(F.lit(1).cast("long"), F.ceil(F.col("prob") * F.col("n_values")))).select(*keys, "prob", "value", "n_values")


def frequent_keys(df: DataFrame, field: str, key: str, one_in: int = 100) -> DataFrame:
    """Keys on at least one in ``one_in`` of the rows of their field, exactly.

    In the sorted hashes of a field's n keys, equal keys are neighbours, and a
    run of at least n / one_in rows cannot avoid all ranks that are multiples of
    ceil(n / one_in). Those at most ``one_in`` order statistics per field come
    from :func:`exact_ranks`; the keys behind the hashes found, a list of proven
    bounded size per field, are then counted by their exact spelling, so that a
    hash collision changes nothing.

    :returns: ``field``, ``key``, ``n_rows``, ``n_total``; rows with a null key are not counted
    """
    hashed = df.where(F.col(key).isNotNull()).select(F.col(field), F.col(key), F.xxhash64(key).alias("__h"))
    found = exact_ranks(hashed.select(field, "__h"), [field], "__h", spaced_ranks(one_in), bits=64)
    likely = cut(found.where(F.col("n_equal") * one_in >= F.col("n_values")).groupBy(field, "value").agg(F.max("n_values").alias("n_total")))
    few = likely.select(F.col(field).alias("__f"), F.col("value").alias("__c"), "n_total")
    few = F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few
    rows = hashed.join(few, F.col(field).eqNullSafe(F.col("__f")) & (F.col("__h") == F.col("__c")))
    counted = rows.groupBy(field, key).agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_total").alias("n_total"))
    return counted.where(F.col("n_rows") * one_in >= F.col("n_total"))
