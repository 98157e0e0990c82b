"""Mixing sources to target shares of the total size.

A document's place in its source is the hash of its id. For each source the
wanted size is some whole passes over it plus a rest, and the rest is the
documents below a threshold of the hash. Thresholds come from histograms of
size by hash bucket: the bucket where the running sum passes the budget is
refined until it holds one hash, the others are settled; then a filter takes
the documents, without a sort. A smaller budget has a smaller threshold, so its
documents are a subset: the mix can grow without being drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.workspace import broadcast_if_small, cut, drop

#: Buckets per round: 2 to this power; a round settles as many bits of the hash.
BITS_PER_ROUND = 10

#: Bits of the hash; ids that agree in all of them go in or stay out together.
HASH_BITS = 60


def plain_source(name: Column) -> Column:
    """One spelling per source: lower case, no blanks around, ``-`` and inner blanks as ``_``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def _place(item: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(item, F.lit("mix")), 64 - HASH_BITS)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source``, ``below``: documents with ``place`` under it have a total size of at most ``budget``, as much as fits.

    :param sized: ``source``, ``place``, ``size``
    :param budgets: ``source``, ``budget``; one row per source
    """
    shift = HASH_BITS - BITS_PER_ROUND
    settled = cut(budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("taken")))
    first = True
    while True:
        state = broadcast_if_small(settled)
        bucket = F.shiftright("place", shift)
        if not first:  # what is left are the boundary buckets
            inside = F.shiftright("place", shift + BITS_PER_ROUND) == F.col("prefix")
            left = cut(sized.join(state.select("source", "prefix"), "source").where(inside).select("source", "place", "size"))
            if shift < HASH_BITS - 2 * BITS_PER_ROUND:
                drop(sized)  # those of the round before
            sized = left
        histogram = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        cumulated = histogram.join(state, "source").withColumn("upto", F.col("taken") + running)
        # The boundary: the first bucket that does not fit whole.
        boundary = cumulated.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("size"), "bucket").alias("taken"))
        # A source without one is taken whole: its threshold lies past the end of its prefix.
        past = F.shiftleft(F.col("prefix") + 1, BITS_PER_ROUND) if not first else F.lit(1 << BITS_PER_ROUND).cast("long")
        settled = cut(
            settled.withColumnRenamed("taken", "was").join(broadcast_if_small(cut(boundary)), "source", "left").select("source", "budget", F.coalesce("bucket", past).alias("prefix"), F.coalesce("taken", "was").cast("double").alias("taken"))
        )
        first = False
        if shift == 0:
            return settled.select("source", F.col("prefix").alias("below"))
        shift = max(0, shift - BITS_PER_ROUND)


def mix(items: DataFrame, item: str, source: str, size: str, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    :param items: one row per document; a document whose id repeats counts once, with its greatest size
    :param targets: ``source``, ``target_share``, ``max_repeats``; rows with a null or no positive share or
        without repeats are ignored, of several rows of a source the greatest values count
    :param total: wanted size; by default, and at most, the largest that no source holds back

    Sources are compared in one spelling (:func:`plain_source`). Shares are scaled to a sum of 1 over
    the targets that have documents with a size above 0; a target without any is reported with an
    actual share of 0. Documents of sources that are no target are left out.

    :returns: documents (``item``, ``source``, ``size``, ``copies``, at most ``max_repeats``) and, per target,
        ``source``, ``target_share``, ``wanted_share``, ``actual_share``, ``size``, ``n_documents``, ``most_copies``
    """
    sized = items.where((F.col(size) > 0) & F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(F.struct(plain_source(F.col(source)).alias("s"), F.col(size).cast("long").alias("n"))).alias("x"))
    sized = cut(sized.select("item", F.col("x.s").alias("source"), F.col("x.n").alias("size"), _place(F.col("item")).alias("place")).where(F.col("source").isNotNull()))
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1)).groupBy(plain_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = cut(wanted.where("source is not null"))
    small = broadcast_if_small(wanted)
    held = cut(sized.join(small, "source").groupBy("source").agg(F.sum("size").alias("held"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    shares, largest = held.agg(F.sum("target_share"), F.min(F.col("held") * F.col("max_repeats") / F.col("target_share"))).first()
    reach = 0.0 if shares is None else largest * shares
    reach = reach if total is None else min(reach, float(total))
    plan = held.withColumn("wanted_share", F.col("target_share") / F.lit(float(shares or 1)))
    plan = plan.withColumn("goal", F.least(F.col("wanted_share") * F.lit(reach), F.col("held") * F.col("max_repeats")))
    # The small term undoes rounding where a source is used up exactly.
    plan = cut(plan.withColumn("passes", F.floor(F.col("goal") / F.col("held") + 1e-9).cast("int")).withColumn("budget", F.greatest(F.lit(0.0), F.col("goal") - F.col("passes") * F.col("held"))))
    below = cut(thresholds(sized.select("source", "place", "size"), plan.select("source", "budget")))
    rule = broadcast_if_small(cut(plan.join(below, "source").select("source", "passes", "below")))
    chosen = sized.join(rule, "source").withColumn("copies", F.col("passes") + (F.col("place") < F.col("below")).cast("int")).where("copies > 0").select("item", "source", "size", "copies")
    got = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("size")).first()[0] or 0
    report = wanted.join(plan.select("source", "wanted_share"), "source", "left").join(got, "source", "left")
    report = report.select(
        "source", "target_share", F.coalesce("wanted_share", F.lit(0.0)).alias("wanted_share"), F.coalesce(F.col("size") / F.lit(float(whole or 1)), F.lit(0.0)).alias("actual_share"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
    return chosen, report
