"""Numbers and running sums along a total order, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.workspace import cut


def running_sums(df: DataFrame, group: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums per ``group`` along ``order`` (ascending; a total order within the group).

    The rows are split by ranges of (group, order), summed per range, and each
    range starts from the sum of those before it in its group: a group of any
    size is spread over the cluster, and only (range, group) totals are windowed.
    """
    parts = cut(df.withColumns({f"__{k}": v for k, v in values.items()}).repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy(group, "__part").agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in values])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in values])
    within = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"__{k}": F.sum(f"__{k}").over(within) for k in values}).join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return summed.select(*df.columns, *[(F.col(f"__{k}") + F.col(f"__s_{k}")).alias(k) for k in values])
