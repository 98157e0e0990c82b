"""Streams: changed files kept current, observed calls against the tree, and windows over events.

The batch engine is the reference: after a stream has caught up, its tables
hold what the batch operators would compute from all input at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from graphmill.functions.text import plain_path, plain_sha


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and values by type and window of event time; rows later than ``late`` are dropped with their window."""
    known = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = known.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "users", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: events no further apart than ``gap``."""
    known = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = known.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def observed_calls(calls: DataFrame, tree: DataFrame) -> DataFrame:
    """A stream of observed calls (``src``, ``dst``, ``path``, ``blob_sha`` of the caller's file when it ran) joined with the present tree; ``stale`` where the file differs or is gone."""
    now = tree.select(plain_path(F.col("path")).alias("path"), plain_sha(F.col("blob_sha")).alias("now"))
    return calls.join(now, "path", "left").withColumn("stale", ~plain_sha(F.col("blob_sha")).eqNullSafe(F.col("now"))).drop("now")


def newest(rows: DataFrame) -> DataFrame:
    """Latest state per path of file changes: ``path``, ``blob_sha``, ``at``; at the same time the greatest sha."""
    return rows.groupBy("path").agg(F.max(F.struct("at", F.coalesce("blob_sha", F.lit("")).alias("blob_sha"))).alias("x")).select("path", F.nullif("x.blob_sha", F.lit("")).alias("blob_sha"), "x.at")


def keep_current(changes: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Writer that keeps a tree current from a stream of file changes.

    Every batch merges with the version before it and becomes version ``batch + 1``: a batch that is run again after a failure
    overwrites its own version from the same input, so the outcome does not depend on failures. Gone paths stay as
    rows with a null sha, so that a late older change does not bring them back.
    """

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.select(plain_path(F.col("path")).alias("path"), plain_sha(F.col("blob_sha")).alias("blob_sha"), "at").where("path is not null")
        before = batch.sparkSession.read.parquet(f"{folder}/version={number}") if number else None
        merged = newest(fresh if before is None else before.select("path", "blob_sha", "at").unionByName(fresh))
        merged.write.mode("overwrite").parquet(f"{folder}/version={number + 1}")
        if on_batch:
            on_batch(merged, number)

    return changes.writeStream.foreachBatch(merge)
