"""Session defaults, table access and lineage cuts.

A lineage cut is a Parquet table in the shared folder named by
``spark.checkpoint.dir``: it outlives a lost executor, keeps only the columns
asked for, and is compressed. The folder is read from the session; only a
local session without one gets a temporary folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast when it has at most this many rows, counted beforehand.
BROADCAST_ROWS = 100_000

_local_root: str | None = None


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` overrides anything."""
    builder = SparkSession.builder.appName("graphmill")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Unset, a local session gets a temporary folder; on a cluster an error is
    raised, since a folder of one machine would not be seen by the others.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="graphmill-")
    return _local_root


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: same rows, no lineage.

    The rows are counted on the way (:func:`rows_of`). The folder is deleted when
    the driver ends, or earlier with :func:`drop`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/graphmill/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", codec).parquet(path)
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphmill_path = path
    out._graphmill_rows = seen.get.get("n")  # missing if the plan was found to be empty before it ran
    return out


def rows_of(df: DataFrame) -> int:
    """Rows of a cut, as counted when it was written; anything else is counted now."""
    known = getattr(df, "_graphmill_rows", None)
    return df.count() if known is None else known


def drop(*tables: DataFrame | None) -> None:
    """Delete the folders of cuts that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_graphmill_path", None)
        if path:
            fs, where = _filesystem(df.sparkSession, path)
            fs.delete(where, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``limit`` rows.

    A cut knows its rows; another relation should be cheap, as counting runs it.
    Above the limit the join is left to shuffle, where adaptive execution
    splits skewed partitions.
    """
    known = getattr(df, "_graphmill_rows", None)
    rows = df.limit(limit + 1).count() if known is None else known
    return F.broadcast(df) if rows <= limit else df


def unseen(candidates: DataFrame, seen: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """A cut of the ``candidates`` whose keys are in none of the cuts ``seen``, which stay where they are as long as either side is small.

    Few seen rows are broadcast. Of many, those that few candidates meet are looked up by broadcasting the
    candidates; only where both are many are both shuffled.
    """
    keys = list(keys)
    if not seen:
        return cut(candidates)
    known = seen[0].select(*keys)
    for more in seen[1:]:
        known = known.unionByName(more.select(*keys))
    if sum(map(rows_of, seen)) <= BROADCAST_ROWS:
        return cut(candidates.join(F.broadcast(known), keys, "left_anti"))
    offered = cut(candidates)
    if rows_of(offered) <= BROADCAST_ROWS:
        known = F.broadcast(known.join(F.broadcast(offered.select(*keys)), keys, "left_semi"))
    fresh = cut(offered.join(known, keys, "left_anti"))
    drop(offered)
    return fresh


def null_safe_equal(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Join condition that also matches null keys with each other."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
