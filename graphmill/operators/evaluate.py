"""Judging links against what was observed, and tools against each other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_misses(misses: DataFrame, ladder: Sequence[tuple[str, Column]]) -> DataFrame:
    """``misses`` with ``why``: the first reason of the ladder that holds, else ``other``."""
    why = F.lit("other")
    for name, holds in reversed(list(ladder)):
        why = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(why)
    return misses.withColumn("why", why)


def tool_report(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Per ``tool``: questions, recall over all items, mean and quartiles of recall per question, perfect questions, yield.

    :param answers: ``tool``, ``question``, ``item``; :param truth: ``question``, ``item``. Repeats count once. A question without true items has recall 1;
        a tool that returns nothing has a yield of 0.
    """
    true = truth.select("question", "item").distinct().withColumn("true", F.lit(1))
    given = answers.select("tool", "question", "item").distinct()
    per_question = truth.select("question").union(answers.select("question")).distinct().join(true.groupBy("question").agg(F.count(F.lit(1)).alias("true")), "question", "left").na.fill(0)
    whole = per_question.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("true"), F.lit(0)).alias("items"), F.count_if(F.col("true") == 0).alias("empty")).first()
    # Only what a tool answers is a row; its other questions are known by their number: recall 1 where nothing was to be found, else 0.
    answered = given.join(true, ["question", "item"], "left").groupBy("tool", "question").agg(F.count(F.lit(1)).alias("given"), F.count("true").alias("hit")).join(per_question, "question")
    recall = F.when(F.col("true") == 0, 1.0).otherwise(F.col("hit") / F.col("true"))
    rows = answered.select("tool", "given", "hit", "true", recall.alias("recall"))
    sums = rows.groupBy("tool").agg(F.sum("given").alias("given"), F.sum("hit").alias("hit"), F.sum("recall").alias("sum"), F.count_if(F.col("recall") == 1.0).alias("perfect"), F.count_if(F.col("true") == 0).alias("of_empty"), F.count_if(F.col("true") > 0).alias("of_full"))
    rest = sums.select("tool", F.explode(F.array(F.struct(F.lit(1.0).alias("recall"), (F.lit(whole.empty) - F.col("of_empty")).alias("n")), F.struct(F.lit(0.0).alias("recall"), (F.lit(whole.questions - whole.empty) - F.col("of_full")).alias("n")))).alias("x")).select("tool", "x.*").where("n > 0")
    spread = rows.select("tool", "recall", F.lit(1).cast("long").alias("n")).unionByName(rest).groupBy("tool").agg(F.percentile("recall", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("quartiles"))
    silent = F.lit(whole.empty) - F.col("of_empty")
    return sums.join(spread, "tool").select(
        "tool",
        F.lit(whole.questions).cast("long").alias("questions"),
        F.lit(1.0).alias("recall") if not whole["items"] else (F.col("hit") / F.lit(whole["items"])).alias("recall"),
        ((F.col("sum") + silent) / F.lit(whole.questions)).alias("mean_recall"),
        "quartiles",
        (F.col("perfect") + silent).alias("perfect"),
        (F.col("hit") / F.col("given")).alias("yield"),
    )


def paired_bootstrap(pairs: DataFrame, resamples: int = 20_000, seed: int = 17, level: float = 0.95) -> DataFrame:
    """Mean difference of paired measurements with a percentile interval.

    :param pairs: ``name``, ``a``, ``b``; rows with a null measurement are left out
    :returns: ``name``, ``n``, ``difference`` (b - a), ``low``, ``high``

    A resample draws each pair a Poisson(1) number of times, the distributed form of drawing n with
    replacement. Equal pairs are first counted, and n of them draw a Poisson(n) number together, so the work depends on
    the number of different pairs; draws depend on values and seed, not on how rows are spread. A task adds its pairs up to
    two sums per resample and name, and only these meet.
    """
    known = pairs.where("a is not null and b is not null").select("name", (F.col("b") - F.col("a")).alias("d"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    counted = known.groupBy("name", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    kind = dict(known.dtypes)["name"]
    edge = (1 - level) / 2

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for name, a, b, n in batch[["name", "a", "b", "n"]].itertuples(index=False):
                mark = hashlib.blake2b(repr((seed, name, a, b)).encode(), digest_size=8).digest()
                times = np.random.default_rng(int.from_bytes(mark, "big")).poisson(n, resamples)
                sums = held.setdefault(name, np.zeros((2, resamples)))
                sums += (times * (b - a), times)
        yield pd.DataFrame([(k, v[0], v[1]) for k, v in held.items()], columns=["name", "upper", "lower"])

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        upper, lower = (np.sum(np.stack(group[c].to_numpy()), 0) for c in ("upper", "lower"))
        low, high = np.quantile(upper[lower > 0] / lower[lower > 0], [edge, 1 - edge]) if (lower > 0).any() else (None, None)
        return pd.DataFrame([(group["name"].iloc[0], low, high)], columns=["name", "low", "high"])

    drawn = counted.mapInPandas(draw, f"name {kind}, upper array<double>, lower array<double>")
    ends = drawn.groupBy("name").applyInPandas(interval, f"name {kind}, low double, high double")
    whole = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("difference"))
    return whole.join(ends, "name").select("name", "n", "difference", "low", "high")
