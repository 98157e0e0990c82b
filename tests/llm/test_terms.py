from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from graphmill.llm import terms


def test_counts_equal_brute_force(spark):
    draw = random.Random(1)
    data = [("f", draw.choice(["s1", "s2", "s3", None]), draw.choice(["hot", "hot", "hot", "b", "", None]), draw.randrange(40)) for _ in range(500)]
    df = spark.createDataFrame([(*x, "extra") for x in data + data[:50]], "field string, rec string, term string, ordinal int, n string")
    seen = defaultdict(set)
    for f, r, t, o in data:
        if r is not None and t is not None:
            seen[f, t].add((r, o))
    want = sorted((f, t, len(x), len({r for r, _ in x})) for (f, t), x in seen.items())
    got = terms.term_frequencies(df, ["field"], "rec", "term", ["ordinal"])
    assert sorted(map(tuple, got.collect())) == want
    assert terms.term_frequencies(df.limit(0), ["field"], "rec", "term", ["ordinal"]).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (49,), (50,)], "n int")
    assert [r[0] for r in df.orderBy("n").select(terms.frequency_mark(F.col("n"), 1000)).collect()] == ["rare", "rare", None, None, "common"]
