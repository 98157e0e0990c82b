from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphmill.functions.text import normalized_names, plain_path
from graphmill.operators import skew


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_equal_sorting_with_a_hot_key(spark, seed):
    draw = random.Random(seed)
    data = [("hot", draw.choice([7, 7, 7, draw.randrange(-(10**12), 10**12)])) for _ in range(3000)]
    data += [(draw.choice(["a", "b", None]), draw.randrange(-5, 5)) for _ in range(300)] + [("one", 42), ("none", None)]
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = skew.exact_quantiles(spark.createDataFrame(data, "k string, v bigint"), ["k"], "v", probs)
    by = defaultdict(list)
    for k, v in data:
        if v is not None:
            by[k].append(v)
    want = [(k, p, sorted(v)[max(1, math.ceil(p * len(v))) - 1], len(v)) for k, v in by.items() for p in probs]
    assert rows(got) == sorted(want, key=repr)


def test_ranks_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    data = [(f"k{i % 5}", (i * 7919) % 100_003) for i in range(2000)]
    got = skew.exact_quantiles(spark.createDataFrame(data, "k string, v bigint"), ["k"], "v", [0.5])
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    assert rows(got) == sorted((k, 0.5, sorted(v)[math.ceil(0.5 * len(v)) - 1], len(v)) for k, v in by.items())


def test_frequent_keys_equal_counting(spark):
    draw = random.Random(5)
    data = [("f", "big")] * 400 + [("f", f"x{i}") for i in range(569)] + [("f", "edge")] * 10 + [("f", "below")] * 9 + [("f", None)] * 500
    data += [("g", draw.choice("abc")) for _ in range(50)] + [("f", ""), ("f", "big ")] * 6
    got = skew.frequent_keys(spark.createDataFrame(data, "field string, key string"), "field", "key", 100)
    n, c = Counter(f for f, k in data if k is not None), Counter((f, k) for f, k in data if k is not None)
    assert rows(got) == sorted([(f, k, x, n[f]) for (f, k), x in c.items() if x * 100 >= n[f]], key=repr)
    assert n["f"] == 1000


def test_per_key_counts_with_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", None, 3), (None, "y", 4), (None, "y", 4)], "k string, m string, n_rows int")
    assert rows(skew.per_key_counts(df, ["k"], "m")) == sorted([("a", 3, 1), (None, 2, 1)], key=repr)


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "field string, key string, v bigint")
    assert skew.frequent_keys(none, "field", "key").count() == 0
    assert skew.exact_quantiles(none, ["key"], "v", [0.5]).count() == 0
    assert skew.per_key_counts(none, ["key"], "field").count() == 0


def test_names_are_stripped_and_composed(spark):
    raw = [" len\t", "len", "café", "café", " größe ", None, "", "  ", "x" * 100_000]
    got = normalized_names(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw", "name")
    assert sorted(r.name for r in got.collect()) == sorted(unicodedata.normalize("NFC", x.strip()) for x in raw if x is not None)


@pytest.mark.parametrize(("path", "plain"), [("a/b.py", "a/b.py"), ("./a/b.py", "a/b.py"), (".\\a\\b.py", "a/b.py"), ("a//b.py", "a/b.py"), ("././a/./b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("", ""), (None, None), ("a.b/.c", "a.b/.c"), ("/a/", "a")])
def test_plain_paths(spark, path, plain):
    assert spark.createDataFrame([(path,)], "p string").select(plain_path(F.col("p"))).first()[0] == plain
