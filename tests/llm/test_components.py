from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphmill.llm import components


def brute(links):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in links:
        if g is not None and a and b and a != b:
            parent[find((g, a))] = find((g, b))
    groups = defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    return sorted((g, n, min(m for _, m in members)) for members in groups.values() for g, n in members)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_places_are_undone(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, -1, 2**63 - 1, -(2**63), 123456789)], "v bigint")
    for turn in range(6):
        assert df.where(components.at_place(components.place(F.col("v"), turn), turn) != F.col("v")).count() == 0
        assert df.select(components.place(F.col("v"), turn)).distinct().count() == 6


def random_links(seed):
    draw = random.Random(seed)
    groups = [f"r{i}" for i in range(4)]
    steady = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(25)]
    links = [(g, a, b) for g in groups for a, b in steady]
    for g in groups:
        links += [(g, f"n{draw.randrange(80)}", f"n{draw.randrange(80)}") for _ in range(12)]
    links += [("r0", "hub", f"leaf{i}") for i in range(150)]  # a star
    links += [("r1", f"p{i}", f"p{i + 1}") for i in range(40)]  # a path
    links += [("r2", "self", "self"), ("r2", None, "x"), ("r2", "x", None), ("r2", "", "x"), (None, "a", "b")]
    return links + links[:30]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find(spark, seed):
    links = random_links(seed)
    df = spark.createDataFrame([(*x, 5) for x in links], "rev string, src string, dst string, k int")
    assert rows(components.linked_groups(df, "rev", "src", "dst")) == brute(links)


def test_equal_hashes_of_different_nodes_do_no_harm(spark):
    links = random_links(3)
    df = spark.createDataFrame(links, "rev string, src string, dst string")
    got = components.linked_groups(df, "rev", "src", "dst", node_id=F.pmod(F.xxhash64("node"), F.lit(7)))
    assert rows(got) == brute(links)


def test_many_snapshots_take_several_masks(spark):
    links = [(f"s{i:03}", "a", "b" if i % 2 else "c") for i in range(130)]
    df = spark.createDataFrame(links, "rev string, src string, dst string")
    assert rows(components.linked_groups(df, "rev", "src", "dst")) == brute(links)


def test_consecutive_numbers_are_scattered(spark):
    firsts = set()
    for turn in range(4):
        order = [r.v for r in spark.range(64).select(F.col("id").alias("v")).orderBy(components.place(F.col("v"), turn)).collect()]
        steps = sum(abs(a - b) == 1 for a, b in zip(order, order[1:]))
        firsts.add(order[0])
        assert steps < 12, order
    assert len(firsts) > 1


def test_maps_need_no_broadcast(spark):
    links = random_links(4)
    df = spark.createDataFrame(links, "rev string, src string, dst string")
    assert rows(components.linked_groups(df, "rev", "src", "dst", few=0)) == brute(links)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 3)], "a bigint, b bigint")
    roots = {r.v: r.root for r in components.contract(edges, few=0).collect()}
    assert len(roots) == 33 and len(set(roots.values())) == 2 and roots[0] == roots[30] != roots[100] == roots[101]


def test_no_links(spark):
    assert components.linked_groups(spark.createDataFrame([], "rev string, src string, dst string"), "rev", "src", "dst").count() == 0
