from __future__ import annotations

import random
from collections import defaultdict

import pytest

from graphmill.operators import graph, hierarchy

EDGE = "rev string, src string, dst string, kind string, confidence string, provenance string, callsite_path string, callsite_line int"
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


def random_edges(seed, n=14, m=40):
    draw = random.Random(seed)
    out = []
    for rev in ("r1", "r2"):
        for _ in range(m):
            out.append((rev, f"n{draw.randrange(n):02}", f"n{draw.randrange(n):02}", draw.choice(["CALLS", "CALLS", "REFERENCES"]), draw.choice([*RANK]), draw.choice(["static", "runtime"]), "p.py", draw.randrange(9)))
    return out + out[:5] + [("r1", "n00", None, "CALLS", "HIGH", "static", "p.py", 1), ("r1", "n00", "", "CALLS", "HIGH", "static", None, None), (None, "n00", "n01", "CALLS", "HIGH", "static", "p", 1), ("r1", "n00", "n01", "CALLS", None, None, None, None)]


def pairs(edges, kinds=None):
    out = {}
    for rev, s, d, k, c, p, *_ in edges:
        if rev and s and d and c and (kinds is None or k in kinds):
            rank, seen = out.get((rev, s, d), (-1, False))
            out[rev, s, d] = (max(rank, RANK[c]), seen)
    for rev, s, d, k, c, p, *_ in edges:
        if (rev, s, d) in out and p == "runtime" and (kinds is None or k in kinds):
            out[rev, s, d] = (out[rev, s, d][0], True)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_stays_at_the_shortest_hop(spark, seed):
    edges = random_edges(seed)
    starts = [("r1", "n00"), ("r1", "n03"), ("r2", "n05"), ("r2", "absent")]
    got, cut_off = graph.reach_back(spark.createDataFrame(edges, EDGE), spark.createDataFrame(starts, "rev string, start string"), 2)
    want, truncated = [], []
    back = defaultdict(list)
    for (rev, s, d), q in pairs(edges).items():
        back[rev, d].append((s, q))
    for rev, start in starts:
        level, seen = {start: (2, True)}, {start}
        for hop in (1, 2):
            new = {}
            for node, (rank, obs) in level.items():
                for s, (r, o) in back[rev, node]:
                    if s not in seen:
                        new[s] = max(new.get(s, (-1, False)), (min(rank, r), obs and o))
            seen |= new.keys()
            want += [(rev, start, s, hop, *q) for s, q in new.items()]
            level = new
        truncated.append((rev, start, any(s not in seen for node in level for s, _ in back[rev, node])))
    assert rows(got) == sorted(want, key=repr)
    assert rows(cut_off) == sorted(truncated, key=repr)


@pytest.mark.parametrize("seed", [4, 5])
def test_widest_effects_equal_relaxation(spark, seed):
    edges = random_edges(seed)
    draw = random.Random(seed)
    direct = [(rev, f"n{draw.randrange(14):02}", draw.choice(["NETWORK", "DB_READ"]), draw.randrange(3)) for rev in ("r1", "r2") for _ in range(4)]
    own = {}
    for rev, i, e, r in direct:
        own[rev, i, e] = max(own.get((rev, i, e), 0), r)
    wide, calls = dict(own), pairs(edges, {"CALLS"})
    for _ in range(40):
        for (rev, s, d), (r, _) in calls.items():
            for e in ("NETWORK", "DB_READ"):
                if (rev, d, e) in wide and s != d:
                    wide[rev, s, e] = max(wide.get((rev, s, e), -1), min(r, wide[rev, d, e]))
    want = sorted([(*k, own.get(k, r), k in own) for k, r in wide.items()], key=repr)
    assert rows(graph.widest_effects(spark.createDataFrame(edges, EDGE), spark.createDataFrame(direct, "rev string, id string, effect string, rank int"))) == want


def test_an_effect_is_as_weak_as_its_weakest_link_round_a_cycle(spark):
    edges = [("r", "a", "b", "CALLS", "LOW", "static", "p", 1), ("r", "b", "a", "CALLS", "HIGH", "static", "p", 1)]
    got = graph.widest_effects(spark.createDataFrame(edges, EDGE), spark.createDataFrame([("r", "b", "NETWORK", 2)], "rev string, id string, effect string, rank int"))
    assert rows(got) == [("r", "a", "NETWORK", 0, False), ("r", "b", "NETWORK", 2, True)]


@pytest.mark.parametrize("seed", [6, 7])
def test_paths_are_short_then_strong_then_first(spark, seed):
    edges = random_edges(seed)
    known = pairs(edges)
    ends = [(rev, "n00", f"n{i:02}") for rev in ("r1", "r2") for i in range(14)]
    got = rows(graph.shortest_paths(spark.createDataFrame(edges, EDGE), spark.createDataFrame(ends, "rev string, start string, goal string"), 3))
    want = []
    for rev, start, goal in ends:
        level = [(2, [start])]
        for hop in range(4):
            at = [(-r, p) for r, p in level if p[-1] == goal]
            if at:
                weak, path = min(at)
                want.append((rev, start, goal, hop, -weak, path))
                break
            level = [(min(r, q), [*p, d]) for r, p in level for (v, s, d), (q, _) in known.items() if v == rev and s == p[-1]]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [8, 9])
def test_islands_equal_union_find(spark, seed):
    edges = random_edges(seed, n=40, m=22) + [("r1", f"c{i:02}", f"c{i + 1:02}", "CALLS", "LOW", "static", "p", 1) for i in range(25)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rev, s, d, *_ in edges:
        if rev and s and d and s != d:
            a, b = sorted((find((rev, s)), find((rev, d))))
            parent[b] = a
    df = spark.createDataFrame(edges, EDGE)
    assert rows(graph.connected(df)) == sorted([(*x, find(x)[1]) for x in list(parent)], key=repr)
    assert graph.connected(df.limit(0)).count() == 0


def test_best_edges_and_fan_in(spark):
    edges = [("r", "a", "b", "REFERENCES", "HIGH", "static", "p.py", 2), ("r", "a", "b", "CALLS", "HIGH", "static", "p.py", 10), ("r", "a", "b", "CALLS", "HIGH", "runtime", "z.py", 1), ("r", "a", "b", "CALLS", "LOW", "runtime", "a.py", 1), ("r", "b", "b", "CALLS", "LOW", "static", None, None)]
    df = spark.createDataFrame(edges * 2, EDGE)
    assert rows(graph.best_edges(df)) == [("r", "a", "b", 2, "CALLS", True, "z.py:1"), ("r", "b", "b", 0, "CALLS", False, "")]
    assert rows(graph.fan_in(df)) == [("r", "b", 2)]


def test_ancestors_breadth_first_with_a_cycle(spark):
    up = [("r", "d", "b", 0), ("r", "d", "c", 1), ("r", "b", "a", 0), ("r", "c", "a", 0), ("r", "a", "d", 0), ("r", "d", "d", 2)]
    order = hierarchy.ancestors(spark.createDataFrame(up, "rev string, sub string, base string, ord int"))
    of = {c: [r.anc for r in sorted((r for r in order.collect() if r.cls == c), key=lambda r: (r.depth, r.way))] for c in "abcd"}
    assert of["d"] == ["d", "b", "c", "a"] and of["a"] == ["a", "d", "b", "c"]
    methods = spark.createDataFrame([("r", "a", "m", "a.m"), ("r", "c", "m", "c.m"), ("r", "b", "k", "b.k")], "rev string, cls string, m string, id string")
    assert {(r.cls, r.m): r.id for r in hierarchy.nearest_methods(order, methods).collect()}["d", "m"] == "c.m"
    assert {(r.cls, r.m): r.id for r in hierarchy.nearest_methods(order, methods, own=False).collect()}["c", "m"] == "a.m"


def test_budgets_are_total_orders(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("g", i % 2, i) for i in range(7)] + [("h", 0, 1)], "k string, s int, i int")
    got = rows(graph.budget(df, ["k"], [F.col("s").desc(), F.col("i")], 3))
    assert got == [("g", 1, 1, 1, True), ("g", 1, 3, 2, True), ("g", 1, 5, 3, True), ("h", 0, 1, 1, False)]
