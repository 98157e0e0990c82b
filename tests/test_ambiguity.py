from __future__ import annotations

import random

import pytest

from graphmill.operators import graph, resolve
from graphmill.workspace import cut

EDGE = "rev string, src string, dst string, kind string, confidence string, provenance string, callsite_path string, callsite_line int"


def drawn(spark, seed):
    draw = random.Random(seed)
    nodes = [f"p{i % 3}.py::n{i}" for i in range(14)]
    links = [("r", draw.choice(nodes), draw.choice(nodes), "CALLS", draw.choice(["LOW", "MEDIUM", "HIGH"]), draw.choice(["static", "runtime"]), "p", 1) for _ in range(16)]
    names = [("r", n, h) for n in nodes for h in draw.sample(["get", "put", "run", "__init__"], draw.choice([0, 1, 1, 2]))]
    refs = sorted({("r", draw.choice(nodes), draw.choice(["get", "put", "run", "__init__"])) for _ in range(9)})
    made = graph.Ambiguity(cut(spark.createDataFrame(names, "rev string, id string, hub string")), cut(spark.createDataFrame(refs, "rev string, src string, hub string")))
    best = {}
    for _, a, b, _, tier, run, *_ in links:
        rank, seen = best.get((a, b), (0, False))
        best[a, b] = max(rank, ["LOW", "MEDIUM", "HIGH"].index(tier)), seen or run == "runtime"
    for _, a, h in refs:
        for _, b, k in names:
            if h == k:
                best.setdefault((a, b), (0, False))
    return nodes, spark.createDataFrame(links, EDGE), made, best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_factorised_names_equal_their_pairs(spark, seed):
    nodes, edges, made, best = drawn(spark, seed)
    assert {r.id: r.fan_in for r in graph.fan_in(edges, made).collect()} == {b: n for b in nodes if (n := sum(y == b for _, y in best))}

    start = nodes[seed]
    level, want, seen = {start: (2, True)}, {}, {start}
    for hop in (1, 2, 3):
        offers = {}
        for (a, b), (rank, ran) in best.items():
            if b in level and a not in seen:
                offers[a] = max(offers.get(a, (-1, False)), (min(rank, level[b][0]), ran and level[b][1]))
        want |= {a: (hop, *q) for a, q in offers.items()}
        seen |= offers.keys()
        level = offers
    reached, truncated = graph.reach_back(edges, spark.createDataFrame([("r", start)], "rev string, start string"), 3, made)
    assert {r.id: (r.hop, r["rank"], r.observed) for r in reached.collect()} == want
    assert truncated.first().truncated == any(b in level and a not in seen for a, b in best)

    ends = [("r", start, n) for n in nodes]
    frame = spark.createDataFrame(ends, "rev string, start string, goal string")
    level, ways, seen = {start: (0, [start])}, {start: (0, 2, [start])}, {start}
    for hop in range(1, len(nodes)):
        offers = {}
        for (a, b), (rank, _) in best.items():
            if a in level and b not in seen:
                offer = (max(-rank, -2 if hop == 1 else level[a][0]), [*level[a][1], b])
                offers[b] = min(offers.get(b, offer), offer)
        ways |= {b: (hop, -w, p) for b, (w, p) in offers.items()}
        seen |= offers.keys()
        level = offers
    assert {r.goal: (r.hops, r["rank"], r.nodes) for r in graph.shortest_paths(edges, frame, len(nodes), made).collect()} == ways
    assert {r.goal: r.hops for r in graph.distances(edges, frame, made).collect()} == {n: h for n, (h, _, _) in ways.items()}


def test_constructors_are_meant_by_their_class(spark):
    rows = [("r", "p.py::A", "p.py", "A", "class", "live"), ("r", "p.py::A.__init__", "p.py", "A.__init__", "method", "live"), ("r", "q.py::A.__init__", "q.py", "A.__init__", "method", "live"), ("r", "p.py::f#1", "p.py", "f", "function", "shadowed"), ("r", "p.py::<module>", "p.py", "<module>", "module", "live")]
    got = resolve.reaching_names(spark.createDataFrame(rows, "rev string, id string, path string, qualname string, kind string, name_binding string"))
    assert sorted((r.id, r.hub) for r in got.collect()) == [("p.py::A", "A"), ("p.py::A.__init__", "A"), ("p.py::A.__init__", "__init__"), ("q.py::A.__init__", "__init__")]


def test_lookups_beyond_the_broadcast_bound(spark, monkeypatch):
    from graphmill import workspace

    seen = [cut(spark.range(0, 50).toDF("v")), cut(spark.range(50, 60).toDF("v"))]
    for bound in (0, 5, 30, 100):
        monkeypatch.setattr(workspace, "BROADCAST_ROWS", bound)
        assert sorted(r.v for r in workspace.unseen(spark.range(40, 70).toDF("v"), seen, ["v"]).collect()) == list(range(60, 70))
    assert workspace.unseen(spark.range(3).toDF("v"), [], ["v"]).count() == 3
