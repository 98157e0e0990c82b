from __future__ import annotations

from collections import defaultdict

from graphmill.operators import graph
from graphmill.plans import symbol_graph

EDGE = "rev string, src string, dst string, kind string, confidence string, provenance string, callsite_path string, callsite_line int"


def link(src, dst, tier="HIGH"):
    return ("r", src, dst, "CALLS", tier, "static", "p.py", 1)


def fewest(links, start, goal):
    out = defaultdict(set)
    for _, s, d, *_ in links:
        out[s].add(d)
    level, seen, n = {start}, {start}, 0
    while level:
        if goal in level:
            return n
        level = {d for s in level for d in out[s]} - seen
        seen |= level
        n += 1
    return None


def test_distances_have_no_limit(spark):
    links = [link(f"n{i:02}", f"n{i + 1:02}") for i in range(13)] + [link("n13", "n05"), link("x", "y")]
    ends = [("r", a, b) for a in ("n00", "n07", "x", "n13") for b in ("n00", "n13", "n06", "y", "absent")]
    got = {tuple(r) for r in graph.distances(spark.createDataFrame(links, EDGE), spark.createDataFrame(ends, "rev string, start string, goal string")).select("rev", "start", "goal", "hops").collect()}
    assert got == {(*e, n) for e in ends if (n := fewest(links, *e[1:])) is not None} and ("r", "n00", "n13", 13) in got


def test_long_backward_and_weak_ways(spark, tmp_path, data_dir):
    links = [link(f"c{i:02}", f"c{i + 1:02}") for i in range(8)] + [link("c08", "hub")] + [link(f"k{i}", "hub") for i in range(30)]
    links += [link("low", "wide", "LOW"), link("low", "s", "LOW")] + [link("wide", f"t{i:02}") for i in range(12)]
    # What ends reach the start, but not the other way round.
    links += [link("t00", "b1"), link("b1", "b2"), link("b2", "b3")] + [link(f"u{i}", "b3") for i in range(9)]
    links += [link("a1", "a2"), link("a2", "a3"), link("a3", "wide")] + [link(f"v{i}", "a1") for i in range(8)]
    links += [link(f"w{i}", "z") for i in range(7)] + [link("s", "q")] + [link(f"x{i}", "q") for i in range(6)]
    edges = spark.createDataFrame(links, EDGE)
    edges.write.parquet(str(tmp_path / "edges.parquet"))
    for name in ("tree", "blob_nodes", "blob_refs", "blobs"):  # no ambiguous names
        spark.read.parquet(f"{data_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.start, r.goal): (r.reason, r.hops) for r in symbol_graph.path_negative(spark, str(tmp_path)).collect()}
    assert got["c00", "hub"] == ("hop_limit", 9)
    assert got["wide", "b3"] == ("hop_limit", 4)
    assert got["wide", "a1"] == ("hop_limit", 3)
    assert got["wide", "z"] == ("other_island", None)
    strong = [x for x in links if x[4] != "LOW"]
    for start, goal in [(r.start, r.goal) for r in symbol_graph._path_ends(edges, None).collect()]:
        near = min((n for n in (fewest(strong, start, goal), fewest(strong, goal, start)) if n is not None), default=None)
        assert ((start, goal) in got) == (near is None or near > 2)
    paths = {(r.start, r.goal): r.hops for r in symbol_graph.shortest_path(spark, str(tmp_path)).collect()}
    assert paths["a1", "wide"] == 3 and paths["wide", "b3"] == 4 and ("wide", "a1") not in paths


def test_walks_begin_at_the_starts_alone(spark, tmp_path, data_dir, monkeypatch):
    links = [link(f"c{i:02}", f"c{i + 1:02}") for i in range(4)] + [link(f"k{i}", f"t{i}") for i in range(9)] + [link("c00", "k0"), link("k1", "c00", "LOW")]
    spark.createDataFrame(links, EDGE).write.parquet(str(tmp_path / "edges.parquet"))
    for name in ("tree", "blob_nodes", "blob_refs", "blobs"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    begun, distances = [], graph.distances
    monkeypatch.setattr(graph, "distances", lambda links, ends, ambiguity=None: begun.append(ends.select("start").distinct().count()) or distances(links, ends, ambiguity))
    symbol_graph.path_negative(spark, str(tmp_path)).collect()
    assert begun and max(begun) <= 2
