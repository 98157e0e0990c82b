from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from graphmill.operators import snapshots

NODES = "blob_sha string, ordinal int, qualname string, kind string, body_hash string, name_binding string"
EDGES = "rev string, src string, dst string, kind string, confidence string, provenance string"
TREE = "rev string, path string, blob_sha string, ingested_at timestamp, idx int"
REVS = "rev string, kind string, materialized_at bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute(revisions, tree, nodes, edges):
    at = {}
    for rev, _, t in revisions:
        if rev is not None:
            at[rev] = min(at.get(rev, t), t)
    order = sorted({r for r, *_ in tree if r in at}, key=lambda r: (at[r], r))
    latest = {}
    for rev, path, sha, when, _ in tree:
        if rev is None or path is None:
            continue
        path = "/".join(x for x in path.replace("\\", "/").split("/") if x not in ("", "."))
        key = (when or datetime.min, (sha or "").lower())
        latest[rev, path] = max(latest.get((rev, path), (datetime.min, "")), key)
    live = {}
    for sha, ordinal, name, _, body, binding in sorted(set(nodes), key=lambda x: x[1]):
        if binding == "live":
            live[sha, name] = body
    links = defaultdict(set)
    for rev, src, dst, kind, confidence, _ in edges:
        if src is not None and dst:
            links[rev, src, dst].add((kind, confidence))
    out = []
    states = []
    for rev in order:
        paths = {p: s for (r, p), (_, s) in latest.items() if r == rev and s}
        symbols = {f"{p}::{n}": b for p, s in paths.items() for (t, n), b in live.items() if t == s}
        states.append((("tree", {(p, ""): s for p, s in paths.items()}), ("symbol", {(i, ""): b for i, b in symbols.items()}), ("edge", {(a, b): frozenset(x) for (r, a, b), x in links.items() if r == rev})))
    for k in range(1, len(order)):
        for (record, old), (_, new) in zip(states[k - 1], states[k]):
            for key in old.keys() | new.keys():
                change = "removed" if key not in new else "added" if key not in old else "changed" if old[key] != new[key] else None
                if change:
                    out.append((order[k], record, *key, change))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_changes_equal_comparing_neighbours(spark, seed):
    draw = random.Random(seed)
    revs = [f"r{i}" for i in range(6)]
    draw.shuffle(revs)
    revisions = [(r, "commit", 10 * i) for i, r in enumerate(revs)] + [(revs[0], "commit", 99), ("never", "commit", 25), (None, "x", 1)]
    start = datetime(2025, 1, 1)
    tree, edges = [], []
    for r in revs:
        for p in range(8):
            if draw.random() < 0.75:
                for _ in range(draw.choice([1, 1, 2])):
                    spelled = draw.choice([f"d/f{p}.py", f"./d/f{p}.py", f"d\\f{p}.py"])
                    tree.append((r, spelled, draw.choice(["AA", "aa", "bb", "cc", None, ""]), start + timedelta(hours=draw.randrange(5)) if draw.random() < 0.9 else None, 7))
        for _ in range(25):
            edges.append((r, draw.choice([*"abc", None]), draw.choice([*"abc", "", None]), draw.choice(["CALLS", "REFERENCES", None]), draw.choice(["HIGH", "LOW", None]), "static"))
    tree += tree[:5] + [(None, "x", "aa", start, 1), (revs[0], None, "aa", start, 1)]
    nodes = [(s, i, draw.choice(["f", "C.m", "g"]), "function", draw.choice(["h1", "h2"]), draw.choice(["live", "live", "shadowed"])) for s in ("aa", "bb", "cc") for i in range(3)]
    got = snapshots.revision_changes(spark.createDataFrame(revisions, REVS), spark.createDataFrame(tree, TREE), spark.createDataFrame(nodes + nodes[:2], NODES), spark.createDataFrame(edges + edges[:9], EDGES))
    assert rows(got) == brute(revisions, tree, nodes, edges)


def test_intervals_split_at_gaps_and_contents(spark):
    df = spark.createDataFrame([("k", 0, "x"), ("k", 1, "x"), ("k", 3, "x"), ("k", 4, "y"), (None, 2, None), (None, 3, None)], "k string, idx int, c string")
    intervals = snapshots.validity_intervals(df, ["k"], "c")
    assert rows(intervals) == sorted([("k", "x", 0, 1), ("k", "x", 3, 3), ("k", "y", 4, 4), (None, None, 2, 3)], key=repr)
    assert rows(snapshots.change_events(intervals, ["k"], "c", 5)) == sorted([("k", 2, "removed"), ("k", 3, "added"), ("k", 4, "changed"), ("k", 5, "removed"), (None, 2, "added"), (None, 4, "removed")], key=repr)


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (REVS, TREE, NODES, EDGES)]
    assert snapshots.revision_changes(*none).count() == 0
