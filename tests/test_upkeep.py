from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphmill.functions import names
from graphmill.operators import evaluate, incremental, order, report, resolve, view
from graphmill.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_sums_over_range_partitions(spark):
    draw = random.Random(1)
    data = [(draw.choice(["hot", "hot", "cold", None]), i, draw.randrange(5)) for i in range(500)]
    got = order.running_sums(spark.createDataFrame(data, "g string, i int, v int").repartition(7), "g", ["i"], {"upto": F.col("v"), "pos": F.lit(1)})
    want, sums = [], {}
    for g, i, v in data:
        s, n = sums.get(g, (0, 0))
        sums[g] = (s + v, n + 1)
        want.append((g, i, v, s + v, n + 1))
    assert rows(got) == sorted(want, key=repr)


def test_globs_and_rules(spark):
    rules = [resolve.Rule("db.*", "DB_READ"), resolve.Rule("db.write", "DB_WRITE"), resolve.Rule("*.send", "NETWORK"), resolve.Rule("db.*", "PROCESS", "LOW", True), resolve.Rule("f[!a]x", "FS_READ"), resolve.Rule("a?b", "FS_WRITE")]
    asked = ["db.write", "db.read", "x.send", "fbx", "fax", "azb", "a.b", "none", None, "db.a\nb"]
    df = spark.createDataFrame([(x,) for x in asked], "name string").select("name", resolve.best_rule(F.col("name"), rules).alias("h"))
    got = {r.name: (r.h.effect, r.h.rank) if r.h else None for r in df.collect()}
    assert got == {"db.write": ("DB_WRITE", 2), "db.read": ("PROCESS", 0), "x.send": ("NETWORK", 0), "fbx": ("FS_READ", 1), "fax": None, "azb": ("FS_WRITE", 1), "a.b": ("FS_WRITE", 1), "none": None, None: None, "db.a\nb": ("PROCESS", 0)}


@pytest.mark.parametrize(
    ("expression", "value", "want"),
    [
        (names.module_of_path, "src/lib/a/b.py", "a.b"), (names.module_of_path, "src/a/__init__.py", "a"), (names.module_of_path, "x.py", "x"), (names.module_of_path, "__init__.py", ""), (names.module_of_path, None, None),
        (names.named_scope, "f.<locals>.<lambda>", "f"), (names.named_scope, "<listcomp>", None), (names.named_scope, "f.<locals>.g", "f.<locals>.g"), (names.named_scope, "f.<locals>.<lambda>.<locals>.<genexpr>", "f"),
        (names.parent_scope, "f.<locals>.g", "f"), (names.parent_scope, "A.b", "A"), (names.parent_scope, "f", None),
        (names.is_dunder, "__init__", True), (names.is_dunder, "____", False), (names.is_dunder, "_x_", False),
        (names.is_test_path, "a/tests/x.py", True), (names.is_test_path, "test_a.py", True), (names.is_test_path, "a/b_test.py", True), (names.is_test_path, "a/conftest.py", True), (names.is_test_path, "contest/latest.py", False),
        (names.literal_prefix_length, "a.b*", 3), (names.literal_prefix_length, "abc", 3), (names.literal_prefix_length, "*", 0),
        (names.tier_rank, "HIGH", 2), (names.tier_rank, "odd", None), (names.tier_rank, None, None),
    ],
)
def test_names(spark, expression, value, want):
    args = (("src", "src/lib"),) if expression is names.module_of_path else ()
    assert spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"), *args)).first()[0] == want


def test_absolute_modules(spark):
    df = spark.createDataFrame([("m", 0, "a.b"), ("m", 1, "a.b"), ("m", 2, "a.b"), ("m", 5, "a.b"), ("", 1, "a.b"), (None, 1, "a")], "m string, l int, p string")
    assert [r[0] for r in df.select(names.absolute_module(F.col("m"), F.col("l"), F.col("p"))).collect()] == ["m", "a.b.m", "a.m", "m", "a.b", "a"]


def test_fingerprints_ignore_order_but_not_repeats(spark):
    data = [(i, f"x{i % 7}", None if i % 3 else 1) for i in range(200)]
    df = spark.createDataFrame(data, "a int, b string, c int")
    one = incremental.fingerprint(df)
    assert one == incremental.fingerprint(spark.createDataFrame(data[::-1], "a int, b string, c int").repartition(5))
    assert one != incremental.fingerprint(df.union(df.limit(1))) and one != incremental.fingerprint(df.where("a > 0"))


def test_what_an_edit_touches(spark):
    tree = lambda *x: spark.createDataFrame(list(x), "path string, blob_sha string")
    old, body, added = tree(("a", "1"), ("b", "2")), tree(("a", "1"), ("b", "3")), tree(("a", "1"), ("b", "2"), ("c", "9"))
    assert rows(incremental.dirty_paths(old, added)) == [("c", "added")] and rows(incremental.dirty_paths(added, old)) == [("c", "removed")]
    seen = spark.createDataFrame([("2", 7), ("3", 7)], "blob_sha string, signature bigint")
    changes = incremental.dirty_paths(old, body)
    assert rows(changes) == [("b", "changed")]
    assert incremental.narrowable(changes, old, body, seen)
    assert not incremental.narrowable(changes, old, body, seen.where("blob_sha = '2'"))
    assert not incremental.narrowable(changes, old, body, seen, traced=spark.createDataFrame([("b",)], "path string"))
    assert not incremental.narrowable(incremental.dirty_paths(old, added), old, added, seen)
    assert rows(incremental.replace_paths(old, tree(("b", "5")), changes)) == [("a", "1"), ("b", "5")]


def test_revisions_are_seeded_and_dropped(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "rev string, v int")
    assert rows(incremental.seed_revision(df, "a", "c")) == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(incremental.seed_revision(df, "a", "c", move=True)) == [("b", 2), ("c", 1)]
    assert rows(incremental.drop_revision(df, "b")) == [("a", 1), ("c", 3)]


def test_dependents(spark):
    imports = spark.createDataFrame([("r", "x.py", "a.b.c"), ("r", "y.py", "a.bc"), ("r", "z.py", "a.b")], "rev string, importer_path string, module string")
    assert rows(incremental.dependents(imports, spark.createDataFrame([("r", "a.b")], "rev string, module string"))) == [("r", "x.py"), ("r", "z.py")]


def test_treemap_fits_and_fills(spark):
    leaves = spark.createDataFrame([("r", f"src/deep/only/{d}/f{i}.py", 10 * i + 1) for d in "abc" for i in range(6)] + [("r", "top.py", None), ("q", "one.py", 5)], "rev string, path string, weight int")
    drawn = view.boxes(leaves)
    found = {(r.rev, r.box): r for r in drawn.collect()}
    assert ("r", "src/deep") not in found and found["r", "src/deep/only"].parent == "" and found["r", "src/deep/only/a"].name == "a"
    assert found["r", ""].weight == 3 * sum(10 * i + 1 for i in range(6)) + 1
    rects = {(r.rev, r.box): r for r in view.treemap(drawn).collect()}
    assert set(rects) == set(found)
    for key, box in found.items():
        if box.parent is not None:
            a, p = rects[key], rects[key[0], box.parent]
            assert a.x >= p.x - 1 and a.y >= p.y - 1 and a.x + a.w <= p.x + p.w + 1 and a.y + a.h <= p.y + p.h + 1
            brothers = [rects[k] for k, b in found.items() if k[0] == key[0] and b.parent == box.parent]
            assert a.w * a.h == pytest.approx(box.weight / sum(found[k].weight for k, b in found.items() if k[0] == key[0] and b.parent == box.parent) * sum(b.w * b.h for b in brothers), rel=1e-6)


def test_bundles_keep_to_their_quota(spark):
    edges = spark.createDataFrame([("r", f"x{i}", f"y{i % 3}", "CALLS", 2) for i in range(9)] + [("r", "x1", "x2", "CALLS", 2)], "rev string, src string, dst string, kind string, rank int")
    visible = spark.createDataFrame([("r", f"x{i}", "X") for i in range(9)] + [("r", f"y{i}", f"Y{i}") for i in range(3)], "rev string, id string, shown string")
    assert [(r.b, r.n, r.drawn) for r in view.bundles(edges, visible, 2).orderBy("b").collect()] == [("Y0", 3, True), ("Y1", 3, True), ("Y2", 3, False)]


def test_tool_report(spark):
    truth = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c"), ("q2", "c")], "question string, item string")
    answers = spark.createDataFrame([("t", "q1", "a"), ("t", "q1", "z"), ("t", "q2", "c"), ("t", "q3", "w"), ("u", "q1", None)], "tool string, question string, item string")
    got = {r.tool: r for r in evaluate.tool_report(answers, truth).collect()}
    assert (got["t"].questions, got["t"].perfect, got["t"].quartiles) == (3, 2, [0.75, 1.0, 1.0])
    assert got["t"].recall == pytest.approx(2 / 3) and got["t"]["yield"] == pytest.approx(0.5) and got["u"].recall == 0


def test_first_reason_of_the_ladder(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    assert [r.why for r in evaluate.classify_misses(df, [("small", F.col("v") < 3), ("any", F.col("v") < 9)]).collect()] == ["small", "any", "other"]


def test_bootstrap_covers_the_mean(spark):
    draw = random.Random(3)
    data = [("m", 0.0, draw.gauss(0.5, 1)) for _ in range(200)] + [("same", 1.0, 1.0)] * 5 + [("m", None, 1.0)]
    got = {r.name: r for r in evaluate.paired_bootstrap(spark.createDataFrame(data, "name string, a double, b double"), resamples=500).collect()}
    m = got["m"]
    assert m.n == 200 and m.low < m.difference < m.high and 0.2 < m.high - m.low < 0.36
    assert (got["same"].low, got["same"].difference, got["same"].high) == (0, 0, 0)


def test_reports_and_envelopes(spark):
    data = spark.createDataFrame([("r", "b", 2, "x::f"), ("r", "b", 1, "x::g"), ("r", "a", 1, "y::h")], "rev string, section string, place int, id string")
    made = report.as_json(report.grouped_report(data, ["rev"], "section", "place", ["id"]), ["rev"])
    groups = json.loads(made.first().json)["groups"]
    assert [(g["title"], [x["id"] for x in g["rows"]]) for g in groups] == [("a", ["y::h"]), ("b", ["x::g", "x::f"])]
    reports = spark.createDataFrame([("one", made.first().json), ("two", '{"summary": {"symbol": "s::t", "to": "plain"}}'), ("bad", "no json")], "report string, json string")
    assert rows(report.highlighted(reports)) == sorted([("one", "x::f"), ("one", "x::g"), ("one", "y::h"), ("two", "s::t")])
    reasons = spark.createDataFrame([("r", "a", "external"), ("r", "b", "external"), ("r", "b", "hop_limit"), ("r", "c", "odd")], "rev string, id string, reason string")
    assert rows(report.is_incomplete(reasons)) == [("r", "a", False), ("r", "b", True), ("r", "c", True)]


@pytest.mark.parametrize(
    ("lines", "want"),
    [(["x"], ["x", "<", "new", ">"]), (["a", "<", "old", ">", "b"], ["a", "<", "new", ">", "b"]), (["<", ">", "a", "<", "q", ">"], ["<", "new", ">", "a"]), (["<", "a"], None), ([">", "<"], None), ([], ["<", "new", ">"])],
)
def test_marked_blocks(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(report.replace_marked(F.col("l"), "<", ">", ["new"])).first()[0] == want


def test_streams_end_where_the_batch_does(spark, tmp_path):
    start = datetime(2025, 1, 1)
    draw = random.Random(5)
    data = [(f"d/f{draw.randrange(6)}.py", draw.choice(["aa", "BB", None]), start + timedelta(minutes=draw.randrange(500))) for _ in range(60)]
    schema = "path string, blob_sha string, at timestamp"
    for k in range(4):
        spark.createDataFrame(data[k * 15 : k * 15 + 15], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = streams.keep_current(stream, f"{tmp_path}/tree").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = streams.newest(spark.createDataFrame([(p, s.lower() if s else None, t) for p, s, t in data], schema))
    assert rows(spark.read.parquet(f"{tmp_path}/tree/version=4")) == rows(batch)


def test_event_windows_and_sessions(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = streams.read_stream(spark, f"{tmp_path}/ev", events.schema)
    for name, made, keys in (("w", streams.event_windows, ["window_start", "event_type"]), ("s", streams.user_sessions, ["user_id", "session_start"])):
        query = made(stream).writeStream.format("memory").queryName(f"got_{name}").outputMode("complete" if name == "w" else "append").trigger(availableNow=True).start()
        query.awaitTermination()
        got, want = spark.table(f"got_{name}").select(*keys, "n"), made(events).select(*keys, "n")
        assert got.exceptAll(want).count() == 0 and got.count() > 0


def test_observed_calls_join_the_present_tree(spark):
    calls = spark.createDataFrame([("a::f", "b::g", "a.py", "AA"), ("a::f", "b::g", "gone.py", "x")], "src string, dst string, path string, blob_sha string")
    tree = spark.createDataFrame([("./a.py", "aa")], "path string, blob_sha string")
    assert [(r.path, r.stale) for r in streams.observed_calls(calls, tree).orderBy("path").collect()] == [("a.py", False), ("gone.py", True)]
