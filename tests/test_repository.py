from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from graphmill.functions import names
from graphmill.operators import imports, incremental, report, resolve, search, traces
from graphmill.sources import files, git, python_source


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*x):
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.invalid", *x], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    shas = []
    for i, message in enumerate(["one", "two\n\nSession: s1", "three"]):
        (root / "a.py").write_text(f"x = {i}\n" * (i + 1))
        (root / f"f{i}.py").write_text("y = 1\n" * 5)
        run("add", "-A")
        run("commit", "-q", "-m", message)
        shas.append(run("rev-parse", "HEAD"))
    return root, run, shas


def test_commits_and_revisions(spark, repository):
    root, run, shas = repository
    root = str(root)
    assert git.is_repo(root) and not git.is_repo("/") and git.default_branch(root) == "main"
    assert git.rev_parse(root, "HEAD~1") == shas[1] and git.merge_base(root, shas[0], "main") == shas[0]
    with pytest.raises(git.GitError):
        git.rev_parse(root, "nothing")
    assert [tuple(r) for r in git.first_parent_log(spark, root, shas[0]).orderBy("ord").collect()] == [(0, shas[1], shas[0], "two"), (1, shas[2], shas[1], "three")]
    assert git.first_parent_log(spark, root, None).where("parent = ''").first().sha == shas[0] and git.first_parent_log(spark, root, "HEAD").count() == 0
    found = files.session_trailers(git.commit_messages(spark, root)).where(F.size("sessions") > 0).collect()
    assert [(r.commit, r.sessions) for r in found] == [(shas[1], ["s1"])]


def test_contents_and_status(spark, repository):
    root, run, _ = repository
    sha = run("rev-parse", "HEAD:a.py")
    asked = spark.createDataFrame([(sha,), (sha.upper(),), ("0" * 40,), ("; rm",), (None,), (run("rev-parse", "HEAD^{tree}"),)], "blob_sha string")
    assert [(r.blob_sha, bytes(r.content)) for r in git.read_blobs(asked, str(root)).collect()] == [(sha, b"x = 2\n" * 3)]
    run("mv", "f0.py", "g0.py")
    (root / "a.py").write_text("changed\n")
    (root / "new.py").write_text("n")
    assert {tuple(r) for r in git.status_paths(spark, str(root)).collect()} == {("a.py", "M"), ("g0.py", "R"), ("f0.py", "D"), ("new.py", "??")}


def test_runs_against_the_tree(spark):
    calls = spark.createDataFrame([("a.py::f", "b.py::g"), ("a.py::f", "b.py::g"), ("a.py::f", "a.py::f"), ("a.py::h", "c.py::k"), ("a.py::f", "b.py::<module>"), ("a.py::f", "a.py::h")], "src string, dst string")
    ran = spark.createDataFrame([("a.py::f",), ("c.py::k",), (None,)], "id string")
    symbols = spark.createDataFrame([("a.py::f", "function", 3), ("a.py::h", "function", 9), ("b.py::g", "function", 1), ("b.py::<module>", "module", 1), ("c.py::k", "function", 1)], "id string, kind string, line_start int")
    name, links, known = traces.import_trace(calls, ran, symbols)
    assert links.count() == 4 and known.count() == 2 and name == traces.import_trace(links, known, symbols)[0]
    with pytest.raises(traces.TraceMismatch):
        traces.import_trace(spark.createDataFrame([("q::a", "q::b")], "src string, dst string"), ran.limit(0), symbols)
    stale = traces.stale_paths(spark.createDataFrame([("a.py", "1"), ("c.py", "2"), ("d.py", "3")], "path string, blob_sha string"), spark.createDataFrame([("a.py", "1"), ("c.py", "9")], "path string, blob_sha string"))
    assert {r.path for r in stale.collect()} == {"c.py", "d.py"} and {r.id for r in traces.observed_nodes(known, stale).collect()} == {"a.py::f"}
    assert {r.path for r in traces.touched_paths(links, known).collect()} == {"a.py", "b.py", "c.py"}
    static = spark.createDataFrame([("a.py::f", "b.py::g", "a.py", 5), ("a.py::f", "b.py::g", "a.py", 4)], "src string, dst string, callsite_path string, callsite_line int")
    placed = traces.project(links, static, symbols, stale)
    assert {(r.dst, r.status, r.path, r.line) for r in placed.collect()} == {("b.py::g", "confirmed", "a.py", 4), ("c.py::k", "stale", None, None), ("b.py::<module>", "unmodelable", None, None), ("a.py::h", "added", "a.py", 3)}
    assert traces.describe(placed) == "1 confirmed, 1 added, 1 stale, 1 unmodelable" and traces.describe(placed.limit(0)) == "none" and "record" in traces.describe(placed.where("status = 'stale'"))
    kept, = traces.forget("r", spark.createDataFrame([("r", 1), ("s", 2)], "rev string, n int"))
    assert [r.n for r in kept.collect()] == [2]


def test_text_search_in_rounds(spark):
    texts = {"a.py": "def f():\n    return g()\n\ndef h():\n    return f()\n", "b.py": "class C:\n    def m(self):\n        h()\n        größe = 1\n\nh()\n"}
    words = search.words_of(spark.createDataFrame(list(texts.items()), "blob_sha string, content string")).withColumnRenamed("blob_sha", "path")
    assert "größe" in {r.word for r in words.collect()}
    spans = spark.createDataFrame([("a.py", "a.py::f", 1, 2), ("a.py", "a.py::h", 4, 5), ("b.py", "b.py::C", 1, 4), ("b.py", "b.py::C.m", 2, 4)], "path string, id string, line_start int, line_end int")
    starts = spark.createDataFrame([("s", "g")], "start string, word string")
    got = {(r.id, r.hop) for r in search.grep_rounds(words, spans, starts, 5).collect()}
    assert got == {("a.py::f", 1), ("a.py::h", 2), ("b.py::C.m", 3)}
    assert search.grep_rounds(words, spans, starts, 1).count() == 1 and search.grep_rounds(words, spans, starts.limit(0), 2).count() == 0
    rows = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("X_N1",)], "id string")
    assert [r.id for r in search.search_box(rows, "N1", limit=5).collect()] == ["X_N1", "n1"] and search.search_box(rows, "n", limit=3).count() == 3


def test_upkeep_of_texts_and_settings(spark):
    old = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3)], "blob_sha string, n int")
    assert {tuple(r) for r in incremental.replace_blobs(old, spark.createDataFrame([(7, "s2"), (8, "s3")], "n int, blob_sha string")).collect()} == {("s1", 1), ("s2", 7), ("s3", 8)}
    tree = spark.createDataFrame([("a", "S1"), ("b", "s2")], "rev string, blob_sha string")
    assert {r.blob_sha for r in incremental.garbage(old, tree, ["a"]).collect()} == {"s2"} and incremental.garbage(old, tree, []).count() == 2
    meta = incremental.set_meta(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), {"b": "3", "c": "4"})
    assert {tuple(r) for r in meta.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_heads_imports_and_roots(spark):
    aliases = spark.createDataFrame([("r", "a.py", "np", "numpy"), ("r", "a.py", "f", "pkg.b.f")], "rev string, path string, alias string, target string")
    asked = spark.createDataFrame([("r", "a.py", "np.array.x"), ("r", "a.py", "f"), ("r", "a.py", "other")], "rev string, path string, name string")
    assert {(r.name, r.dotted) for r in imports.expand_heads(asked, aliases).collect()} == {("np.array.x", "numpy.array.x"), ("f", "pkg.b.f"), ("other", None)}
    symbols = spark.createDataFrame([("r", "pkg/b.py::f", "pkg/b.py", "f"), ("r", "pkg/b.py::g", "pkg/b.py", "g")], "rev string, id string, path string, qualname string")
    assert [r.id for r in imports.imported_symbols(symbols, aliases).collect()] == ["pkg/b.py::f"]
    paths = spark.createDataFrame([("src/a.py",), ("srcs/a.py",), (None,)], "path string")
    assert [r[0] for r in paths.select(names.under_source_root(F.col("path"), ["src/"])).collect()] == [True, False, None]
    assert [r[0] for r in paths.select(names.under_source_root(F.col("path"), ["", "src"])).collect()][:2] == [True, True]


def test_division_along_ancestors(spark):
    def cls(name, *methods):
        return [("r", f"p.py::{name}", "p.py", name, "class")] + [("r", f"p.py::{name}.{m}", "p.py", f"{name}.{m}", "method") for m in methods]

    symbols = spark.createDataFrame([*cls("P", "a"), *cls("Q", "b"), *cls("Base", "b"), *cls("Has", "a"), *cls("Heir", "a", "b"), *cls("Not", "a"), *cls("Empty")], "rev string, id string, path string, qualname string, kind string")
    required = spark.createDataFrame([("r", "p.py::P"), ("r", "p.py::Q"), ("r", "p.py::Empty")], "rev string, protocol string")
    order = spark.createDataFrame([("r", f"p.py::{c}", f"p.py::{a}", d) for c, a, d in (("P", "P", 0), ("P", "Q", 1), ("Has", "Has", 0), ("Has", "Base", 1), ("Heir", "Heir", 0), ("Heir", "P", 1), ("Heir", "Q", 2))], "rev string, cls string, anc string, depth int")
    got = {(r.protocol[6:], r.id[6:]) for r in resolve.containing_classes(symbols, required, order).collect()}
    assert got == {("P", "Has"), ("Q", "Base"), ("Q", "Has")}


def test_pairs_of_the_division_are_decided_where_they_are_joined(spark):
    rows = [("r", f"p.py::{c}.{m}", "p.py", f"{c}.{m}", "method") for c, ms in {"P": "ab", "Both": "abc", "One": "a", "Q": "c", "Heir": "ab"}.items() for m in ms]
    symbols = spark.createDataFrame(rows, "rev string, id string, path string, qualname string, kind string")
    required = spark.createDataFrame([("r", "p.py::P"), ("r", "p.py::Q")], "rev string, protocol string")
    order = spark.createDataFrame([("r", "p.py::Heir", "p.py::P", 1)], "rev string, cls string, anc string, depth int")
    found = resolve.containing_classes(symbols, required, order)
    assert {(r.protocol[6:], r.id[6:]) for r in found.collect()} == {("P", "Both"), ("Q", "Both")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "forall" in next(x for x in plan if "Join" in x)  # nothing is joined, thus shuffled, after the pairs


def test_labels_sessions_and_further_steps(spark):
    made = spark.createDataFrame([("a", '{"summary": {"symbol": "p.py::f"}, "groups": []}'), ("b", '{"summary": {}, "groups": [{"title": "x"}, {"title": "y"}]}'), ("c", "{}")], "report string, json string")
    assert {r.report: r.label for r in report.report_label(made).collect()} == {"a": "p.py::f", "b": "x, y", "c": None}
    rows = report.with_sessions(spark.createDataFrame([("r1", 1), ("r2", 2)], "rev string, n int"), spark.createDataFrame([("r1", ["s"])], "commit string, sessions array<string>"))
    assert {r.rev: r.sessions for r in rows.collect()} == {"r1": ["s"], "r2": []}

    parsed = python_source.parse_texts(spark.createDataFrame([("s", "def known(): pass\n\ndef use():\n    plugin_known()\n")], "blob_sha string, content string"))
    parts = [python_source.relation(parsed, x) for x in ("nodes", "refs", "imports", "bindings")]

    def plugins(uses, symbols):
        named = symbols.select("rev", F.col("id").alias("dst"), F.concat(F.lit("plugin_"), "qualname").alias("name"))
        return uses.join(named, ["rev", "name"]).withColumn("rank", F.lit(0))

    tree = spark.createDataFrame([("r", "m.py", "s")], "rev string, path string, blob_sha string")
    assert imports.resolve_parsed(tree, *parts)[0].count() == 0
    assert [(r.src, r.dst, r.confidence) for r in imports.resolve_parsed(tree, *parts, more_steps=[plugins])[0].collect()] == [("m.py::use", "m.py::known", "LOW")]
