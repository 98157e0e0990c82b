from __future__ import annotations

from graphmill.plans import symbol_graph


def test_history_follows_certain_moves(spark, tmp_path):
    tables = {
        "revisions": ("rev string, materialized_at long", [("r0", 1), ("r1", 2)]),
        "tree": ("rev string, path string, blob_sha string, ingested_at long", [("r0", "a.py", "aa", 1), ("r0", "b.py", "bb", 1), ("r1", "c.py", "aa", 1), ("r1", "b.py", "dd", 1)]),
        "blobs": ("blob_sha string, module_body_hash string", [("aa", "m"), ("bb", "m"), ("dd", "m")]),
        "blob_nodes": ("blob_sha string, ordinal int, qualname string, kind string, line_start int, line_end int, body_hash string, name_binding string, shadow_index int", [(s, i, q, "function", 1, 9, h, "live", None) for s, i, q, h in (("aa", 0, "f", "hf"), ("bb", 0, "g", "hg"), ("bb", 1, "x1", "same"), ("bb", 2, "x2", "same"), ("dd", 0, "g", "hg2"), ("dd", 1, "y", "same"))]),
        "blob_refs": ("blob_sha string, ordinal int, from_qualname string, ref_kind string, raw_name string, dotted string, line int", [("aa", 0, "f", "call", "open", None, 2), ("dd", 0, "g", "call", "open!write", None, 3)]),
        "edges": ("rev string, src string, dst string, kind string, confidence string, provenance string, callsite_path string, callsite_line int", [("r0", "b.py::g", "a.py::f", "CALLS", "HIGH", "static", "b.py", 2), ("r1", "b.py::g", "c.py::f", "CALLS", "HIGH", "static", "b.py", 2)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.rev, r.id): r for r in symbol_graph.symbol_history(spark, str(tmp_path)).collect()}
    assert set(got) == {("r1", "b.py::g"), ("r1", "c.py::f"), ("r1", "b.py::x1"), ("r1", "b.py::x2"), ("r1", "b.py::y")}
    links = ("calls_added", "calls_removed", "dependents_added", "dependents_removed")
    f, g = got["r1", "c.py::f"], got["r1", "b.py::g"]
    assert f.moved_from == "a.py::f" and not any(f[x] for x in (*links, "body", "effects_added", "effects_removed"))
    assert (g.body, g.effects_added, g.effects_removed, g.moved_from) == (1, 1, 0, None) and not any(g[x] for x in links)
    assert {i for (_, i), r in got.items() if r.lineage_ambiguous} == {"b.py::x1", "b.py::x2", "b.py::y"}
    (step,) = symbol_graph.history_steps(spark, str(tmp_path)).collect()
    assert (step.rev, step.moves, step.edges_added, step.edges_removed, step.effects_added, step.effects_removed) == ("r1", 1, 0, 0, 1, 0)
