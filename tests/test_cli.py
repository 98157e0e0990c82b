from __future__ import annotations

import json
import os
import subprocess

import pytest

from graphmill import cli, page

SOURCE = {
    "app/a.py": "import subprocess\n\nclass Run:\n    def go(self):\n        return _helper(1)\n\ndef _helper(x):\n    subprocess.run(x)\n    return x\n\ndef main():\n    Run().go()\n",
    "app/b.py": "def stop():\n    return 1\n",
    "tests/test_a.py": "from app.a import Run\n\ndef test_go():\n    Run().go()\n",
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    for path, text in SOURCE.items():
        (root / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (root / "src" / path).write_text(text)
    data = str(root / "data")
    assert cli.main(["index", "--root", str(root / "src"), "--data", data, "--rev", "one"], spark) == 0
    with open(root / "src/app/a.py", "a") as f:
        f.write("\ndef late():\n    main()\n")
    assert cli.main(["index", "--root", str(root / "src"), "--data", data, "--rev", "two", "--quiet"], spark) == 0
    return root, lambda *x: cli.main([*x, "--data", data], spark)


def test_names_and_codes(workspace, capsys):
    _, run = workspace
    assert run("resolve", "_helper") == 0 and capsys.readouterr().out == "app/a.py::_helper\n"
    assert run("resolve", "nothing") == cli.NO_MATCH
    assert run("resolve", "GO") == 0 and capsys.readouterr().out == "app/a.py::Run.go\n"
    assert run("impact", "x", "--hops", "0") == cli.USAGE and run("nonsense") == cli.USAGE
    assert run("status", "--rev", "nine") == cli.NO_MATCH


def test_answers(workspace, capsys):
    _, run = workspace
    capsys.readouterr()

    def asked(*x):
        code = run(*x, "--json")
        return code, json.loads(capsys.readouterr().out)

    code, got = asked("impact", "_helper")
    assert code == 0 and got["summary"]["effects_reachable"] == "PROCESS"
    assert {g["title"]: [r["id"] for r in g["rows"]] for g in got["groups"]} == {"dependents": ["app/a.py::Run.go", "app/a.py::main", "app/a.py::late"], "tests": ["tests/test_a.py::test_go"]}
    code, got = asked("effects", "main")
    assert got["summary"]["effects"] == "PROCESS" and got["groups"][0]["rows"][0]["next"] == "app/a.py::Run.go"
    code, got = asked("path", "_helper", "main")
    assert [r["id"] for r in got["groups"][0]["rows"]] == ["app/a.py::main", "app/a.py::Run.go", "app/a.py::_helper"]
    code, got = asked("path", "late", "_helper", "--hops", "1")
    assert [u["reason"] for u in got["unknowns"]] == ["hop_limit"] and run("path", "late", "_helper", "--hops", "1", "--strict") == cli.INCOMPLETE
    capsys.readouterr()
    code, got = asked("diff")
    assert got["summary"]["added"] == 1 and got["summary"]["new_effects"] == "PROCESS" and got["groups"][0]["rows"][0]["id"] == "app/a.py::late"
    code, got = asked("unknowns", "_helper", "--strict")
    assert code == cli.INCOMPLETE and got["groups"][0]["rows"][0]["name"] == "subprocess.run"


def test_upkeep(workspace, capsys):
    root, run = workspace
    (root / "run.json").write_text(json.dumps({"root": "x", "edges": [["app/a.py::late", "app/a.py::main"], ["app/a.py::main", "app/b.py::stop"], ["app/a.py::main", "app/b.py::none"]], "indirect": [], "executed": []}))
    capsys.readouterr()
    assert run("trace", str(root / "run.json")) == 0 and "1 confirmed, 1 added, 0 stale, 1 unmodelable" in capsys.readouterr().out
    assert run("trace") == 0 and capsys.readouterr().out == "observed: 2\n"
    (root / "other.json").write_text(json.dumps({"root": "x", "edges": [["q.py::a", "q.py::b"]], "indirect": [], "executed": []}))
    assert run("trace", str(root / "other.json")) == cli.NO_MATCH
    assert run("visualize", "--out", str(root / "p.html")) == 0
    text = (root / "p.html").read_text()
    view = page.unpacked(text.partition('id="view">')[2].partition("<")[0])
    assert {b["id"] for b in view["boxes"]} >= {"app/a.py", "app/b.py", "tests/test_a.py"} and view["summary"]["files"] == 3
    assert page.unpacked(text.partition('id="source">')[2].partition("<")[0])["app/b.py"] == SOURCE["app/b.py"]
    assert run("trace", "--forget") == 0 and run("gc", "--keep", "two") == 0 and "removed: 1" in capsys.readouterr().out


def test_marked_blocks(tmp_path):
    once = cli.with_block("a\n\n", ("x",))
    assert once == f"a\n{cli.BEGIN}\nx\n{cli.END}\n" == cli.with_block(once, ("x",))
    assert cli.with_block(once + once, ("y",)).count(cli.BEGIN) == 1
    assert cli.with_block(once, (), remove=True) == "a\n"
    for bad in (f"{cli.BEGIN}\n", f"{cli.END}\n", f"{cli.BEGIN}\n{cli.BEGIN}\n{cli.END}\n"):
        with pytest.raises(ValueError):
            cli.with_block(bad, ("x",))
    assert cli.main(["install-hooks", "--root", str(tmp_path)]) == cli.NO_MATCH
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".git/hooks/post-merge").write_bytes(b"#!/usr/bin/env python\n")
    assert cli.main(["install-hooks", "--root", str(tmp_path)]) == 0 == cli.main(["init", "--root", str(tmp_path)])
    assert os.access(tmp_path / ".git/hooks/post-commit", os.X_OK) and cli.BEGIN not in (tmp_path / ".git/hooks/post-merge").read_text()
    assert cli.main(["install-session-hook", "--root", str(tmp_path)]) == 0 and cli.BEGIN in (tmp_path / ".git/hooks/commit-msg").read_text()
    assert cli.main(["install-session-hook", "--root", str(tmp_path), "--uninstall"]) == 0 and cli.BEGIN not in (tmp_path / ".git/hooks/commit-msg").read_text()
    assert cli.GUIDE[0] in (tmp_path / "AGENTS.md").read_text()
