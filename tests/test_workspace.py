from __future__ import annotations

import os
import shutil
import subprocess
import sys

from graphmill import workspace


def test_cuts_know_their_rows_and_can_be_dropped(spark):
    df = workspace.cut(spark.range(10).where("id > 3"))
    assert workspace.rows_of(df) == 6 == df.count()
    assert "Broadcast" not in workspace.broadcast_if_small(df, 5)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in workspace.broadcast_if_small(df, 6)._jdf.queryExecution().analyzed().toString()
    assert os.path.isdir(df._graphmill_path)
    workspace.drop(df, None)
    assert not os.path.exists(df._graphmill_path)


def test_core_does_not_need_the_text_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(workspace.__file__)))
    for folder, _, files in os.walk(os.path.join(root, "graphmill")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "graphmill.llm" not in f.read(), name


def test_the_rest_runs_without_the_text_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(workspace.__file__)))
    shutil.copytree(os.path.join(root, "graphmill"), tmp_path / "graphmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    asked = "import __spark_entry__ as e, graphmill.cli; q = e.queries(); assert 'p2_found' in q and 'p3_found' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", asked], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 70, done.stderr
