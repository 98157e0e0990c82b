from __future__ import annotations

import inspect

from graphmill.operators import evaluate
from graphmill.plans import symbol_graph


def test_bootstrap_ci_draws_twenty_thousand_times(spark, data_dir, monkeypatch):
    bound = inspect.signature(evaluate.paired_bootstrap)
    seen = []
    monkeypatch.setattr(evaluate, "paired_bootstrap", lambda *a, **k: seen.append(bound.bind(*a, **k)))
    symbol_graph.bootstrap_ci(spark, data_dir)
    seen[0].apply_defaults()
    assert seen[0].arguments["resamples"] == 20_000
