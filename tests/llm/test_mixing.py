from __future__ import annotations

import random

import pytest

from graphmill.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **more):
    chosen, report = mixing.mix(spark.createDataFrame(docs, "doc bigint, src string, n int"), "doc", "src", "n", spark.createDataFrame(targets, TARGETS), **more)
    return {r.item: r for r in chosen.collect()}, {r.source: r for r in report.collect()}


def test_shares_are_met_within_one_document(spark):
    draw = random.Random(2)
    docs = [(i, draw.choice(["big", "big", "big", "BIG ", "mid", "tiny", "other", None]) if i % 50 else "tiny", draw.randrange(1, 40)) for i in range(3000)]
    docs += [(9000, "mid", 0), (9001, "mid", None), (None, "mid", 5), (3, "big", 1)]
    chosen, report = run(spark, docs, [("Big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("absent", 0.05, 2), (None, 0.1, 1), ("zero", 0.0, 1), ("mid", 0.3, 2)])
    assert set(report) == {"big", "mid", "tiny", "absent"}
    whole = sum(r.size * r.copies for r in chosen.values())
    for source, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15), ("absent", 0.0)):
        got = sum(r.size * r.copies for r in chosen.values() if r.source == source)
        assert report[source].size == got and report[source].actual_share == pytest.approx(got / whole)
        assert abs(got - share / 0.95 * whole) <= 40 * 2
        assert all(r.copies <= report[source].max_repeats for r in chosen.values() if r.source == source)
    # The source that holds the mix back is used up.
    assert any(sum(r.size * r.copies for r in chosen.values() if r.source == s) >= m * sum(n for s2, n in {(d, (x or "").strip().lower()): n for d, x, n in docs if n and d is not None and d != 3}.items() if s2[1] == s) - 80 for s, m in (("big", 1), ("mid", 2), ("tiny", 3)))


def test_a_smaller_mix_is_part_of_a_larger_one(spark):
    docs = [(i, "a" if i % 3 else "b", 1 + i % 17) for i in range(800)]
    small, _ = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=800)
    large, report = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=2400)
    assert set(small) < set(large) and 2400 - 34 <= sum(r.size for r in report.values()) <= 2400


def test_empty_tables(spark):
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([], [])):
        chosen, report = run(spark, docs, targets)
        assert not chosen and all(r.actual_share == 0 for r in report.values()) and len(report) == len(targets)
