from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_a_worker_never_overfills(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    numbers = packing._pack(lengths, 100, packing.CLASSES)
    used = np.bincount(numbers, weights=lengths)
    assert (numbers >= 0).all() and used.max() <= 100 and (used > 0).all()
    assert len(used) <= 1.7 * lengths.sum() / 100 + packing.CLASSES


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_fixed_counts_alone(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    numbers = packing._pack_counts(lengths, 100, packing.CLASSES)
    used = np.bincount(numbers, weights=lengths)
    assert used.max() <= 100 and (used > 0).all()
    kind = np.minimum(100 // lengths, packing.CLASSES)
    for j in range(1, packing.CLASSES):
        sizes = np.bincount(numbers[kind == j])
        assert sorted(sizes[sizes > 0])[1:] == [j] * (np.count_nonzero(sizes) - 1)
        assert not set(numbers[kind == j]) & set(numbers[kind != j])


def test_an_item_with_many_copies(spark):
    rows = spark.range(25_000).selectExpr("7L as doc", "30 as tokens").union(spark.createDataFrame([(8, 60)], "doc bigint, tokens int"))
    assert {tuple(r) for r in packing.pieces(rows, "doc", "tokens", 100).groupBy("item").count().collect()} == {(7, 25_000), (8, 1)}
    assert packing.pieces(rows, "doc", "tokens", 100).select("item", "copy").distinct().count() == 25_001
    for fill_up in (True, False):
        packed = packing.harmonic_containers(rows, "doc", "tokens", 100, per_worker=5_000, fill_up=fill_up)
        assert packed.count() == 25_001 and packed.groupBy("container_id").agg({"length": "sum"}).where("`sum(length)` > 100").isEmpty()


@pytest.mark.parametrize("per_worker", [40, 10_000])
def test_every_piece_is_packed_once(spark, per_worker):
    draw = random.Random(7)
    data = [(i, draw.choice([0, 1, 50, 51, 100, 101, 250, draw.randrange(1, 60), None, -3]), "x") for i in range(600)] + [(None, 30, "x"), (5, 20, "x")]
    df = spark.createDataFrame(data, "doc bigint, tokens int, length string")
    got = packing.harmonic_containers(df, "doc", "tokens", 100, per_worker=per_worker).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in got:
        used[r.container_id] += r.length
        parts[r.item].append((r.piece, r.start, r.length))
    assert max(used.values()) <= 100
    want = defaultdict(list)
    for doc, n, _ in data:
        if n and n > 0:
            want[doc] += [(k, k * 100, min(100, n - k * 100)) for k in range(-(-n // 100))]
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    if per_worker > 1000:  # no packing needs fewer than these
        over_half = sum(n > 50 for pieces in want.values() for _, _, n in pieces)
        assert len(used) <= 1.1 * max(over_half, sum(used.values()) / 100)


def test_empty(spark):
    packed = packing.harmonic_containers(spark.createDataFrame([], "doc bigint, tokens int"), "doc", "tokens", 10)
    assert packed.count() == 0 and packing.container_report(packed, 10).count() == 0
