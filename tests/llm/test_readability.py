from __future__ import annotations

import random
from collections import Counter

import numpy as np

from graphmill.llm import prose, readability

EASY = "the cat sat on a mat and it was fun we run to see my dog he has one red box".split()
MIDDLE = "each release records which packages changed because several users depend on the earlier behaviour of this tool".split()
HARD = "notwithstanding epistemic heterogeneity the parametrization circumscribes irreducible provenance whereas invalidation presupposes determinism".split()


def corpus(n=240, seed=3):
    draw = random.Random(seed)
    docs, bands = [], {}
    for i in range(n):
        band = i % 3 + 1
        own, near = (EASY, MIDDLE, HARD)[band - 1], (MIDDLE, EASY if i % 2 else HARD, MIDDLE)[band - 1]
        docs.append((i, " ".join(draw.choice(own if draw.random() < 0.8 else near) for _ in range(80)) + "."))
        bands[i] = band
    return docs, bands


def test_held_out_bands(spark):
    docs, bands = corpus()
    extra = [(1000, "the and of " * 10), (1001, None), (1002, ""), (1003, "der Hund und die Katze sind nicht in dem Haus mit der Maus " * 8), (None, docs[0][1]), (0, docs[0][1])]
    labels = [(i, "r", b) for i, b in bands.items() if i % 4 == 0] + [(1, "r", None), (2, "r", 9), (5, "a", 1), (5, "b", 2), (None, "r", 1), (7777, "r", 3)]
    frames = spark.createDataFrame([(*d, "x") for d in docs + extra], "doc_id bigint, text string, band string"), spark.createDataFrame(labels + labels[:5], "doc_id bigint, rater string, band int")
    got = {r.doc_id: r.band for r in readability.reading_levels(*frames).collect()}
    assert got == bands
    blocks = {r.doc_id: (r.band, round(r.theta, 6)) for r in readability.reading_levels(*frames, block_terms=100).collect()}
    assert {d: b for d, (b, _) in blocks.items()} == bands
    assert blocks == {r.doc_id: (r.band, round(r.theta, 6)) for r in readability.reading_levels(*frames).collect()}


def test_documents_of_words_of_their_own_keep_their_row(spark):
    docs, bands = corpus(60)
    alone = (9000, " ".join(f"the{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x" for i in range(60)))
    labels = [(i, "r", b) for i, b in bands.items() if i % 2 == 0]
    frames = spark.createDataFrame([*docs, alone], "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, rater string, band int")
    for size in (40, 250_000):
        got = {r.doc_id: r for r in readability.reading_levels(*frames, block_terms=size).collect()}
        assert got.keys() == {*bands, 9000} and got[9000].theta == 0 and got[9000].n_words == 60


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 0, 3], [256, 65_535, 0, 1], [70_000, 5, 5]):
        data, size = readability._pack(np.array(values, np.int64))
        assert readability._unpack(data, size, len(values)).tolist() == values and size == (4 if max(values, default=0) > 65_535 else 2 if max(values, default=0) > 255 else 1)


def test_occurrence_model_fits_margins_and_measures_length(spark):
    draw = random.Random(5)
    words = [f"the{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    docs = [(i, " ".join(draw.sample(words, 40 + i % 20))) for i in range(60)]
    got = readability.occurrence_levels(spark.createDataFrame([*docs, (None, "x")], "doc_id bigint, text string"), spark.createDataFrame([(0, "r", 1), (19, "r", 3)], "doc_id bigint, rater string, band int"), block_terms=500).collect()
    assert {r.doc_id: r.score for r in got} == {i: 40 + i % 20 for i, _ in docs}
    ordered = sorted(got, key=lambda r: r.score)
    assert all(a.level < b.level if a.score < b.score else a.level == b.level for a, b in zip(ordered, ordered[1:]))
    # As many words are expected to occur as do, over all documents and words.
    frequency = Counter(w for _, t in docs for w in set(t.split()))
    level = {r.score: r.level for r in got}
    for w, n in list(frequency.items())[:5]:
        b = np.linspace(-20, 20, 4001)
        expected = sum(1 / (1 + np.exp(-(level[40 + i % 20] - b))) for i in range(60))
        assert abs(np.interp(n, expected[::-1], b[::-1])) < 10


def test_without_labels_or_documents(spark):
    docs, _ = corpus(6)
    none = spark.createDataFrame([], "doc_id bigint, rater string, band int")
    assert {r.band for r in readability.reading_levels(spark.createDataFrame(docs, "doc_id bigint, text string"), none).collect()} == {None}
    assert readability.reading_levels(spark.createDataFrame([], "doc_id bigint, text string"), none).count() == 0


def test_prose_leaves_out_what_is_no_sentence():
    text = """# A heading

Please read this (e.g. 1.2.3) first (see `run_all()`).
```python
value = compute(1)
```
Traceback (most recent call last):
  File "a.py", line 1, in f
ValueError: bad
>>> x = f(y)
| a | 1 |
See https://example.invalid/page#x
It's long-term work by load_all and app.core.Thing or MyClass!
Session: abc-12"""
    assert prose.words(text) == "please read this first see it's long-term work by and or".split()
    assert prose.words(None) == prose.words("") == []
    assert len(prose.words("word " * 200_000)) == 200_000


def test_languages():
    assert prose.is_english(Counter("this is the way that it works".split()))
    assert prose.is_english(Counter("heuristic invalidation approximates provenance".split()))
    assert not prose.is_english(Counter("das ist nicht der Weg und es wird so".split()))
    assert not prose.is_english(Counter("el nodo lee cada archivo una sola vez en los proyectos".split()))
    assert not prose.is_english(Counter())
