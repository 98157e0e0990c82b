"""Reading level of documents: Rasch models of word occurrences.

Each occurrence of a word in a document is a response on the scale of the
bands 1 < 2 < 3, and the model is the partial credit model of the Rasch
family. A document has one level and a word one difficulty per step: in adjacent
bands, the log odds of an occurrence are

    log P(k + 1) / P(k) = level[d] - difficulty[w, k].

A word's difficulties are the log ratios of its rates in bands k and k + 1, up to
the common steps ``-STEP, STEP`` that fix the scale. They are estimated by
alternating steps over all documents: given the difficulties, each document's
level by itself; given the levels, each word's rates from sums over all
documents. Documents with a known band start the difficulties. Two limits on the
level turn it into bands; they are set where the known bands are told apart best
and, among equally good places, where fewest documents lie.

Documents are packed in blocks with a vocabulary of their own. In a round a block
is sent the rates of its own words and gives back its sums per word, so neither
the driver nor any executor ever holds the whole vocabulary, and there is one
way for every number of words.

:func:`occurrence_levels` is the dichotomous model, in which a word occurs or
doesn't. Its level depends on a document only through the number of words that
occur, so it measures how long a text is; it is kept to show that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm import prose
from graphmill.workspace import broadcast_if_small, cut

BANDS = 3

#: Rounds of alternation, and steps for a document's level within a round.
ROUNDS, STEPS = 4, 6

#: Labelled documents used, at most; beyond, those with the smallest hashes of their ids.
MAX_LABELS = 50_000

#: Documents a word must occur in to be in the model.
MIN_DOCUMENTS = 2

MIN_WORDS = 40

#: Distinct words of all documents of a block, at most; a longer document is a block by itself.
BLOCK_TERMS = 250_000

#: Half the distance between the two steps common to all words.
STEP = 1.0

_SMOOTH_WORD, _SMOOTH_DOCUMENT = 0.05, 0.5

_LEVELS = np.linspace(-15, 15, 3001)

_BLOCKS = "block string, doc_ids array<bigint>, n_words array<int>, lengths array<int>, wide int, ids binary, counts binary, words array<string>, n_documents array<int>"


def _pack(values: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers as differences in the narrowest type that holds them, compressed; and the bytes per number."""
    size = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    narrow = values.astype(f"u{size}")
    return pa.compress(np.diff(narrow, prepend=narrow.dtype.type(0)).tobytes(), "zstd", asbytes=True), size


def _unpack(data: bytes, size: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), f"u{size}")
    return np.cumsum(raw, dtype=raw.dtype).astype(np.int64)


def _block(name: str, docs: list[tuple[int, int, Counter]]) -> dict:
    found: dict[str, int] = {}
    lengths, ids, counts = [], [], []
    for _, _, tally in docs:
        own = np.array([found.setdefault(w, len(found)) for w in tally], np.int64)
        at = np.argsort(own)
        lengths.append(len(own))
        ids.append(own[at])
        counts.append(np.fromiter(tally.values(), np.int64, len(tally))[at])
    flat, many = np.concatenate(ids), np.concatenate(counts)
    (packed, a), (tallied, b) = _pack(flat), _pack(many)
    return {"block": name, "doc_ids": [d for d, _, _ in docs], "n_words": [n for _, n, _ in docs], "lengths": lengths, "wide": 8 * a + b, "ids": packed, "counts": tallied, "words": list(found), "n_documents": np.bincount(flat, minlength=len(found)).tolist()}


def prose_blocks(documents: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """English documents with enough running prose, from the whole texts, in blocks: who they are, how many words each has, and which words how often."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    kinds = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("wide", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.string())), ("n_documents", pa.list_(pa.int32()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n, docs, terms = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = prose.words(text.as_py())
                if len(words) < MIN_WORDS or not prose.is_english(tally := Counter(words)):
                    continue
                if docs and terms + len(tally) > block_terms:
                    yield pa.RecordBatch.from_pylist([_block(f"{partition}-{n}", docs)], schema=kinds)
                    n, docs, terms = n + 1, [], 0
                docs.append((doc_id, len(words), tally))
                terms += len(tally)
        if docs:
            yield pa.RecordBatch.from_pylist([_block(f"{partition}-{n}", docs)], schema=kinds)

    assert kinds.names == names
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(extract, _BLOCKS)


def known_bands(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``band``: the mean of the raters' distinct valid bands, rounded; undecided documents are left out."""
    valid = labels.where(F.col("band").between(1, BANDS) & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), "band").distinct()
    mean = valid.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("band").alias("m"))
    return mean.where(F.abs(F.col("m") - F.floor("m") - 0.5) > 1e-9).select("doc_id", F.round("m").cast("int").alias("band"))


def _shares(level: np.ndarray) -> np.ndarray:
    """Shares of the bands at given levels (bands x levels), without regard to words."""
    e = np.stack([np.zeros_like(level), level + STEP, 2 * level])
    e = np.exp(e - e.max(0))
    return e / e.sum(0)


_MEAN_BAND = np.arange(BANDS) @ _shares(_LEVELS)


def _fit_levels(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, rates: np.ndarray, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Level per document and the bands of the occurrences, for given word rates (words x bands).

    Words without a rate (NaN) count for nothing; a document of such words alone keeps the level 0.
    """
    there = lengths > 0
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][there]
    size = lengths[there]
    known = ~np.isnan(rates[:, 0])
    own = [np.where(known, rates[:, k], 1.0)[ids] for k in range(BANDS)]
    n = np.where(known[ids], counts, 0.0)
    held = np.add.reduceat(n, starts) if len(starts) else np.zeros(0)
    level, weights = np.zeros(len(size)), [np.zeros(len(ids))] * BANDS
    for _ in range(steps if len(starts) else 0):
        weights = [np.repeat(p, size) * r for p, r in zip(_shares(level), own)]
        scale = n / (weights[0] + weights[1] + weights[2])
        for w in weights:
            w *= scale
        mean = sum(k * np.add.reduceat(weights[k], starts) for k in range(1, BANDS))
        level = np.interp((mean + _SMOOTH_DOCUMENT) / (held + _SMOOTH_DOCUMENT), _MEAN_BAND, _LEVELS)
    out = np.zeros(len(lengths))
    out[there] = level
    return out, weights


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a batch: the row, word of each term, its count, and terms per document."""
    for row in range(len(batch)):
        at = {c: batch.column(c)[row] for c in batch.schema.names}
        lengths = at["lengths"].values.to_numpy(zero_copy_only=False).astype(np.int64)
        n, wide = int(lengths.sum()), at["wide"].as_py()
        yield at, _unpack(at["ids"].as_py(), wide // 8, n), _unpack(at["counts"].as_py(), wide % 8, n).astype(float), lengths


def _rates_of(at: dict) -> np.ndarray:
    """Rates of a block's words; NaN for those not in the model."""
    rates = np.full((len(at["words"].values), BANDS), np.nan)
    sent = at["rates"].values
    if sent is not None and len(sent):
        rates[sent.field("pos").to_numpy()] = np.stack([sent.field(f"r{k}").to_numpy() for k in range(BANDS)], 1)
    return rates


def _sums(blocks: DataFrame, start: dict[int, int] | None = None) -> DataFrame:
    """Occurrences of every word by band: at the known bands of documents (``start``), or at the fitted levels for the rates the blocks carry."""
    kinds = pa.schema([("word", pa.string()), *[(f"s{k}", pa.float64()) for k in range(BANDS)]])
    known = blocks.sparkSession.sparkContext.broadcast(start) if start is not None else None  # MAX_LABELS entries

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, counts, lengths in _rows(batch):
                if known is not None:
                    band = np.repeat([known.value.get(d.as_py(), 0) for d in at["doc_ids"].values], lengths)
                    weights = [counts * (band == k + 1) for k in range(BANDS)]
                else:
                    weights = _fit_levels(ids, counts, lengths, _rates_of(at), STEPS)[1]
                words = at["words"].values
                sums = [np.bincount(ids, w, len(words)) for w in weights]
                here = pa.array(sum(sums) > 0)
                yield pa.RecordBatch.from_arrays([words.filter(here), *[pa.array(s).filter(here) for s in sums]], schema=kinds)

    return blocks.mapInArrow(add, "word string, " + ", ".join(f"s{k} double" for k in range(BANDS))).groupBy("word").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(BANDS)])


def _send_rates(blocks: DataFrame, needed: DataFrame, vocabulary: DataFrame, sums: DataFrame) -> DataFrame:
    """Blocks with ``rates`` of their own words."""
    smooth = [F.coalesce(f"s{k}", F.lit(0.0)) + _SMOOTH_WORD for k in range(BANDS)]
    counted = cut(vocabulary.select("word").join(sums, "word", "left").select("word", *[s.alias(f"s{k}") for k, s in enumerate(smooth)]))
    total = counted.agg(*[F.sum(f"s{k}") for k in range(BANDS)]).first()
    rates = counted.select("word", *[(F.col(f"s{k}") / F.lit(float(total[k] or 1.0))).alias(f"r{k}") for k in range(BANDS)])
    # One list per block, as long as its own vocabulary at most.
    sent = needed.join(rates, "word").groupBy("block").agg(F.collect_list(F.struct("pos", *[f"r{k}" for k in range(BANDS)])).alias("rates"))
    return blocks.join(sent, "block", "left")


def _score(blocks: DataFrame) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("theta", pa.float64()), *[(f"p{k + 1}", pa.float64()) for k in range(BANDS)]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, counts, lengths in _rows(batch):
                level = _fit_levels(ids, counts, lengths, _rates_of(at), 3 * STEPS)[0]
                yield pa.RecordBatch.from_arrays([at["doc_ids"].values, at["n_words"].values, pa.array(level), *map(pa.array, _shares(level))], schema=kinds)

    return blocks.mapInArrow(score, "doc_id bigint, n_words int, theta double, " + ", ".join(f"p{k + 1} double" for k in range(BANDS)))


def choose_limits(theta: np.ndarray, band: np.ndarray, histogram: np.ndarray, low: float = 1.0, high: float = float(BANDS), slack: float = 0.01) -> list[float]:
    """Limits between the bands on a scale from ``low`` to ``high``.

    For each pair of neighbouring bands the limits that tell their known documents apart best, give or take
    ``slack`` of the documents, and among those the one with the fewest documents around it in ``histogram``.
    """
    edges = np.linspace(low, high, len(histogram) + 1)[1:-1]
    smooth = np.convolve(histogram, np.ones(5) / 5, "same")
    around = (smooth[:-1] + smooth[1:]) / 2
    limits = []
    for k in range(1, BANDS):
        at = (band == k) | (band == k + 1)
        if not at.any():
            limits.append((low + high) / 2 + (k - BANDS / 2) * (high - low) / (BANDS - 1))
            continue
        right = np.array([((theta[at] > e) == (band[at] == k + 1)).mean() for e in edges])
        good = np.flatnonzero(right >= right.max() - slack)
        limits.append(float(edges[good[np.argmin(around[good])]]))
    return limits


def _banded(levels: DataFrame, on: str, labelled: DataFrame, low: float, high: float) -> DataFrame:
    """``levels`` with ``band``, by limits on column ``on`` between ``low`` and ``high``."""
    places = 200
    bucket = F.least(F.lit(places - 1), F.greatest(F.lit(0), F.floor((F.col(on) - low) / (high - low) * places))).cast("int")
    histogram = np.zeros(places)
    for at, n in levels.groupBy(bucket.alias("at")).count().collect():  # 200 rows
        histogram[at] = n
    judged = levels.join(broadcast_if_small(labelled), "doc_id").select(on, "band").toPandas()  # MAX_LABELS rows
    band = F.lit(1)
    for limit in choose_limits(judged[on].to_numpy(), judged["band"].to_numpy(), histogram, low, high):
        band = band + (F.col(on) > limit).cast("int")
    return levels.withColumn("band", band)


def _read(documents: DataFrame, labels: DataFrame, block_terms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of the documents, each id once (greatest text); vocabulary with ``n``, its documents; and the labelled documents in use."""
    once = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if not once.groupBy("doc_id").count().where("count > 1").isEmpty():
        once = once.groupBy("doc_id").agg(F.max("text").alias("text"))
    blocks = cut(prose_blocks(once, block_terms))
    counted = blocks.select(F.explode(F.arrays_zip("words", "n_documents")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.n_documents").alias("n"))
    ids = blocks.select(F.explode("doc_ids").alias("doc_id"))
    labelled = cut(known_bands(labels).join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(MAX_LABELS))
    return blocks, cut(counted.where(F.col("n") >= MIN_DOCUMENTS)), labelled


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Reading level of every English document with at least 40 words of running prose.

    :param documents: ``doc_id``, ``text``; rows with a null id are left out, a repeated id is taken once (greatest text)
    :param labels: ``doc_id``, ``rater``, ``band``; invalid bands and repeated rows are ignored
    :returns: ``doc_id``, ``n_words``, ``theta`` (the level in log odds), ``p1``, ``p2``, ``p3`` (shares of the bands at that level),
        ``level`` (their mean, 1 to 3), ``band``. A document none of whose words any other has is at level 0.
        Without any usable label the levels cannot be oriented: all are 0 and ``band`` is null.
    """
    blocks, vocabulary, labelled = _read(documents, labels, block_terms)
    start = {r.doc_id: r.band for r in labelled.collect()}  # MAX_LABELS rows
    if not start:
        equal = F.lit(1 / BANDS)
        texts = blocks.select(F.explode(F.arrays_zip("doc_ids", "n_words")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").alias("n_words"))
        return texts.select("doc_id", "n_words", F.lit(0.0).alias("theta"), equal.alias("p1"), equal.alias("p2"), equal.alias("p3"), F.lit((1 + BANDS) / 2).alias("level"), F.lit(None).cast("int").alias("band"))
    needed = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    light = blocks.drop("n_documents")
    sums = _sums(light, start)
    for _ in range(rounds):
        sums = cut(_sums(_send_rates(light, needed, vocabulary, sums)))
    levels = cut(_score(_send_rates(light, needed, vocabulary, sums))).withColumn("level", F.col("p1") + 2 * F.col("p2") + 3 * F.col("p3"))
    return _banded(levels, "level", labelled, 1.0, float(BANDS)).select("doc_id", "n_words", "theta", "p1", "p2", "p3", "level", "band")


#: Rounds of the dichotomous model, and places of a scale on which the other side's parameters are counted.
OCCURRENCE_ROUNDS, PLACES = 8, 512

_RANGE = 20.0


def _at(value: Column, points: np.ndarray, scale: np.ndarray) -> Column:
    """Places of ``value`` on a scale, between its ``points``."""

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x.to_numpy(float), points, scale))

    return place(value)


def occurrence_levels(documents: DataFrame, labels: DataFrame, rounds: int = OCCURRENCE_ROUNDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The dichotomous Rasch model over the same documents: log odds(word occurs in document) = level[d] - difficulty[w].

    Alternating steps: a document's level is where as many words are expected to occur in it as do, given the
    difficulties; a word's difficulty is where as many documents are expected to have it as do. Both depend on
    their count alone, so each side is a table of counts, and what the other side needs of it is its distribution over 512 places.

    :returns: ``doc_id``, ``score`` (vocabulary words that occur), ``level`` (log odds), ``band`` (null without usable labels)
    """
    blocks, vocabulary, labelled = _read(documents, labels, block_terms)
    pairs = blocks.select("block", F.posexplode("words").alias("pos", "word")).join(vocabulary.select("word"), "word", "left_semi")
    kept = blocks.select("block", "doc_ids", "lengths", "wide", "ids", "counts", "words").join(pairs.groupBy("block").agg(F.collect_list("pos").alias("known")), "block", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, _, lengths in _rows(batch):
                known = np.zeros(len(at["words"].values))
                if at["known"].values is not None:
                    known[at["known"].values.to_numpy()] = 1
                ends = np.cumsum(lengths)
                upto = np.concatenate([[0], np.cumsum(known[ids])])
                yield pa.RecordBatch.from_arrays([at["doc_ids"].values, pa.array((upto[ends] - upto[ends - lengths]).astype(np.int64))], names=["doc_id", "score"])

    scores = cut(kept.mapInArrow(count, "doc_id bigint, score bigint"))
    sides = [cut(x.groupBy(F.col(c).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))) for x, c in ((scores, "score"), (vocabulary, "n"))]
    scale = np.linspace(-_RANGE, _RANGE, PLACES)
    chance = 1 / (1 + np.exp(-(scale[:, None] - scale[None, :])))
    # Of documents and words: how many stand at each place of the scale; at first all difficulties are 0.
    held = [np.zeros(PLACES), np.zeros(PLACES)]
    held[1][PLACES // 2] = vocabulary.count()
    points = [np.zeros(PLACES), np.zeros(PLACES)]
    for turn in range(2 * rounds - 1):
        side = turn % 2
        expected = chance @ held[1] if side == 0 else chance.T @ held[0]  # rising for levels, falling for difficulties
        points[side], own = (expected, scale) if side == 0 else (expected[::-1], scale[::-1])
        place = F.round((_at(F.col("score"), points[side], own) + _RANGE) / (2 * _RANGE) * (PLACES - 1)).cast("int")
        held[side] = np.zeros(PLACES)
        for at, n in sides[side].groupBy(place.alias("at")).agg(F.sum("n")).collect():  # 512 rows
            held[side][at] = n
    levels = cut(scores.withColumn("level", _at(F.col("score"), points[0], scale)))
    if labelled.isEmpty():
        return levels.withColumn("band", F.lit(None).cast("int"))
    low, high = levels.agg(F.min("level"), F.max("level")).first()
    return _banded(levels, "level", labelled, low, max(high, low + 1e-6))
