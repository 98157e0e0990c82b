"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequencies(occurrences: DataFrame, fields: list[str], record: str, term: str, place: list[str]) -> DataFrame:
    """``fields``, ``term``, ``n_occurrences``, ``n_records``.

    :param occurrences: one row per occurrence; rows that repeat the same (fields, record, term, place)
        count once. Rows with a null term or record are not counted.

    The rows are brought together by record, where repeats go and each record
    emits one count per term; these counts are combined map-side before they are
    shuffled by term, so a term that is everywhere arrives as one row per task.
    """
    known = occurrences.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    once = known.select(*fields, record, term, *place).repartition(record).groupBy(record, *fields, term, *place).agg(F.lit(1).alias("__one"))
    emitted = once.groupBy(record, *fields, term).agg(F.count(F.lit(1)).alias("__n"))
    return emitted.groupBy(*fields, term).agg(F.sum("__n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))


def frequency_mark(n_records: Column, total: int, rare_below: int = 3, common_from: float = 0.05) -> Column:
    """``rare`` in fewer than ``rare_below`` records, else ``common`` in at least that share of all, else null."""
    return F.when(n_records < rare_below, "rare").when(n_records >= common_from * total, "common")
