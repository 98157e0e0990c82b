"""Text and path expressions; built-ins wherever Spark has them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blank characters of ASCII; trim() alone takes only the space.
ASCII_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()))


def normalized_names(df: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with ``target`` = ``source`` without surrounding blanks, in Unicode form NFC; rows with a null source go.

    Names of ASCII characters, nearly all, stay in the JVM; only the others pass
    through Python, in Arrow batches.
    """
    plain = ~F.col(source).rlike(r"[^\x00-\x7F]")
    known = df.where(F.col(source).isNotNull())
    blanks = F.lit(ASCII_BLANKS)
    return known.where(plain).withColumn(target, F.btrim(F.col(source), blanks)).unionByName(known.where(~plain).withColumn(target, _nfc(F.col(source))))


def plain_path(path: Column) -> Column:
    """Plain spelling: ``/`` between parts, no leading ``./``, no empty or ``.`` parts."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    # No slashes in excess and nothing to remove: the usual case, decided without an array.
    usual = ~path.rlike(r"\\|//|^/|/$|(^|/)\./|^\.$|/\.$")
    return F.when(usual, path).otherwise(F.array_join(kept, "/"))


def plain_sha(sha: Column) -> Column:
    """Lower case; null when empty."""
    return F.when(sha != "", F.lower(sha))
