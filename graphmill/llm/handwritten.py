"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.text import plain_path, plain_sha
from graphmill.llm import layout
from graphmill.workspace import broadcast_if_small, cut

#: Limits by file extension; "" holds for all that a language doesn't set itself.
#: A text is minified if its punctuation stands without blanks (``tight``) or most names have
#: one or two letters, or if its lines are long, the longest and on average, and hardly a blank is in it; data, if most lines
#: hold only literals, if long encoded runs or numerals take up much of it, or if it is letters and digits with
#: hardly a blank; and without a header it is generated, if it is of some length and six line shapes make up most of it.
LIMITS: dict[str, dict[str, float]] = {
    "": {"tight": 0.8, "short_names": 0.55, "mean_line": 250, "max_line": 500, "space": 0.12, "alnum": 0.83, "literal_lines": 0.7, "encoded": 0.5, "number_density": 0.4, "repeat": 0.8, "repeat_lines": 24},
    "py": {"repeat": 0.73},
    "js": {"mean_line": 110, "max_line": 300, "short_names": 0.5},
    "mjs": {"mean_line": 110, "max_line": 300, "short_names": 0.5},
    "ts": {"mean_line": 110, "max_line": 300},
    "css": {"mean_line": 110, "max_line": 300, "tight": 0.9, "repeat": 0.97},
    "sql": {"repeat": 0.97, "literal_lines": 0.8},
}

#: Share of a text's lines that must stand in third-party definitions for a copy, and how many.
COPY_SHARE, COPY_LINES = 0.8, 5

_MEASURES = {"n_lines": "int", "max_line": "int", "mean_line": "double", "space": "double", "alnum": "double", "number_density": "double", "encoded": "double", "literal_lines": "double", "tight": "double", "short_names": "double", "repeat": "double", "generated_header": "boolean"}


def text_statistics(texts: DataFrame) -> DataFrame:
    """Layout statistics of every text of ``texts`` (``blob_sha``, ``content``), whole, whatever its length.

    ``blocks`` are hashes of its definitions with their lines. A null text counts as empty; of several different texts
    of a sha the one with the greatest hash counts, blank ones last. Texts are measured where they are read and never shuffled.
    """
    schema = "blob_sha string, content_hash bigint, " + ", ".join(f"{k} {t}" for k, t in _MEASURES.items()) + ", blocks array<struct<hash:bigint,lines:int>>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha, mark, text in zip(batch["blob_sha"], batch["content_hash"], batch["content"]):
                blocks = [{"hash": int.from_bytes(hashlib.blake2b(b.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True), "lines": n} for b, n in layout.code_blocks(text)]
                rows.append({"blob_sha": sha, "content_hash": mark, **layout.statistics(text), "blocks": blocks})
            yield pd.DataFrame(rows, columns=["blob_sha", "content_hash", *_MEASURES, "blocks"])

    content = F.coalesce("content", F.lit(""))
    known = texts.where(plain_sha(F.col("blob_sha")).isNotNull()).select(plain_sha(F.col("blob_sha")).alias("blob_sha"), F.xxhash64(content).alias("content_hash"), content.alias("content"))
    measured = cut(known.mapInPandas(measure, schema))
    if not measured.groupBy("blob_sha").count().where("count > 1").isEmpty():
        kept = [c for c in measured.columns if c != "blob_sha"]
        measured = cut(measured.groupBy("blob_sha").agg(F.max_by(F.struct(*kept), F.struct(F.col("n_lines") > 0, "content_hash")).alias("x")).select("blob_sha", "x.*"))
    return measured.drop("content_hash")


def _limit(extension: Column, name: str) -> Column:
    value = F.lit(float(LIMITS[""][name]))
    for language, limits in LIMITS.items():
        if language and name in limits:
            value = F.when(extension == language, float(limits[name])).otherwise(value)
    return value


def _on_vendor_path(path: Column) -> Column:
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    names = F.array(*map(F.lit, layout.VENDOR_SEGMENTS))
    return F.arrays_overlap(folders, names) | (F.get(folders, F.lit(0)).rlike(r"^third[_-]?party"))


def classify_files(tree: DataFrame, texts: DataFrame) -> DataFrame:
    """Every distinct (``path`` in plain spelling, ``blob_sha`` in lower case) of ``tree`` with its measures and ``verdict``.

    ``verdict`` is ``vendored``, ``generated``, ``minified``, ``data``, ``hand`` or ``empty``, decided in the order
    empty, vendored, generated, minified, data. Vendored are files under a folder of third-party code, and copies of such
    files elsewhere, whatever their header: at least 0.8 of the lines in definitions that also stand in third-party files. Who
    holds the copyright decides nothing. A text that ``texts`` lacks is judged by its path alone. Rows without path or
    sha are left out; empty tables give no rows.
    """
    files = tree.where(F.col("path").isNotNull() & plain_sha(F.col("blob_sha")).isNotNull()).select(plain_path(F.col("path")).alias("path"), plain_sha(F.col("blob_sha")).alias("blob_sha")).distinct()
    files = cut(files.withColumn("on_vendor_path", F.coalesce(_on_vendor_path(F.col("path")), F.lit(False))))
    measured = text_statistics(texts)

    foreign = files.where("on_vendor_path").select("blob_sha").distinct()
    of_text = measured.select("blob_sha", F.explode("blocks").alias("b")).select("blob_sha", "b.hash", "b.lines")
    known = cut(of_text.join(foreign, "blob_sha", "left_semi").select("hash").distinct())
    shared = of_text.join(broadcast_if_small(known).withColumn("there", F.lit(True)), "hash", "left").groupBy("blob_sha").agg(
        F.sum("lines").alias("in_blocks"), F.coalesce(F.sum(F.when(F.col("there"), F.col("lines"))), F.lit(0)).alias("in_foreign")
    )

    x = files.join(measured.drop("blocks"), "blob_sha", "left").join(shared, "blob_sha", "left")
    x = x.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z0-9]+)?$", 1))
    over = lambda name: F.col(name) >= _limit(F.col("extension"), name)
    copied = (F.col("in_foreign") >= COPY_SHARE * F.col("in_blocks")) & (F.col("in_foreign") >= COPY_LINES)
    regular = over("repeat") & (F.col("n_lines") >= _limit(F.col("extension"), "repeat_lines"))
    named = F.col("stem").rlike(layout.GENERATED_STEMS) & (F.col("repeat") >= 0.5)
    hardly_a_blank = F.col("space") < _limit(F.col("extension"), "space")
    dense = over("mean_line") & over("max_line") & hardly_a_blank
    data = over("literal_lines") | over("encoded") | over("number_density") | (over("alnum") & hardly_a_blank)
    minified = over("tight") | (over("short_names") & ~data) | dense
    verdict = (
        F.when(F.col("n_lines") == 0, "empty")
        .when(F.col("on_vendor_path") | copied, "vendored")
        .when(F.col("generated_header") | named, "generated")
        .when(minified, "minified")
        .when(data, "data")
        .when(regular, "generated")
        .otherwise("hand")
    )
    return x.select("path", "blob_sha", verdict.alias("verdict"), *[c for c in _MEASURES if not c.endswith("header")], "generated_header", "on_vendor_path", "in_blocks", "in_foreign")
