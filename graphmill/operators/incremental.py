"""What an edit can touch: fingerprints, dirty paths, signatures, and the part of the work that has to be redone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.names import last_segment
from graphmill.functions.text import plain_sha


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """A digest of a relation that depends neither on the order nor on the partitions of its rows; repeats count.

    Row hashes are added up and XORed, so every task sends three numbers.
    """
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns or rows.columns])
    g = F.xxhash64(h, F.lit(1))
    x = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(g, 24)).alias("s")).select(F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("f"))
    return x.first().f


def dirty_paths(stored: DataFrame, tree: DataFrame) -> DataFrame:
    """``path``, ``change`` (``added``, ``removed``, ``changed``) between two trees (``path``, ``blob_sha``)."""
    x = stored.select("path", F.col("blob_sha").alias("old")).join(tree.select("path", F.col("blob_sha").alias("new")), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return x.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def signatures(nodes: DataFrame, refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """What other texts can see of a text, as one hash: ``blob_sha``, ``signature`` over its symbols, bases and attributes of self."""
    h = lambda *c: F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in c])
    rows = nodes.select("blob_sha", h("qualname", "kind", "name_binding", "decorators").alias("h"))
    rows = rows.unionByName(refs.where("ref_kind = 'base'").select("blob_sha", h("from_qualname", "raw_name").alias("h")))
    rows = rows.unionByName(bindings.where("startswith(name, 'self.')").select("blob_sha", h("scope", "name", "kind", "type").alias("h")))
    return rows.distinct().groupBy("blob_sha").agg(F.bit_xor("h").alias("signature"))


def narrowable(changes: DataFrame, stored: DataFrame, tree: DataFrame, seen: DataFrame, traced: DataFrame | None = None) -> bool:
    """Whether only the dirty paths themselves have to be resolved again.

    True if no path came or went, every changed text looks the same from outside (``seen``: ``blob_sha``, ``signature``;
    texts without anything to see have no row), and no changed path carries a trace.
    """
    if not changes.where("change != 'changed'").isEmpty():
        return False
    if traced is not None and not changes.join(traced.select("path"), "path", "left_semi").isEmpty():
        return False
    old = changes.select("path").join(stored, "path").join(seen, "blob_sha", "left").select("path", F.col("signature").alias("old"))
    new = changes.select("path").join(tree, "path").join(seen, "blob_sha", "left").select("path", F.col("signature").alias("new"))
    return old.join(new, "path").where(~F.col("old").eqNullSafe(F.col("new"))).isEmpty()


def replace_paths(stored: DataFrame, redone: DataFrame, changes: DataFrame, path: Column | str = "path") -> DataFrame:
    """Rows of a per-path relation after an edit: the stored ones of clean paths and the ones made again."""
    key = F.col(path) if isinstance(path, str) else path
    kept = stored.withColumn("__p", key).join(changes.select(F.col("path").alias("__p")), "__p", "left_anti").drop("__p")
    return kept.unionByName(redone)


def dependents(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Paths that import any of some modules, or something in them: ``rev``, ``importer_path``.

    :param imports: ``rev``, ``importer_path``, ``module``; :param modules: ``rev``, ``module``
    """
    parts = F.split("module", r"\.")
    prefixes = imports.select("rev", "importer_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("module"))
    return prefixes.join(modules.select("rev", "module"), ["rev", "module"], "left_semi").select("rev", "importer_path").distinct()


def seed_revision(rows: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """A per-revision relation with the rows of one revision also, or only, under another name; what stood there goes."""
    kept = rows.where(F.col("rev") != target)
    copied = rows.where(F.col("rev") == source).withColumn("rev", F.lit(target)).select(*rows.columns)
    return (kept.where(F.col("rev") != source) if move else kept).unionByName(copied)


def drop_revision(rows: DataFrame, rev: str) -> DataFrame:
    return rows.where(~F.col("rev").eqNullSafe(F.lit(rev)))


def replace_blobs(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """A per-text relation after parsing again: all rows of the texts in ``parsed`` go, then the new ones come."""
    return stored.join(parsed.select("blob_sha").distinct(), "blob_sha", "left_anti").unionByName(parsed.select(*stored.columns))


def garbage(blobs: DataFrame, tree: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``blob_sha`` of the texts that no path of the revisions to keep holds; all of them if none is to be kept."""
    held = tree.where(F.col("rev").isin(*keep)) if keep else tree.where(F.lit(False))
    return blobs.select(plain_sha(F.col("blob_sha")).alias("blob_sha")).where("blob_sha is not null").distinct().join(held.select(plain_sha(F.col("blob_sha")).alias("blob_sha")), "blob_sha", "left_anti")


def set_meta(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """Settings (``key``, ``value``) with some of them set: a key that is there is replaced, another is added."""
    fresh = meta.sparkSession.createDataFrame(sorted(values.items()), "key string, value string")
    return meta.select("key", "value").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def propagation_inputs(edges: DataFrame, effects: DataFrame, unresolved: DataFrame) -> DataFrame:
    """All that the spread of effects depends on, as rows that can be fingerprinted: calls, direct effects, ambiguous names."""
    calls = edges.where("kind = 'CALLS'").select(F.lit("call").alias("what"), "src", "dst", F.col("confidence").alias("value")).distinct()
    direct = effects.select(F.lit("effect").alias("what"), F.col("id").alias("src"), F.col("effect").alias("dst"), F.col("rank").cast("string").alias("value")).distinct()
    open_ = unresolved.where("reason = 'ambiguous'").select(F.lit("name").alias("what"), "src", last_segment(F.col("raw_name")).alias("dst"), F.lit("").alias("value")).distinct()
    return calls.unionByName(direct).unionByName(open_)
