"""Where trees, traces, rules and sessions come from."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphmill.functions.names import SEVERITY, TIERS, named_scope
from graphmill.operators.resolve import Rule


def blob_id(content: Column) -> Column:
    """Content address of bytes as version control computes it."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), content))


def read_tree(spark: SparkSession, root: str, rev: str = "WORKTREE", skip: Sequence[str] = (".git", ".graphmill")) -> DataFrame:
    """``rev``, ``path``, ``blob_sha``, ``content`` of the Python files below a folder; hidden stores are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(F.lit(rev).alias("rev"), inside.alias("path"), blob_id(F.col("content")).alias("blob_sha"), F.decode("content", "utf-8").alias("content"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))


def overlay(head: DataFrame, status: DataFrame) -> DataFrame:
    """A tree with local changes: ``status`` has ``path`` and the new ``blob_sha``, null where a path is gone."""
    return head.join(status.select("path"), "path", "left_anti").select("path", "blob_sha").unionByName(status.where("blob_sha is not null").select("path", "blob_sha"))


class _CommitPartition(InputPartition):
    def __init__(self, rev: str) -> None:
        self.rev = rev


class _GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.revs = options["path"], options["revs"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_CommitPartition(r) for r in self.revs]

    def read(self, partition: _CommitPartition):
        out = subprocess.run(["git", "-C", self.root, "ls-tree", "-r", "-z", partition.rev], capture_output=True, check=True).stdout
        for entry in filter(None, out.decode("utf-8", "surrogateescape").split("\0")):
            meta, _, path = entry.partition("\t")
            _, kind, sha = meta.split()
            if kind == "blob" and path.endswith(".py"):
                yield partition.rev, path, sha


class GitTree(DataSource):
    """``spark.read.format("git_tree").option("revs", "a,b").load(root)``: the Python files of commits, one partition per commit."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "rev string, path string, blob_sha string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GitReader(self.options)


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observed calls (``src``, ``dst``) and executed symbols (``id``) of a recorded run; unnamed scopes count for what encloses them."""
    raw = spark.read.schema("root string, edges array<array<string>>, indirect array<array<string>>, executed array<string>").option("multiLine", "true").json(path)
    known = lambda x: F.concat(F.substring_index(x, "::", 1), F.lit("::"), F.coalesce(named_scope(F.regexp_extract(x, r"::(.*)$", 1)), F.lit("<module>")))
    calls = raw.select(F.explode(F.concat(F.coalesce("edges", F.array()), F.coalesce("indirect", F.array()))).alias("e")).select(known(F.get("e", F.lit(0))).alias("src"), F.get("e", F.lit(1)).alias("dst"))
    return calls.where("src != dst and dst is not null").distinct(), raw.select(F.explode("executed").alias("x")).select(known(F.col("x")).alias("id")).distinct()


def read_rules(path: str) -> list[Rule]:
    """Effect rules of a project, ``[[effect]]`` tables with ``match``, ``kind`` and maybe ``confidence``; they override built-in ones."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("effect", [])
    for x in found:
        if x.get("kind") not in SEVERITY or x.get("confidence", "LOW") not in TIERS or not x.get("match"):
            raise ValueError(f"no valid effect rule: {x}")
    return [Rule(x["match"], x["kind"], x.get("confidence"), override=True) for x in found]


def session_trailers(messages: DataFrame) -> DataFrame:
    """``commit``, ``sessions``: the values of ``Session:`` lines in each message, in order, without repeats."""
    found = F.expr(r"regexp_extract_all(message, r'(?m)^Session:[ \t]*(\S[^\n]*?)[ \t]*$', 1)")
    return messages.select("commit", F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))).alias("sessions"))
