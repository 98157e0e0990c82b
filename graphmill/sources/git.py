"""Reading a repository through its own program: contents by address, the state of the working tree, commits, revisions.

Lists of commits and of changed paths are as long as the history or the edit, and are read on the driver; contents are read where the
rows that ask for them are, one process per partition.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitError(RuntimeError):
    pass


def _run(root: str, *arguments: str, check: bool = True) -> str | None:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True)
    if done.returncode:
        if check:
            raise GitError(done.stderr.decode("utf-8", "replace").strip())
        return None
    return done.stdout.decode("utf-8", "surrogateescape")


def read_blobs(shas: DataFrame, root: str) -> DataFrame:
    """``blob_sha``, ``content`` (bytes) of the objects asked for (column ``blob_sha``), once each; those that do not exist are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for batch in batches:
                found = []
                for sha in batch["blob_sha"]:
                    process.stdin.write(sha.encode() + b"\n")
                    process.stdin.flush()
                    head = process.stdout.readline().split()
                    if len(head) != 3:
                        continue
                    content = process.stdout.read(int(head[2]))
                    process.stdout.read(1)
                    if head[1] == b"blob":
                        found.append((sha, content))
                yield pd.DataFrame(found, columns=["blob_sha", "content"])
        finally:
            process.stdin.close()
            process.wait()

    asked = shas.select(F.lower("blob_sha").alias("blob_sha")).where(F.col("blob_sha").rlike("^[0-9a-f]{7,64}$")).distinct()
    return asked.mapInPandas(read, "blob_sha string, content binary")


def status_paths(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``code`` of every path the working tree changes; the old path of a rename is ``D``, that of a copy is not listed."""
    parts = iter(_run(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0"))
    rows = []
    for entry in parts:
        if not entry:
            continue
        code, path = entry[:2].strip(), entry[3:]
        rows.append((path, code))
        if code[:1] in ("R", "C"):
            old = next(parts)
            if code[:1] == "R":
                rows.append((old, "D"))
    return spark.createDataFrame(rows, "path string, code string")


def first_parent_log(spark: SparkSession, root: str, base: str | None, head: str = "HEAD") -> DataFrame:
    """``ord`` (0 is the oldest), ``sha``, ``parent`` ('' for a root), ``subject`` of the commits after ``base`` up to ``head`` along first parents."""
    out = _run(root, "log", "--first-parent", "--reverse", "-z", "--format=%H%x1f%P%x1f%s", f"{base}..{head}" if base else head)
    rows = []
    for i, entry in enumerate(filter(None, out.split("\0"))):
        sha, parents, subject = entry.strip("\n").split("\x1f", 2)
        rows.append((i, sha, parents.partition(" ")[0], subject))
    return spark.createDataFrame(rows, "ord int, sha string, parent string, subject string")


def commit_messages(spark: SparkSession, root: str, revspec: str = "HEAD") -> DataFrame:
    """``commit``, ``message`` of the commits of a revision or range, for :func:`graphmill.sources.files.session_trailers`."""
    out = _run(root, "log", "-z", "--format=%H%x1f%B", revspec)
    return spark.createDataFrame([tuple(x.strip("\n").split("\x1f", 1)) for x in filter(None, out.split("\0"))], "commit string, message string")


def is_repo(root: str) -> bool:
    return _run(root, "rev-parse", "--git-dir", check=False) is not None


def rev_parse(root: str, rev: str) -> str:
    """The commit a name stands for."""
    return _run(root, "rev-parse", "--verify", "--quiet", f"{rev}^{{commit}}").strip()


def merge_base(root: str, one: str, other: str) -> str | None:
    out = _run(root, "merge-base", one, other, check=False)
    return out.strip() if out else None


def default_branch(root: str) -> str | None:
    """The first that exists of the branch the remote calls its head, ``main`` and ``master``."""
    for name in ("origin/HEAD", "main", "master"):
        if _run(root, "rev-parse", "--verify", "--quiet", name, check=False):
            return name
    return None
