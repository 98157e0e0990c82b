"""Expressions over paths, modules, qualified names and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers of confidence, weakest first, and the weights of their ranks.
TIERS = ("LOW", "MEDIUM", "HIGH")
TIER_WEIGHTS = (0.25, 0.6, 1.0)

# Link kinds in the order that breaks ties.
EDGE_KINDS = ("CALLS", "INHERITS", "IMPLEMENTS", "REFERENCES")

# Effect kinds, worst first.
SEVERITY = ("DB_WRITE", "NETWORK", "PROCESS", "FS_WRITE", "GLOBAL_MUTATE", "DB_READ", "FS_READ", "ENV_READ", "NONDETERMINISM")

# Scopes without a name of their own.
ANONYMOUS = ("<genexpr>", "<listcomp>", "<setcomp>", "<dictcomp>", "<lambda>")


def position(value: Column, order: Sequence[str]) -> Column:
    """0-based place of a value in a fixed order; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)).cast("int") - 1


def tier_rank(confidence: Column) -> Column:
    return position(confidence, TIERS)


def tier_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, TIERS)), rank)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def parent_scope(qualname: Column) -> Column:
    """Scope that directly encloses a qualified name, without a trailing ``<locals>``; null at the top level."""
    return F.nullif(F.regexp_replace(F.regexp_extract(qualname, r"^(.*)\.[^.]*$", 1), r"\.<locals>$", ""), F.lit(""))


def is_dunder(name: Column) -> Column:
    return name.rlike(r"^__.+__$") & (F.length(name) > 4)


def module_of_path(path: Column, roots: Sequence[str] = ()) -> Column:
    """Dotted module of a source path below the longest of the source roots that matches."""
    inner = path
    for root in sorted((r.strip("/") for r in roots if r), key=len):
        inner = F.when(F.startswith(path, F.lit(root + "/")), F.substr(path, F.lit(len(root) + 2))).otherwise(inner)
    return F.replace(F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def package_of_path(path: Column, module: Column) -> Column:
    """The module itself for a package's ``__init__``, else the part before the last dot ('' at the top)."""
    return F.when(path.rlike(r"(^|/)__init__\.py$"), module).otherwise(F.regexp_replace(module, r"\.?[^.]*$", ""))


def absolute_module(module: Column, level: Column, package: Column) -> Column:
    """Target of an import: ``level`` dots go up from the package; level 0 is absolute already."""
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - (level - 1), F.lit(0))), ".")
    return F.when(level == 0, module).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit(""))))


def under_source_root(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path lies below any of the source roots; the empty root holds everything."""
    out = F.lit(False)
    for root in roots:
        out = out | (F.lit(True) if not root.strip("/") else F.startswith(path, F.lit(root.strip("/") + "/")))
    return out


def is_test_path(path: Column) -> Column:
    """A test by its place: in a folder ``tests`` or ``test``, or by its file name."""
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)(conftest|test_[^/]*|[^/]*_test)\.py$")


def is_test_entry(path: Column, qualname: Column) -> Column:
    """What a test runner would collect: test functions, or test methods of test classes, in test files."""
    in_file = path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.py$")
    return in_file & (qualname.rlike(r"^test[^.]*$") | qualname.rlike(r"^Test[^.]*\.test[^.]*$"))


def named_scope(qualname: Column) -> Column:
    """Without trailing anonymous scopes and the ``<locals>`` before them; null if nothing is left."""
    anonymous = "|".join(x.strip("<>") for x in ANONYMOUS)
    return F.nullif(F.regexp_replace(qualname, rf"(?:(?:^|\.)(?:<locals>\.)?<(?:{anonymous})>)+$", ""), F.lit(""))


def literal_prefix_length(pattern: Column) -> Column:
    """Characters of a glob before its first wildcard."""
    return F.length(F.regexp_extract(pattern, r"^[^*?\[]*", 0))


def glob_regex(pattern: str) -> str:
    """Java regex of a glob: ``*``, ``?`` and ``[...]`` (``!`` negates)."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def salience(fan_in: Column, name: Column) -> Column:
    """0.5 for an entry point, 0.3 for a public name, and up to 0.5 for fan-in."""
    entry = F.when(fan_in == 0, 0.5).otherwise(0.0)
    public = F.when(F.startswith(name, F.lit("_")), 0.0).otherwise(0.3)
    return entry + public + F.least(fan_in, F.lit(10)) / 20.0


def impact_score(hop: Column, rank: Column, weight: Column) -> Column:
    return F.lit(1.0) / hop * F.get(F.array(*map(F.lit, TIER_WEIGHTS)), rank) * (F.lit(1.0) + weight)
