"""Paths and tokens inside messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# First token that starts with a slash; Unicode white space separates tokens.
FIRST_PATH = r"(?U)(?:^|\s)(/\S*)"


def clean_path(path: Column) -> Column:
    """Lexically shortest form of an absolute path (``//``, ``.``, ``..`` and a trailing ``/`` resolved)."""
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part != "..", F.concat(done, F.array(part)))
        .when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.array().cast("array<string>")),
    )
    # Nearly all paths are clean already and skip the array work.
    suspect = path.contains("//") | path.contains("/.") | path.endswith("/")
    return F.when(suspect, F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(path)


def extract_path(message: Column) -> Column:
    """The first absolute path in a message, cleaned; empty text when there is none."""
    return clean_path(F.regexp_extract(message, FIRST_PATH, 1))


def path_depth(path: Column) -> Column:
    """Number of steps below the root, of a clean path."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "/", F.lit(0)).otherwise(slashes)


def path_prefix(path: Column, depth: Column) -> Column:
    """The ancestor of a clean path at a depth of 0 (the root) to its own."""
    return F.when(depth == 0, F.lit("/")).otherwise(F.call_function("substring_index", path, F.lit("/"), depth + 1))


def path_prefixes(path: Column) -> Column:
    """``/a``, ``/a/b``, ... up to the clean path itself; empty for the root and for no path."""
    depth = path_depth(path)
    return F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: path_prefix(path, n))
    ).otherwise(F.array().cast("array<string>"))


def path_name(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(F.substring_index(path, "/", -1))


def path_parent(path: Column) -> Column:
    """Parent directory of a clean path; null for the root."""
    above = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path != "/", F.when(above == "", F.lit("/")).otherwise(above))


def leading_token(message: Column) -> Column:
    """Text before the first space character; empty when there is no space."""
    return F.when(F.instr(message, " ") > 0, F.substring_index(message, " ", 1)).otherwise(F.lit(""))


def under_path(path: Column, target: str) -> Column:
    """True for the target itself and everything below it."""
    return (path == target) | path.startswith(target.rstrip("/") + "/")
