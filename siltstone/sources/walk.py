"""File scans: pruned directories, include and exclude lists, the skip cascade, languages, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V


def in_ignored_dir(path: Column) -> Column:
    """Whether a directory above the file is one that is never walked."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(V.IGNORED_DIRS) | d.endswith(".egg-info"))


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether path is one of the prefixes or below it, part by part."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.concat(path, F.lit("/")).startswith(p.rstrip("/") + "/")
    return found


def has_nul(content: Column) -> Column:
    return F.locate("\0", F.substring(content, 1, V.SNIFF_BYTES)) > 0


def skip_reason(path: Column, size: Column, content: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Why a file isn't indexed; null if it is. The first reason that applies."""
    name = X.name(path)
    suffix = F.lit(False)
    for s in V.IGNORED_SUFFIXES:
        suffix = suffix | name.endswith(s)
    chain = F.when(F.lit(bool(include)) & ~under(path, list(include)), "outside include list").when(under(path, list(exclude)), "user excluded")
    return (
        chain.when(name.isin(V.IGNORED_NAMES), "ignored filename").when(suffix, "ignored extension").when(X.language_of(name) == "unknown", "unknown extension")
        .when(size.isNull(), "stat failed").when(size == 0, "empty file").when(size > V.MAX_FILE_BYTES, "too large").when(has_nul(content), "binary")
    )


def load(files: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """files (path, size_bytes, content as bytes) that are walked, with language, skip_reason and text (null if skipped)."""
    walked = files.where(~in_ignored_dir(F.col("path")))
    reason = skip_reason(F.col("path"), F.col("size_bytes"), F.col("content"), include, exclude)
    rows = walked.withColumn("skip_reason", F.coalesce(reason, F.when(~F.is_valid_utf8(F.col("content").cast("string")), "decode error")))
    return rows.select("path", X.language_of(X.name(F.col("path"))).alias("language"), "size_bytes", "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("content").cast("string")).alias("text"))


def file_slice(content: Column, start: Column, end: Column, context: int = 3, most: int = 2000) -> Column:
    """Lines from start - context to end + context, clamped to the file and to `most` lines; null past its end."""
    lines = X.lines(content)
    n = F.size(lines)
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, n, first + (most - 1))
    return F.when(start <= n, F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))
