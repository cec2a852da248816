"""File rows: what the engine knows of a file, from a path and (for tables) its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def file_rows(
    source: DataFrame, path: Column, ord: Column, content: Column | None = None, size: Column | None = None, repo: Column | None = None, root: str = "",
    display: Column | None = None, error: Column | None = None, languages: dict[str, str] | None = None,
) -> DataFrame:
    """One row per file in the canonical schema. size is the content's bytes where not given, -1 if neither is known."""
    text = F.lit(None).cast("string") if content is None else content.cast("string")
    bytes_ = F.coalesce((F.octet_length(text) if size is None else size).cast("long"), F.lit(-1).cast("long"))
    relative = X.relative_path(path, root) if root else X.slashes(path)
    out = source.select(
        ord.cast("long").alias("ord"), (F.lit("") if repo is None else repo).cast("string").alias("repo"), F.lit("file").alias("kind"), F.lit(root).alias("root"), relative.alias("relative"),
        (F.lit(None) if display is None else display).cast("string").alias("__display"), X.extension(path).alias("extension"), X.language(path, languages).alias("language"),
        bytes_.alias("size"), text.alias("content"), (F.lit(None) if error is None else error).cast("string").alias("error"),
    )
    shown = X.display_path(F.col("__display"), F.col("relative"), F.col("root"))
    return out.select("ord", "repo", "kind", "root", "relative", shown.alias("display"), "extension", "language", "size", "content", "error")


def with_repo_prefix(rows: DataFrame) -> DataFrame:
    """display as repo/relative, for rows that come from several repositories."""
    return rows.withColumn("display", F.when(F.col("repo") != "", F.concat_ws("/", "repo", "relative")).otherwise(F.col("display")))
