"""Many repositories in one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Settings
from .rows import with_repo_prefix

#: Order of a cluster's rows: repositories by name without regard to case, markers before files, files as discovered.
CLUSTER_ORDER = ("repo_order", "seq", "ord")


def cluster_order() -> list[Column]:
    return [F.col(c) for c in CLUSTER_ORDER]


def with_markers(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """rows of all repositories with their prefix in display, and before each repository's files a marker row with its name.

    Adds repo_order (from 1) and seq (0 for a marker). The first marker is '# name', later ones stand between separator lines.
    """
    repos = rows.select("repo").distinct()
    number = F.row_number().over(Window.partitionBy().orderBy(F.upper("repo"), "repo")).cast("long")
    repos = repos.select("repo", number.alias("repo_order"))
    files = with_repo_prefix(rows).join(repos, "repo").withColumn("seq", F.lit(1))
    if not settings.cluster_headers:
        return files
    name = F.concat(F.lit("# "), F.regexp_extract("repo", "([^/]*)$", 1))
    text = F.when(F.col("repo_order") == 1, name).otherwise(F.concat(F.lit(settings.cluster_separator + "\n"), name, F.lit("\n" + settings.cluster_separator)))
    given = {"repo": F.col("repo"), "kind": F.lit("marker"), "display": F.concat(F.lit("["), F.col("repo"), F.lit("]")), "content": text, "size": F.octet_length(text).cast("long"), "ord": F.lit(0).cast("long"), "repo_order": F.col("repo_order"), "seq": F.lit(0)}
    kinds = {f.name: f.dataType for f in files.schema}
    markers = repos.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in files.columns])
    return files.unionByName(markers)


def with_errors(rows: DataFrame, fail_fast: bool = False) -> DataFrame:
    """rows; with fail_fast, computing one that has an error fails the job, as opposed to showing it in its place."""
    if not fail_fast:
        return rows
    return rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", F.lit("a repository failed"), "repo", "error")).cast("boolean")).otherwise(True))
