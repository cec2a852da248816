"""Path filters. All are expressions over the path, written cheap ones first, and touch no content: Spark applies them in
the scan, before a content column is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.globs import glob_match
from ..model import PRESETS, SYSTEM_IGNORE


@dataclass(frozen=True)
class PathRules:
    """What a path must and must not be; an empty tuple is no condition."""

    extensions: tuple[str, ...] = ()
    presets: tuple[str, ...] = ()
    system_ignore: tuple[str, ...] = SYSTEM_IGNORE
    exclude: tuple[str, ...] = ()
    exclude_path: tuple[str, ...] = ()
    include_path: tuple[str, ...] = ()
    search: tuple[str, ...] = ()

    def wanted(self) -> tuple[str, ...]:
        """The extensions and file names that are let through, of presets too."""
        named = [e for p in self.presets for e in PRESETS[p]]
        return tuple(dict.fromkeys(x.lower() for x in (*X.normalise_extensions(self.extensions), *named)))


def has_extension(path: Column, wanted: Iterable[str]) -> Column:
    """Whether the file's whole name or its extension is wanted (in any case); with nothing wanted, true."""
    wanted = list(wanted)
    if not wanted:
        return F.lit(True)
    name = F.lower(X.file_name(path))
    after = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    return name.isin(wanted) | ((after != "") & after.isin(wanted))


def under_search_path(path: Column, prefixes: Iterable[str]) -> Column:
    """Whether the path is one of the prefixes, lies under one, or has one as inner folders; with none, true."""
    cleaned = [p for p in (s.replace("\\", "/").strip().lower().removeprefix("./").strip("/") for s in prefixes) if p]
    if not cleaned:
        return F.lit(True)
    low = F.lower(X.slashes(path))
    out = F.lit(False)
    for p in cleaned:
        out = out | (low == p) | low.startswith(p + "/") | low.contains("/" + p + "/")
    return out


def _stages(path: Column, rules: PathRules) -> list[tuple[str, Column]]:
    """Name and condition of each rule that is set, in the order in which they decide."""
    out = []
    if rules.wanted():
        out.append(("extension", has_extension(path, rules.wanted())))
    for name, patterns in (("system_ignore", rules.system_ignore), ("exclude", rules.exclude), ("exclude_path", rules.exclude_path)):
        if patterns:
            out.append((name, ~glob_match(path, patterns)))
    if rules.include_path:
        out.append(("include_path", glob_match(path, rules.include_path)))
    if any(s.strip() for s in rules.search):
        out.append(("search_path", under_search_path(path, rules.search)))
    return out


def passes(path: Column, rules: PathRules) -> Column:
    out = F.lit(True)
    for _, condition in _stages(path, rules):
        out = out & condition
    return out


def explain(path: Column, rules: PathRules) -> Column:
    """The first rule that drops the path, or 'included'."""
    out = F.lit("included")
    for name, condition in reversed(_stages(path, rules)):
        out = F.when(~condition, F.lit(name)).otherwise(out)
    return out


def filter_paths(rows: DataFrame, rules: PathRules, path: str = "relative") -> DataFrame:
    """The rows whose path passes; markers always do."""
    marker = F.col("kind") == "marker" if "kind" in rows.columns else F.lit(False)
    return rows.where(marker | passes(F.col(path), rules))


#: From this limit on there is none: Spark would bring all rows, texts included, to one task to count them off.
NO_LIMIT = 1 << 30


def first_files(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows in the order in which they were discovered (Spark keeps the best of each partition only); all, in no order, from NO_LIMIT on."""
    if limit >= NO_LIMIT:
        return rows
    return rows.orderBy("repo", "ord", "relative").limit(limit) if "repo" in rows.columns else rows.orderBy("ord").limit(limit)
