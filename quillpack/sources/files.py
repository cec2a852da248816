"""Files of folders and git repositories.

Names are listed on the driver (a listing is small next to the files); contents are read by the executors, from the path alone,
so the folder must be one that they share. A file that can't be read is a row with an error.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import REPO_SKIP, WALK_SKIP, Settings
from ..operators.rows import file_rows


class DiscoveryError(RuntimeError):
    """A folder can't be listed in the way asked for."""


def _git(root: str, *args: str) -> bytes:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError as e:
        raise DiscoveryError(f"git can't be run: {e}") from None
    if done.returncode:
        raise DiscoveryError(done.stderr.decode(errors="replace").strip() or "git failed")
    return done.stdout


def git_files(root: str, max_depth: int | None = None) -> list[str]:
    """Tracked and untracked files that git doesn't ignore, relative to root; with max_depth, at most that many folders deep."""
    if not os.path.exists(os.path.join(root, ".git")):
        raise DiscoveryError(f"no git repository: {root}")
    names = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "replace").split("\0")
    return [n for n in names if n and (max_depth is None or n.count("/") <= max_depth)]


def walk_files(root: str, max_depth: int | None = None, follow_symlinks: bool = False, skip: tuple[str, ...] = WALK_SKIP) -> list[str]:
    """Files under root, breadth first, relative to it; skipped folders, unreadable ones and (unless followed) linked ones are not entered, none twice."""
    skipped = {s.lower() for s in skip}
    queue, seen, out = [(root, "", 0)], {os.path.realpath(root)}, []
    while queue:
        folder, prefix, depth = queue.pop(0)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                is_folder = e.is_dir()
                linked = e.is_symlink()
            except OSError:
                continue
            if not is_folder:
                out.append(prefix + e.name)
            elif e.name.lower() not in skipped and (follow_symlinks or not linked) and (max_depth is None or depth < max_depth):
                real = os.path.realpath(e.path)
                if real not in seen:
                    seen.add(real)
                    queue.append((e.path, f"{prefix}{e.name}/", depth + 1))
    return out


def discover(root: str, settings: Settings = Settings()) -> list[str]:
    """Paths relative to root: by git ('git'), by git if that works ('auto'), or by a walk (anything else)."""
    if settings.discovery == "git":
        return git_files(root, settings.max_depth)
    if settings.discovery == "auto":
        try:
            return git_files(root, settings.max_depth)
        except DiscoveryError:
            pass
    return walk_files(root, settings.max_depth, settings.follow_symlinks)


def changed_files(root: str, ref: str) -> list[str]:
    """Files that differ from a git revision, deleted ones too."""
    if not ref.strip() or ref.strip().startswith("-"):
        raise DiscoveryError(f"no revision: {ref!r}")
    names = _git(root, "diff", "--name-only", ref.strip(), "--").decode("utf-8", "replace").splitlines()
    return [n.strip().replace("\\", "/") for n in names if n.strip()]


def changed_since(old: DataFrame, new: DataFrame, path: str = "relative", content: str = "content") -> DataFrame:
    """The rows of new whose path or content is not in old: the same question for tables.

    Paths and hashes are compared first; contents of new take part only where the list of changed paths is joined to them.
    """

    def digest() -> Column:
        return F.sha2(F.coalesce(F.col(content), F.lit("")), 256)

    seen = old.select(F.col(path).alias("__p"), digest().alias("__h"))
    keyed = new.withColumn("__sha", digest())
    changed = keyed.select(F.col(path).alias("__path"), F.col("__sha").alias("__new")).distinct()
    changed = changed.join(seen, (F.col("__path") == F.col("__p")) & (F.col("__new") == F.col("__h")), "left_anti")
    return keyed.join(changed, F.col(path).eqNullSafe(F.col("__path")) & (F.col("__sha") == F.col("__new")), "left_semi").drop("__sha")


def find_repos(root: str, max_depth: int = 2, skip: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(path, path relative to root, name) of each git repository; none is searched for others inside it."""
    skipped = {s.lower() for s in (*REPO_SKIP, *skip)} - {".git"}
    out, seen = [], set()

    def visit(folder: str, depth: int) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        if os.path.exists(os.path.join(folder, ".git")):
            relative = os.path.relpath(folder, root).replace(os.sep, "/")
            out.append((folder, "" if relative == "." else relative, os.path.basename(os.path.abspath(folder))))
            return
        if depth >= max_depth:
            return
        try:
            names = sorted(e.name for e in os.scandir(folder) if e.is_dir())
        except OSError:
            return
        for name in names:
            if name.lower() not in skipped and (not name.startswith(".") or name == ".github"):
                visit(os.path.join(folder, name), depth + 1)

    visit(root, 0)
    return sorted(out, key=lambda r: (r[1].upper(), r[1]))


_LISTED = T.StructType([T.StructField("ord", T.LongType()), T.StructField("repo", T.StringType()), T.StructField("root", T.StringType()), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])


def _listing(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _LISTED)


def decode_text(raw: bytes) -> str:
    """Text of UTF-8 bytes, without a byte order mark; invalid parts become replacement characters."""
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def read_contents(listed: DataFrame, max_file_size: int) -> DataFrame:
    """listed with size (-1 if unknown), content and error; files above max_file_size are not read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, contents, errors = [], [], []
            for root, path, error in zip(batch["root"], batch["path"], batch["error"], strict=True):
                size, content = -1, None
                if not error:
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            size = os.fstat(f.fileno()).st_size
                            if size <= max_file_size:
                                content = decode_text(f.read())
                    except OSError as e:
                        error = e.strerror or "can't be read"
                sizes.append(size)
                contents.append(content)
                errors.append(error or None)
            yield batch.assign(size=sizes, content=contents, error=errors)

    return listed.mapInPandas(read, "ord long, repo string, root string, path string, error string, size long, content string")


def scan_folder(spark: SparkSession, root: str, settings: Settings = Settings(), since: str | None = None, max_file_size: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """File rows of a folder; with since, of what changed after that revision."""
    root = os.path.abspath(root)
    paths = changed_files(root, since) if since else discover(root, settings)
    return _rows(_listing(spark, [(k, "", root, p, None) for k, p in enumerate(paths)]), settings, max_file_size, partitions or max(1, min(len(paths) // 64, 10_000)))


def scan_cluster(spark: SparkSession, root: str, settings: Settings = Settings(), max_file_size: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """File rows of every repository under root. One that can't be listed is a row with an error, or fails with cluster_fail_fast."""
    listed = []
    for folder, relative, name in find_repos(root, settings.cluster_depth, settings.cluster_skip):
        try:
            listed += [(k, relative or name, folder, p, None) for k, p in enumerate(discover(folder, settings))]
        except (DiscoveryError, OSError) as e:
            if settings.cluster_fail_fast:
                raise
            listed.append((0, relative or name, folder, "", str(e)))
    return _rows(_listing(spark, listed), settings, max_file_size, partitions or max(1, min(len(listed) // 64, 10_000)))


def _rows(listed: DataFrame, settings: Settings, max_file_size: int, partitions: int) -> DataFrame:
    read = read_contents(listed.repartition(partitions), max_file_size)
    rows = file_rows(read, F.col("path"), F.col("ord"), F.col("content"), F.col("size"), F.col("repo"), error=F.col("error"), languages=settings.languages)
    return rows


def scan_binary_files(spark: SparkSession, path: str, settings: Settings = Settings(), max_file_size: int = 1 << 20) -> DataFrame:
    """File rows of a folder in any storage that Spark reads (object stores too), by its own distributed listing.

    Names that start with _ or a dot are not listed there; skipped folders are filtered by path, and files above max_file_size by their length, before
    contents are read: such a file, of any size, is a row with its size and no content. All have ord 0, so files come in the order of their paths.
    """
    skip = "|".join(s.replace(".", "\\.") for s in WALK_SKIP)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(f"(?i)/(?:{skip})/"))
    bare = path.replace("file://", "").replace("file:", "").rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + "\\Q" + bare + "\\E/", "").alias("path")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\\x{feff}", "")
    decoded = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\x{feff}", "")).alias("content")
    small = found.where(F.col("length") <= max_file_size).select(relative, decoded, "length")
    large = found.where(F.col("length") > max_file_size).select(relative, F.lit(None).cast("string").alias("content"), "length")
    return file_rows(small.unionByName(large), F.col("path"), F.lit(0), F.col("content"), F.col("length"), languages=settings.languages)


def repo_table(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """root_path, relative, name, is_valid, error of each repository under root."""
    rows = []
    for folder, relative, name in find_repos(root, settings.cluster_depth, settings.cluster_skip):
        ok = Path(folder, ".git").exists() and os.access(folder, os.R_OK)
        rows.append((folder, relative, name, ok, None if ok else "not readable"))
    return spark.createDataFrame(rows, "root_path string, relative string, name string, is_valid boolean, error string")
