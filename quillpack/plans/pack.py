"""pack: file rows to one Markdown document (or one per shard), as a lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_size
from ..model import Settings
from ..operators import cluster, content, filters, render, shard, transforms


@dataclass(frozen=True)
class PackResult:
    """manifest: a row per file with status, bytes and tokens. rows: the same with sections. document: one row."""

    manifest: DataFrame
    rows: DataFrame
    document: DataFrame

    def totals(self) -> DataFrame:
        return render.totals(self.rows)


def pack(
    files: DataFrame, *, paths: Sequence[str] = (), extensions: Sequence[str] = (), presets: Sequence[str] = (), exclude: Sequence[str] = (), include_path: Sequence[str] = (),
    exclude_path: Sequence[str] = (), include_content: Sequence[str] = (), exclude_content: Sequence[str] = (), drop_line_prefixes: Sequence[str] = (), brain: bool = False,
    shard_of: tuple[int, int] | None = None, max_files: int | None = None, max_file_size: str | None = None, max_output: str | None = None, sort: bool | None = None,
    compressor: Sequence[str] = (), own_transforms: Sequence[transforms.Transform] = (), settings: Settings = Settings(),
) -> PackResult:
    """Filters file rows by path and content, renders what is left in order and packs it.

    shard_of=(2, 3) packs the second of three balanced shards. brain minifies files and compresses phrases of the document.
    Options that are not given come from settings.
    """
    rules = filters.PathRules(
        tuple(extensions), tuple(presets), settings.system_ignore, tuple(exclude), tuple(dict.fromkeys((*settings.exclude_path, *exclude_path))),
        tuple(dict.fromkeys((*settings.include_path, *include_path))), tuple(paths),
    )
    rows = filters.first_files(filters.filter_paths(files, rules), max_files or settings.max_files)
    return _finish(rows, False, include_content, exclude_content, drop_line_prefixes, brain, shard_of, max_file_size, max_output, sort, compressor, own_transforms, settings)


def pack_many(files: DataFrame, *, settings: Settings = Settings(), sort: bool | None = None, **options) -> PackResult:
    """pack for rows of several repositories (column repo): by repository, files as discovered, each repository under its marker.

    A shard has no markers, as its files come from here and there.
    """
    known = {k: options.pop(k, ()) for k in ("extensions", "presets", "exclude", "exclude_path", "include_path", "paths")}
    rules = filters.PathRules(
        tuple(known["extensions"]), tuple(known["presets"]), settings.system_ignore, tuple(known["exclude"]), tuple(dict.fromkeys((*settings.exclude_path, *known["exclude_path"]))),
        tuple(dict.fromkeys((*settings.include_path, *known["include_path"]))), tuple(known["paths"]),
    )
    rows = filters.first_files(filters.filter_paths(files, rules), options.pop("max_files", None) or settings.max_files)
    given = {k: options.pop(k, v) for k, v in {"include_content": (), "exclude_content": (), "drop_line_prefixes": (), "brain": False, "shard_of": None, "max_file_size": None, "max_output": None, "compressor": (), "own_transforms": ()}.items()}
    if options:
        raise TypeError(f"unknown options: {', '.join(sorted(options))}")
    rows = cluster.with_errors(rows, settings.cluster_fail_fast)
    marked = cluster.with_markers(rows, settings.but(cluster_headers=settings.cluster_headers and not given["shard_of"]))
    return _finish(marked, not sort, given["include_content"], given["exclude_content"], given["drop_line_prefixes"], given["brain"], given["shard_of"], given["max_file_size"], given["max_output"], sort, given["compressor"], given["own_transforms"], settings)


def _finish(rows, by_repo, include, exclude, prefixes, brain, shard_of, max_file_size, max_output, sort, compressor, own, settings) -> PackResult:
    if shard_of:
        rows = shard.take_shard(shard.assign_shards(rows, shard_of[1]), shard_of[0])
    prefixes = tuple(prefixes) or settings.drop_line_prefixes
    rows = content.with_status(rows, parse_size(max_file_size or settings.max_file_size), include, exclude)
    rows = render.with_section(render.with_body(rows, prefixes, brain), settings, changed=bool(prefixes) or brain)
    rows = render.check_output_size(rows, parse_size(max_output or settings.max_output))
    order = cluster.cluster_order() if by_repo else render.path_order() if (settings.sort if sort is None else sort) else [F.col("ord"), F.col("display")]
    doc = render.document(rows, settings, order)
    steps = [*([transforms.compress_phrases()] if brain else []), *([transforms.pipe_through(list(compressor))] if compressor else []), *own]
    manifest = rows.select("repo", "display", "language", "status", "size", "section_bytes", "section_tokens")
    return PackResult(manifest, rows, transforms.apply_transforms(doc, steps) if steps else doc)
