"""The command line: one table of options, read into keyword arguments of pack."""

from __future__ import annotations

import json
import logging
import os
import shlex
import sys
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from ..functions.text import normalise_extensions, parse_shard
from ..model import PRESETS

VERSION = "0.1"
log = logging.getLogger("quillpack")
#: Spellings, the name they set, and what follows: 'flag', 'one' value, 'maybe' a number, or 'many' values.
OPTIONS = (
    (("-p", "--paths", "-g", "grab"), "paths", "many"), (("-e", "--extension", "--extensions", "-t", "type"), "extensions", "many"), (("-x", "--exclude", "--excludes", "-y", "yeet"), "exclude", "many"),
    (("--preset", "--presets"), "presets", "many"), (("-z", "--exclude-line-if-start", "zap"), "drop_line_prefixes", "many"), (("--exclude-path",), "exclude_path", "many"),
    (("--include-path",), "include_path", "many"), (("--exclude-content",), "exclude_content", "many"), (("--include-content",), "include_content", "many"), (("-d", "--depth"), "max_depth", "one"),
    (("-f", "--force"), "force", "flag"), (("--changed-since",), "changed_since", "one"), (("--explain-filter",), "explain", "one"), (("-s", "-o", "--output", "spit"), "output", "one"),
    (("--append",), "append", "flag"), (("--no-append",), "no_append", "flag"), (("--unsafe-direct-write",), "direct", "flag"), (("--no-clipboard",), "discard", "flag"), (("--no-sort",), "no_sort", "flag"),
    (("-b", "--brain", "brain"), "brain", "flag"), (("-c", "--compress", "compress"), "compress", "flag"), (("--cluster", "horde"), "cluster", "flag"), (("--cluster-dir",), "cluster_dir", "one"),
    (("--cluster-depth",), "cluster_depth", "one"), (("--shard",), "shard", "one"), (("--dry-run", "--list"), "dry_run", "flag"), (("--count", "--tokens-only"), "count", "flag"),
    (("--max-memory",), "max_output", "one"), (("--stats", "--profile-timing"), "stats", "flag"), (("--json-stats", "--profile-json"), "json_stats", "one"), (("--history",), "history", "maybe"), (("--init-config",), "init_config", "flag"),
    (("--validate-config",), "validate_config", "flag"), (("--dump-config",), "dump_config", "flag"), (("--export-schema",), "export_schema", "flag"), (("-v", "--verbose"), "verbose", "flag"), (("--debug",), "debug", "flag"), (("--self-test", "--test"), "self_test", "flag"), (("--benchmark",), "benchmark", "flag"),
    (("--compressor",), "compressor", "one"), (("--no-cache",), "no_cache", "flag"), (("--profile",), "profile", "one"), (("--save-profile",), "save_profile", "one"), (("--list-profiles",), "list_profiles", "flag"),
    (("--save",), "save", "flag"), (("--version",), "version", "flag"), (("-h", "--help"), "help", "flag"),
)
_BY_NAME = {spelling: (name, kind) for spellings, name, kind in OPTIONS for spelling in spellings}


@dataclass
class Arguments:
    values: dict[str, object] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def get(self, name: str, default=None):
        return self.values.get(name, default)


def parse(argv: list[str]) -> Arguments:
    """The arguments by name. Options count in any case; bare words, and all behind --, are paths; many values run up to the next option."""
    out, many = Arguments(), None
    rest = list(argv)
    while rest:
        word = rest.pop(0)
        if word == "--":
            out.values.setdefault("paths", []).extend(rest)
            break
        known = _BY_NAME.get(word.lower())
        if known is None:
            if word.startswith("-") and len(word) > 1:
                out.errors.append(f"unknown option: {word}")
                many = None
            else:
                out.values.setdefault(many or "paths", []).append(word)
            continue
        name, kind = known
        many = name if kind == "many" else None
        if kind == "flag":
            out.values[name] = True
        elif kind == "maybe":
            out.values[name] = int(rest.pop(0)) if rest and rest[0].isdecimal() else 0
        elif kind == "one":
            if not rest or rest[0].lower() in _BY_NAME:
                out.errors.append(f"{word} needs a value")
            else:
                out.values[name] = rest.pop(0)
        else:
            out.values.setdefault(name, [])
    _check(out)
    return out


def _check(args: Arguments) -> None:
    for name in ("max_depth", "cluster_depth"):
        if name in args.values:
            try:
                args.values[name] = int(str(args.values[name]))
            except ValueError:
                args.errors.append(f"{name} is no number: {args.values.pop(name)}")
    if "shard" in args.values:
        try:
            args.values["shard_of"] = parse_shard(str(args.values.pop("shard")))
        except ValueError as e:
            args.errors.append(str(e))
    if "extensions" in args.values:
        args.values["extensions"] = list(normalise_extensions(args.values["extensions"]))
    for preset in args.get("presets", []):
        if preset not in PRESETS:
            args.errors.append(f"unknown preset: {preset}")


def saved_arguments(start: str | Path = ".") -> list[str]:
    """The words of the nearest file of saved arguments at or above start; [] if there is none."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / ".quillpack-args").is_file():
            return shlex.split((folder / ".quillpack-args").read_text(), comments=True)
    return []


def pack_options(args: Arguments) -> dict[str, object]:
    """The arguments that pack takes."""
    names = ("paths", "extensions", "presets", "exclude", "include_path", "exclude_path", "include_content", "exclude_content", "drop_line_prefixes", "brain", "shard_of", "max_output")
    out = {n: args.values[n] for n in names if n in args.values}
    return out | ({"sort": False} if args.get("no_sort") else {})


def layered(argv: list[str]) -> list[str]:
    """argv behind the arguments of the profile that it names; else behind the saved ones of a file, else of this directory."""
    from ..sources import profiles

    given = parse(argv)
    if given.get("profile"):
        return [*(profiles.load(profiles.PROFILES, str(given.get("profile"))) or []), *argv]
    return [*(saved_arguments() or profiles.load(profiles.DEFAULTS, ".") or []), *argv]


def _plain(argv: list[str], dropped: tuple[str, ...], with_value: tuple[str, ...]) -> list[str]:
    """argv without the options dropped (and those in with_value, without what follows)."""
    out, skip = [], False
    for word in argv:
        if skip or word in dropped or word in with_value:
            skip = not skip and word in with_value
            continue
        out.append(word)
    return out


def compressor_of(args: Arguments) -> list[str]:
    """The command of the outside compressor: --compressor, else $QUILLPACK_COMPRESSOR; only with -c."""
    command = shlex.split(str(args.get("compressor") or os.environ.get("QUILLPACK_COMPRESSOR", ""))) if args.get("compress") or args.get("compressor") else []
    return [*command, "--no-cache"] if command and args.get("no_cache") else command


def _settings_command(args: Arguments, settings) -> str | None:
    """What a command that only prints prints; None if there is no such command."""
    from ..sources import profiles
    from ..sources import settings as S

    if args.get("help"):
        return "\n".join("  ".join((", ".join(spellings), {"one": "VALUE", "many": "VALUES", "maybe": "[N]"}.get(kind, ""))).rstrip() for spellings, _, kind in OPTIONS)
    if args.get("version"):
        return VERSION
    if args.get("list_profiles"):
        return "\n".join(f"{name}: {shlex.join(words)}" for name, words in sorted(profiles.read(profiles.PROFILES).items()))
    if args.get("dump_config"):
        return S.dump(settings)
    if args.get("export_schema"):
        return json.dumps(S.schema(), indent=2)
    if args.get("init_config"):
        return str(S.init())
    if args.get("validate_config"):
        return "\n".join(": ".join(x) for x in S.validate(settings))
    return None


def set_log_level(args: Arguments) -> None:
    """Messages on standard error: warnings, with --verbose what is done, with --debug all."""
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("[%(levelname)s] %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(logging.DEBUG if args.get("debug") else logging.INFO if args.get("verbose") else logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    """Runs a command line; 0 if all went well."""
    from ..sources import profiles
    from ..sources import settings as S

    argv = list(sys.argv[1:] if argv is None else argv)
    args = parse(layered(argv))
    if args.get("profile") and profiles.load(profiles.PROFILES, str(args.get("profile"))) is None:
        args.errors.append(f"unknown profile: {args.get('profile')}")
    set_log_level(args)
    if args.errors:
        for error in args.errors:
            log.error(error)
        return 2
    kept = _plain(argv, ("--save",), ("--save-profile", "--profile"))
    if args.get("save_profile"):
        profiles.save(profiles.PROFILES, str(args.get("save_profile")), kept)
        return 0
    if args.get("save"):
        profiles.save(profiles.DEFAULTS, ".", kept)
        return 0
    settings = S.load()
    printed = _settings_command(args, settings)
    if printed is not None:
        print(printed)
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ..functions import text as X
    from ..operators import filters, sinks
    from ..operators.report import Report
    from ..sources import files, history
    from .pack import pack, pack_many

    report = Report()
    if args.get("force"):
        settings = settings.but(discovery="filesystem")
    settings = settings.but(max_depth=args.get("max_depth", settings.max_depth), cluster_depth=args.get("cluster_depth", settings.cluster_depth))
    spark = SparkSession.builder.getOrCreate()
    if args.get("self_test"):
        from .selftest import self_test

        found = self_test(spark)
        print("\n".join(f"{name}: {result}" for name, result in found.items()))
        return int(set(found.values()) != {"ok"})
    if args.get("benchmark"):
        from .selftest import benchmark

        print(json.dumps(benchmark(spark)))
        return 0
    past = str(profiles.folder() / "history")
    if "history" in args.values:
        runs = history.numbered(history.read_history(spark, past))
        if not args.get("history"):
            shown = runs.orderBy("number").select("number", X.relative_time(F.col("last_run"), F.current_timestamp()).alias("ago"), "directory", F.array_join("arguments", " ").alias("words"))
            print("\n".join(f"{r.number}. {r.ago}  {r.directory}  {r.words}" for r in shown.collect()))
            return 0
        again = runs.where(F.col("number") == args.get("history")).first()
        if again is None or not os.path.isdir(again.directory):
            log.error("no such run: %s", args.get("history"))
            return 2
        os.chdir(again.directory)
        return main(list(again.arguments))
    options = pack_options(args)
    if args.get("explain"):
        rules = filters.PathRules(**{k: tuple(v) for k, v in options.items() if k in ("extensions", "presets", "exclude", "exclude_path", "include_path")}, search=tuple(options.get("paths", ())))
        print(spark.range(1).select(filters.explain(F.lit(str(args.get("explain"))), rules)).first()[0])
        return 0
    many = bool(args.get("cluster"))
    with report.stage("discovery"):
        rows = files.scan_cluster(spark, str(args.get("cluster_dir") or "."), settings) if many else files.scan_folder(spark, ".", settings, args.get("changed_since"))
    log.info("files are listed: %s", "repositories below " + str(args.get("cluster_dir") or ".") if many else os.getcwd())
    log.debug("settings: %s", settings)
    with report.stage("plan"):
        result = (pack_many if many else pack)(rows, settings=settings, compressor=compressor_of(args), **options)
    if args.get("dry_run"):
        print("\n".join(r.display for r in sinks.dry_run(result.rows).toLocalIterator()))
        return 0
    if args.get("count"):
        print(sinks.count_tokens(result.rows).first()[0])
        return 0
    with report.stage("output"):
        if args.get("output"):
            sinks.write_document(result.document, str(args.get("output")), bool(args.get("append")) and not args.get("no_append"), bool(args.get("direct")))
        else:
            sinks.discard(result.document)
    log.info("the document is written%s", f": {args.get('output')}" if args.get("output") else " nowhere, as no output is named")
    if args.get("stats") or args.get("json_stats"):
        with report.stage("totals"):
            sinks.discard(report.watch(result.rows))
        report.gather()
        if args.get("stats"):
            print(report.to_markdown())
        if args.get("json_stats"):
            sinks.write_atomic(str(args.get("json_stats")), report.to_json())
    history.record(spark, past, os.getcwd(), kept, datetime.now())
    return 0


if __name__ == "__main__":
    sys.exit(main())
