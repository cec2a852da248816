"""Paths, sizes, times, lines and literal search as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LANGUAGES, SYMBOLS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line ends: CR LF, LF, CR, form feed, next line, line and paragraph separator.
LINE_END = "\\r\\n|[\\n\\r\\f\\u0085\\u2028\\u2029]"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, in ASCII lower case; '' if there is none or nothing follows."""
    return ascii_lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def language(path: Column, own: dict[str, str] | None = None) -> Column:
    """The language of the extension, or of the file name where there is none; an unknown one is its own name."""
    ext = extension(path)
    key = F.when(ext != "", ext).otherwise(F.lower(file_name(path)))
    known = LANGUAGES | {k.lower(): v for k, v in (own or {}).items()}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def relative_path(path: Column, root: str) -> Column:
    """path without the folder root in front; other paths as they are."""
    head = root.replace("\\", "/").rstrip("/") + "/"
    clean = slashes(path)
    return F.when(clean.startswith(head), F.substr(clean, F.lit(len(head) + 1))).otherwise(clean)


def display_path(display: Column, relative: Column, root: Column) -> Column:
    return F.coalesce(display, F.when(relative != "", relative).otherwise(root))


def printable(path: Column) -> Column:
    """path with control characters replaced, so that it can't break out of its line."""
    return F.regexp_replace(path, "[\\x00-\\x1F]", "�")


def fence_for(content: Column) -> Column:
    """A fence longer than any run of backticks in content: four at least."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    longest = F.when(content.contains("`"), F.greatest(F.lit(3), F.array_max(runs))).otherwise(F.lit(3))
    return F.repeat(F.lit("`"), longest + 1)


def trim_end(content: Column) -> Column:
    """content without spaces, tabs and line ends at its end."""
    blank = content.endswith(" ") | content.endswith("\n") | content.endswith("\r") | content.endswith("\t")
    return F.when(blank, F.rtrim(content, F.lit(" \t\r\n"))).otherwise(content)


_UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
_NUMBER = r"\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
_SIZE = re.compile(rf"\s*({_NUMBER})([KMG]?B)\s*", re.IGNORECASE)
_MOST = {"B": 2.0**62, "KB": 1_000_000, "MB": 999_999, "GB": 999_999}


def parse_size(text: str | None, default: int | None = None) -> int:
    """Bytes of '100MB'; the unit is required. Of other texts: default, or a ValueError without one."""
    m = _SIZE.fullmatch(text or "")
    if m and float(m[1]) <= _MOST[unit := m[2].upper()]:
        return int(float(m[1]) * _UNITS[unit])
    if default is None:
        raise ValueError(f"no size: {text!r}")
    return default


def size_in_bytes(text: Column) -> Column:
    """parse_size of a column; NULL where there is no size."""
    form = rf"(?i)^\s*({_NUMBER})([KMG]?B)\s*$"
    number, unit = F.regexp_extract(text, form, 1).try_cast("double"), F.upper(F.regexp_extract(text, form, 2))
    out = F.lit(None).cast("long")
    for name, factor in _UNITS.items():
        out = F.when((unit == name) & (number <= _MOST[name]), (number * factor).cast("long")).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    """Bytes as B, KB or MB (beyond, still MB), the latter two with two decimals."""
    kb, mb = F.format_string("%.2f KB", size / F.lit(1024.0)), F.format_string("%.2f MB", size / F.lit(1048576.0))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, kb).otherwise(mb)


def relative_time(then: Column, now: Column) -> Column:
    """How long before now then was, in words."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))

    def so_many(seconds: int, unit: str) -> Column:
        k = F.floor(s / seconds).cast("long")
        return F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (
        F.when(s < 60, F.lit("just now")).when(s < 3600, F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit(" min ago"))).when(s < 86400, so_many(3600, "hour"))
        .when(s < 2 * 86400, F.lit("yesterday")).when(s < 30 * 86400, so_many(86400, "day")).when(s < 365 * 86400, so_many(30 * 86400, "month")).otherwise(so_many(365 * 86400, "year"))
    )


def symbol(index: Column) -> Column:
    """The private-use character of that number, counted in a circle."""
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.pmod(index, F.lit(len(SYMBOLS))) + 1).cast("int"))


_WORD = "\\p{L}\\p{Nd}_"


def is_identifier(text: Column) -> Column:
    return text.rlike(f"\\A[{_WORD}]*\\z")


def has_long_word(text: Column, least: int = 6) -> Column:
    return text.rlike(f"[{_WORD}]{{{least}}}")


def replace_word(text: Column, word: str, new: str) -> Column:
    """text with word replaced where no letter, digit or underscore touches it."""
    quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, f"(?<![{_WORD}]){quoted}(?![{_WORD}])", new.replace("\\", "\\\\").replace("$", "\\$"))


def count_occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))).otherwise(0).cast("long")


def module_key(relative: Column) -> Column:
    """The first segment of a path, '_root' if there is none or it is a dot."""
    clean = slashes(relative)
    first = F.substring_index(clean, "/", 1)
    return F.when((F.instr(clean, "/") == 0) | (first == "."), F.lit("_root")).otherwise(first)


def parse_shard(text: str) -> tuple[int, int]:
    """(2, 3) of '2/3' or '2.3'."""
    m = re.fullmatch(r"\s*(\d+)\s*[/.]\s*(\d+)\s*", text or "")
    if not m or not 1 <= int(m[1]) <= int(m[2]):
        raise ValueError(f"no shard: {text!r}")
    return int(m[1]), int(m[2])


def shard_of(text: Column) -> Column:
    """parse_shard of a column, as a struct (slice, shards); NULL where there is none."""
    form = "^\\s*([0-9]+)\\s*[/.]\\s*([0-9]+)\\s*$"
    slice_, shards = (F.regexp_extract(text, form, k).try_cast("int") for k in (1, 2))
    return F.when(slice_.between(1, shards), F.struct(slice_.alias("slice"), shards.alias("shards")))


def normalise_extensions(values: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """['.CS, py'] as ('cs', 'py')."""
    return tuple(dict.fromkeys(e.strip().lstrip(".").lower() for v in values for e in v.split(",") if e.strip().lstrip(".")))
