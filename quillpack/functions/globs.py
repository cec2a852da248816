r"""Path globs as regular expressions, compiled on the driver so that matching is one rlike in the scan's projection.

`*` stays within a segment, two or more stars cross `/`, `?` is one character of a segment; case does not count and `\` is `/`. Without
wildcards a pattern names a segment (`bin`), a folder (`bin/`), a path from the start (`src/a`) or, with a leading dot, an ending (`.env`).
With wildcards but no slash it matches a whole segment anywhere, and `*.ext` an ending too. `**/x` is x at any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"([\\.^$|()\[\]{}*+?\-#&~])")


def _quote(text: str) -> str:
    return _META.sub(r"\\\1", text)


def _body(pattern: str, across: str = ".*") -> str:
    parts = re.findall(r"\*+|\?|[^*?]+", pattern)
    return "".join("[^/]*" if p == "*" else across if p[0] == "*" else "[^/]" if p == "?" else _quote(p) for p in parts)


def alternatives(pattern: str) -> list[str]:
    """Expressions of which one must be found in a path for it to match; an empty one is found in any path."""
    p = pattern.replace("\\", "/")
    if not p:
        return [r"\A\z"]
    wild, slash = "*" in p or "?" in p, "/" in p.rstrip("/") if p != "/" else True
    if not wild:
        out = [_quote(p) + r"\z"] if p[0] == "." and "/" not in p else []
        if slash:
            return [*out, r"\A" + _quote(p) + ("" if p.endswith("/") else r"(?:/|\z)")]
        name = _quote(p.rstrip("/"))
        return [*out, rf"(?:\A|/){name}/" if p.endswith("/") else rf"(?:\A|/){name}(?:/|\z)"]
    if p in ("*", "**"):
        return [""]
    if "/" not in p:
        ending = p[1:] if re.fullmatch(r"\*\.[^*?]+", p) else None
        return [*([_quote(ending) + r"\z"] if ending else []), rf"(?:\A|/){_body(p, '[^/]*')}(?:/|\z)"]
    return [rf"\A{_body(p)}\z", *(alternatives(p[3:]) if p.startswith("**/") and len(p) > 3 else [])]


def regex(patterns: str | Iterable[str]) -> str | None:
    """One expression that matches if any pattern does (Java and RE2 alike); None if there is no pattern."""
    every = [patterns] if isinstance(patterns, str) else list(patterns)
    found = [a for p in every for a in alternatives(p)]
    if not found:
        return None
    return "(?is)" + ("" if "" in found else "|".join(dict.fromkeys(found)))


def glob_match(path: Column, patterns: str | Iterable[str]) -> Column:
    """Whether any pattern matches; no pattern matches nothing."""
    found = regex(patterns)
    if found is None:
        return F.lit(False)
    return F.translate(path, "\\", "/").rlike(found.replace("(?is)", "(?isu)", 1))
