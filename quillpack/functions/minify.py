"""The minifier: strips comments and collapses white space of source text, by the comment style of its language.

It works on tokens, not a grammar, and keeps the engine's known habits: a space owed before a string comes after it, the
indentation of lines that turn out empty stays for the next line, and a line comment ends at a line feed only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import style_of

#: Characters of results, and pieces of one text, that are held as Python strings.
HELD, _PIECES = 1 << 20, 1 << 16
_PYTHON, _CSHARP = ("py", "python"), ("cs", "csharp")
#: How each kind of string ends: what stops the search for its end.
_STOPS = {
    '"': re.compile(r'["\\\n\r]'), "'": re.compile(r"['\\\n\r]"), "`": re.compile(r"[`\\]"), 'r"': re.compile(r'["\\\n\r]'), "r'": re.compile(r"['\\\n\r]"),
    '"""': re.compile(r'"""|\\'), "'''": re.compile(r"'''|\\"), 'r"""': re.compile(r'"""|\\'), "r'''": re.compile(r"'''|\\"), '@"': re.compile(r'"'),
}


@lru_cache(maxsize=64)
def _plain(language: str) -> re.Pattern[str]:
    """A run of characters that start no comment, string or white space in this language."""
    style = style_of(language)
    special = set(" \t\r\n\"'`")
    special |= {style.block[0][0]} if style.block else set()
    special |= {"/"} if style.slashes else set()
    special |= {"#"} if style.hashes else set()
    special |= {"-"} if style.dashes else set()
    special |= set("rR") if language in _PYTHON else set("@$") if language in _CSHARP else set()
    return re.compile("[^" + re.escape("".join(sorted(special))) + "]+")


def _opener(code: str, at: int, language: str) -> tuple[str, str, str] | None:
    """What a string that starts here is opened by, what is written for it, and its kind."""
    if language in _PYTHON:
        raw = code[at] in "rR"
        for quote in ('"""', "'''", *(('"', "'") if raw else ())):
            if code.startswith(quote, at + raw):
                return code[at : at + raw + len(quote)], ("r" if raw else "") + quote, ("r" if raw else "") + quote
    elif language in _CSHARP:
        m = re.compile(r'(\$?)("{3,})').match(code, at)
        if m:
            return m[0], m[0], f"raw{len(m[2])}"
        m = re.compile(r'(?:@\$?|\$@)"').match(code, at)
        if m:
            return m[0], m[0], '@"'
    return (code[at], code[at], code[at]) if code[at] in "\"'`" else None


def _string_end(code: str, at: int, kind: str) -> tuple[int, bool]:
    """Where the text of a string that goes on at `at` ends, with its closing mark."""
    n = len(code)
    if kind.startswith("raw"):
        m = re.compile('"{' + kind[3:] + ",}").search(code, at)
        return (m.end() if m else n), bool(m)
    while True:
        m = _STOPS[kind].search(code, at)
        if not m:
            return n, False
        stop = m[0]
        if stop == "\\":
            if kind[0] == "r":  # only its own quote is escaped in a raw string
                at = m.end() + (code[m.end() : m.end() + 1] == kind[1])
            else:
                at = min(n, m.end() + 1)
            continue
        if kind == '@"' and code[m.end() : m.end() + 1] == '"':
            at = m.end() + 1
            continue
        return m.end(), True


def minify(code: str | None, language: str | None = None) -> str | None:
    """code without comments and surplus white space; NULL stays NULL."""
    if not code:
        return code
    language = (language or "").lower()
    style, plain = style_of(language), _plain(language)
    done: list[str] = []
    out: list[str] = []
    pending, empty, shebang = False, True, code.startswith("#!")
    at, n = 0, len(code)

    def line_break() -> None:
        nonlocal pending, empty
        if not empty:
            out.append("\n")
            empty, pending = True, False

    while at < n:
        if len(out) > _PIECES:
            done.append("".join(out))
            out.clear()
        if not shebang:
            if style.block and code.startswith(style.block[0], at):
                end = code.find(style.block[1], at + len(style.block[0]))
                for _ in range(code.count("\n", at, end if end >= 0 else n)):
                    line_break()
                if end >= 0:
                    if empty:
                        out.append(" ")
                    else:
                        pending = True
                at = n if end < 0 else end + len(style.block[1])
                continue
            if (
                (style.slashes and code.startswith("//", at) and not (at and code[at - 1] == ":"))
                or (style.dashes and code.startswith("--", at))
                or (style.hashes and code[at] == "#")
            ):
                end = code.find("\n", at)
                if end >= 0:
                    line_break()
                at = n if end < 0 else end + 1
                continue
        opened = _opener(code, at, language)
        if opened:
            source, written, kind = opened
            end, _ = _string_end(code, at + len(source), kind)
            out += [written, code[at + len(source) : end]]
            empty = empty and end == at + len(source)
            at = end
            continue
        c = code[at]
        if c in "\r\n":
            line_break()
            shebang = False
            at += 2 if code.startswith("\r\n", at) else 1
        elif c in " \t":
            if empty:
                out.append(c)
            else:
                pending = True
            at += 1
        else:
            m = plain.match(code, at)
            text = m[0] if m else c
            if pending:
                out.append(" ")
                pending = False
            out.append(text)
            empty = False
            at += len(text)
    return "".join([*done, *out])


def minify_batch(code: pa.Array, language: pa.Array) -> pa.Array:
    """minify of each text, a text at a time: results leave Python's memory for Arrow's in pieces of about HELD characters."""
    done: list[pa.Array] = []
    held: list[str | None] = []
    size = 0
    for c, x in zip(code, language, strict=True):
        held.append(minify(c.as_py(), x.as_py()))
        size += len(held[-1] or "")
        if size > HELD:
            done.append(pa.array(held, pa.string()))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, pa.string())])


@F.arrow_udf(T.StringType())
def minify_udf(code: pa.Array, language: pa.Array) -> pa.Array:
    """minify over columns of text and language."""
    return minify_batch(code, language)
