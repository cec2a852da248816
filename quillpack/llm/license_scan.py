"""License scans: ordered signature rules behind a keyword prefilter.

One Aho-Corasick pass over a text finds which rules can match at all; only their regular expressions run.
Detections are then settled per text in order of priority. The scan is a map over documents that moves no text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES

_GAP = r"(?:\s+(?:(?:\*|//|#|;|--)+\s+)?)"
_MARKS = re.compile(r"(?<!\S)(?:\*|//|#|;|--)+ ")


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


def read_rules(table: str = RULES) -> tuple[Rule, ...]:
    """The rules in a table of lines `licence | priority | keywords | expression`."""
    found = []
    for line in filter(None, table.splitlines()):
        name, priority, keywords, expression = line.split("|", 3)
        # A space in a class, or before a quantifier, is one character; elsewhere it separates words.
        spaced = re.sub(r"\[[^\]]*\]|\\.| (?=[?*+{])| ", lambda m: _GAP if m[0] == " " and not _quantified(expression, m.end()) else r"\s" if m[0] == " " else m[0], expression)
        found.append(Rule(len(found), name, int(priority), tuple(k.strip() for k in keywords.lower().split(",") if k.strip()), re.compile(spaced, re.IGNORECASE)))
    return tuple(found)


def _quantified(expression: str, at: int) -> bool:
    return at < len(expression) and expression[at] in "?*+{"


@lru_cache(maxsize=2)
def _machine(table: str):
    import ahocorasick

    rules = read_rules(table)
    gates: dict[str, list[int]] = {}
    for r in rules:
        for k in r.keywords:
            gates.setdefault(k, []).append(r.number)
    auto = ahocorasick.Automaton()
    for k, numbers in gates.items():
        auto.add_word(k, tuple(numbers))
    auto.make_automaton()
    return rules, auto


def settle(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Of detections (start, end, rule): by priority, then length, place and rule number, those that stay.

    One that lies within an accepted detection, or around one, goes; two that merely overlap both stay.
    """
    starts: list[int] = []  # no accepted one contains another, so starts and ends both ascend
    kept: list[tuple[int, int, int]] = []
    for s, e, r in sorted(set(found), key=lambda d: (-rules[d[2]].priority, d[0] - d[1], d[0], d[2])):
        after, upto = bisect_left(starts, s), bisect_right(starts, s)
        within = upto > 0 and kept[upto - 1][1] >= e
        around = after < len(kept) and kept[after][1] <= e
        if not within and not around:
            starts.insert(upto, s)
            kept.insert(upto, (s, e, r))
    return kept


def scan_text(text: str, table: str = RULES) -> list[tuple[int, int, int]]:
    """The settled detections (start, end, rule number) in text, in code points."""
    rules, auto = _machine(table)
    # As the expressions see it: white space, with comment marks of its own, is one space. So a keyword may run over line ends.
    low = _MARKS.sub("", " ".join(text.lower().split()))
    gated = {number for _, numbers in auto.iter(low) for number in numbers}
    if not gated:
        return []
    return settle([(m.start(), m.end(), n) for n in sorted(gated) for m in rules[n].pattern.finditer(text) if m.end() > m.start()], rules)


def scan_licenses(docs: DataFrame, table: str = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, rule, priority, start, stop, matched: one row per detection that stays.

    Defined cases: NULL and empty texts have no detections; whole texts are scanned, whatever their length; NULL ids are carried;
    repeated rows each give their detections; between equal detections of two rules the earlier rule wins; other columns
    are ignored; no rows give no rows. Keywords match in any case and, like the expressions, across line ends and comment marks.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, _ = _machine(table)
        for batch in batches:
            out = [(i, none, rules[n].license, n, rules[n].priority, s, e, t[s:e]) for i, none, t in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True) for s, e, n in scan_text(t, table)]
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "license", "rule", "priority", "start", "stop", "matched"])

    kept = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    found = kept.mapInPandas(scan, "doc_id long, no_id boolean, license string, rule int, priority int, start int, stop int, matched string")
    return found.withColumn("doc_id", F.expr("if(no_id, NULL, doc_id)")).drop("no_id")
