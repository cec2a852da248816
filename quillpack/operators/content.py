"""Predicates on content, and the status of each file that they lead to."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals up to which a chain of contains is used; more go into one expression of alternatives.
CHAIN = 50
PROBE = 4096


def contains_any(text: Column, literals: Iterable[str]) -> Column:
    """Whether any of the literals occurs (case counts); empty ones occur nowhere."""
    real = [x for x in dict.fromkeys(literals) if x]
    if not real:
        return F.lit(False)
    if len(real) > CHAIN:
        return text.rlike("|".join(re.sub(r"([\\.^$|()\[\]{}*+?\-#&~])", r"\\\1", x) for x in real))
    out = text.contains(real[0])
    for x in real[1:]:
        out = out | text.contains(x)
    return out


def content_passes(text: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """No excluded literal, and an included one if any is named. A list of empty literals only includes nothing."""
    include = list(include)
    kept = ~contains_any(text, exclude)
    return kept & contains_any(text, include) if include else kept


def is_binary(content: Column) -> Column:
    """Whether there is a NUL in the first 4,096 bytes (of text: characters)."""
    return F.instr(F.substring(content, 1, PROBE), "\x00") > 0


def is_binary_strict(content: Column) -> Column:
    """As is_binary, or more than a tenth of the first 4,096 are control characters; an empty text is none."""
    head = F.substring(content, 1, PROBE)
    controls = F.regexp_count(head, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    return is_binary(content) | F.coalesce(controls > F.length(head) * 0.1, F.lit(False))


def with_status(rows: DataFrame, max_file_size: int, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """rows with status: why a file is not shown ('error', 'oversize', 'binary', 'content_filtered'), else 'ok' ('marker' for markers)."""
    include, exclude = list(include), list(exclude)
    text = F.coalesce("content", F.lit(""))
    status = (
        F.when(F.col("kind") == "marker", "marker").when(F.col("error").isNotNull(), "error").when(F.col("size") > max_file_size, "oversize")
        .when(F.col("content").isNull(), "error").when(is_binary(text), "binary")
    )
    if include or exclude:
        status = status.when(~content_passes(text, include, exclude), "content_filtered")
    return rows.withColumn("status", status.otherwise("ok"))
