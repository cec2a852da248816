"""Where documents go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_estimate


def write_atomic(path: str, text: str) -> None:
    """One file, whole or not at all: written aside and renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=os.path.basename(path) + ".tmp.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_document(document: DataFrame, path: str, append: bool = False, direct: bool = False) -> int:
    """The one packed document into a file on the driver; its bytes. append adds to a file that exists, direct writes in place."""
    row = document.select("document").first()
    text = row["document"] if row else ""
    if (append and os.path.exists(path)) or direct:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "a" if append else "w", encoding="utf-8", newline="") as f:
            f.write(text)
    else:
        write_atomic(path, text)
    return len(text.encode())


def write_parts(rows: DataFrame, path: str, order: list, append: bool = False) -> None:
    """Sections as ordered text files, for corpora that no single value holds: a range-partitioned sort, part files in order."""
    rows.orderBy(*order).select("section").write.mode("append" if append else "overwrite").option("lineSep", "\n").text(path)


def check_clipboard_size(document: DataFrame, limit: int) -> DataFrame:
    """document, failing when computed if it has more bytes than a clipboard may hold."""
    size = F.octet_length("document")
    return document.where(F.when(size > limit, F.raise_error(F.concat(F.lit("too large for the clipboard: "), size.cast("string"))).cast("boolean")).otherwise(True))


def discard(rows: DataFrame) -> None:
    """Computes all rows and keeps none."""
    rows.write.format("noop").mode("overwrite").save()


def dry_run(rows: DataFrame) -> DataFrame:
    """The paths that would be packed."""
    return rows.where("kind = 'file'").select("display")


def count_tokens(rows: DataFrame) -> DataFrame:
    """tokens of all readable files."""
    return rows.where("status = 'ok'").agg(F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("tokens"))
