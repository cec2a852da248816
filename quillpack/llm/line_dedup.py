"""Corpus-wide line deduplication that returns keep bitmaps, not text.

Every non-blank line becomes a row (hash, document, position) of a few bytes. The rows are cut into ranges of
the hash, each range is sorted by hash, then document, then position, and one streaming pass keeps the
first row of every hash. Before the exchange the same pass runs inside every map task, so a line that
millions of documents share arrives at its range once per task and cannot skew it. The kept positions go
back to their documents as a run-length bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

_KEYS = ["h", "g", "doc_id", "th", "pos"]
_ROW = "h long, g int, doc_id long, th long, pos int"


def _first_of_each_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, g, ...): the first of every (h, g), across batch borders."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.empty(len(h), dtype=bool)
        new[0] = last is None or (h[0], g[0]) != last
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        last = (h[-1], g[-1])
        yield batch.filter(pa.array(new))


def encode_runs(n: int, kept: list[int]) -> str:
    """The bitmap of n lines of which those at the sorted positions kept stay: 'k3d2k1' is 111001."""
    if n == 0:
        return ""
    bits = np.zeros(n, dtype=bool)
    bits[np.asarray(kept, dtype=np.int64)] = True
    starts = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
    lengths = np.diff(np.append(starts, n))
    return "".join(f"{'k' if bits[s] else 'd'}{c}" for s, c in zip(starts, lengths, strict=True))


def decode_runs(runs: str) -> list[bool]:
    """The bits that encode_runs was given."""
    out: list[bool] = []
    for part in runs.replace("k", " k").replace("d", " d").split():
        out += [part[0] == "k"] * int(part[1:])
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *[F.col(c) for c in carry if c != "text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct document: doc_id, n_lines, n_kept, keep_runs (with carry: kept, the positions, and these columns of one of its rows).

    Lines are what newline characters separate; two are equal if all their characters are. The first in
    (doc_id, text hash, position) order stays, later ones go, within and across documents. Blank lines (empty or spaces)
    always stay. Defined cases: NULL text has 0 lines and an empty bitmap; an empty text is one blank line;
    rows with the same doc_id and text are one document and give one row; a NULL doc_id is a document id of its own
    that sorts first; very long texts and lines count whole; other columns are ignored, whatever their names; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col, carry)
    lines = F.split("text", "\n", -1)
    flat = rows.where(F.col("text").isNotNull()).select("doc_id", "th", F.posexplode(lines).alias("pos", "line"))
    keyed = flat.where(F.trim("line") != "").select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "doc_id", "th", "pos")
    combined = keyed.sortWithinPartitions(*_KEYS).mapInArrow(_first_of_each_hash, _ROW)
    parts = shuffle_partitions(spark)
    # xxhash64 is uniform, so equal ranges of it need no sampling pass over the corpus.
    span = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    ranged = combined.repartitionById(parts, F.least(F.lit(parts - 1), F.greatest(F.lit(0), span)))
    firsts = ranged.sortWithinPartitions(*_KEYS).mapInArrow(_first_of_each_hash, _ROW)

    blank = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    total = F.coalesce(F.size(lines), F.lit(0))
    whole = rows.select(
        "doc_id", "th", F.when(F.col("text").isNull(), 0).otherwise(total).alias("n_lines"), F.coalesce(blank, F.array().cast("array<int>")).alias("kept"),
        *[F.col(c) for c in carry],
    )
    found = firsts.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("kept"))
    found = found.select("doc_id", "th", F.lit(None).cast("int").alias("n_lines"), "kept", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carry])
    both = whole.unionByName(found).groupBy("doc_id", "th")
    # Repeated rows bring their blank positions more than once: hence the distinct.
    merged = both.agg(
        F.max("n_lines").alias("n_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("kept"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )

    @F.pandas_udf("string")
    def runs(n: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([encode_runs(int(a), b) for a, b in zip(n, kept, strict=True)], dtype="object")

    out = merged.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), "kept", *carry, runs("n_lines", "kept").alias("keep_runs"))
    return out if carry else out.drop("kept")


def apply_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept lines as text; rows without any line that is not blank go, and of repeated rows all but one.

    Where rows with one id and text differ in other columns, any one of them stays. Defined cases: NULL texts, empty ones and those of blank
    lines go; a NULL id is an id of its own; columns of any name are carried; very long texts are handled whole; no rows give no rows.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    marked = line_dedup(source, "doc_id", "text", carry=("text", "rest"))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.transform("kept", lambda i: F.element_at(lines, i + 1)), "\n")
    out = marked.select("doc_id", kept.alias("text"), "rest").where(F.trim(F.regexp_replace("text", "\n", "")) != "")
    columns = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL),
k AS (
  SELECT doc_id, pos, trim(line) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
b AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS grp FROM k),
r AS (SELECT doc_id, keep, min(pos) AS start, count(*) AS n FROM b GROUP BY doc_id, keep, grp),
t AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN keep THEN n ELSE 0 END) AS BIGINT) AS n_kept,
         string_agg((CASE WHEN keep THEN 'k' ELSE 'd' END) || n, '' ORDER BY start) AS keep_runs
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(keep_runs, '') AS keep_runs
FROM d LEFT JOIN t USING (doc_id)
"""
