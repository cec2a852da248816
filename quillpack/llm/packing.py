"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs linear * n + quadratic * n**2 (attention grows with the square). Documents go, the
costliest first, to the sequence that is cheapest so far among those with room. One greedy run is sequential, so
the corpus is cut into groups of a fixed mean size by a seeded hash; each is packed on its own, and as the
groups are statistically alike, so are their sequences. Only ids and lengths are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, durable, text_of, token_lengths

#: Documents in a group, on average: thousands of sequences to choose from, and seconds of work for a task.
DOCS_PER_GROUP = 20_000


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The sequence of each document; lengths come in descending order and none is above capacity.

    Starts with the fewest sequences that could hold all tokens; a document that fits nowhere opens another.
    The cheapest sequence wins, the lowest number among equals.
    """
    out = np.zeros(len(lengths), dtype=np.int64)
    if not len(lengths):
        return out
    size = max(1, -(-int(lengths.sum()) // capacity))
    cost, free = np.zeros(size), np.full(size, capacity, dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(free >= n, cost, np.inf)))
        if free[at] < n:
            at = len(cost)
            cost, free = np.append(cost, 0.0), np.append(free, capacity)
        cost[at] += linear * n + quadratic * n * n
        free[at] -= n
        out[i] = at
    return out


def pack_balanced(
    docs: DataFrame, capacity: int = 32_768, linear: float = 1.0, quadratic: float = 1 / 24_576, docs_per_group: int = DOCS_PER_GROUP, seed: int = 23,
    tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Placements: doc_id, piece, first_token, n_tokens, cost, pack_group, seq (sequence within the group).

    A document above capacity is cut into pieces of capacity tokens and a rest, placed like documents; each
    piece attends only to itself, so its cost is its own. quadratic's default is that of attention against the other
    matrix products at width 4,096: n / (6 * 4096).
    Defined cases: empty and NULL texts have no tokens and no placement; every row is a document, repeated ones too; a
    NULL doc_id is carried as it is; equal lengths go by doc_id (NULL first), text hash, piece; other columns are ignored; no rows
    give no rows.
    """
    lens = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), token_lengths(tokenizer)(text_of(text_col)).alias("n"))).where("n > 0")
    cut = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity).cast("long"))
    pieces = lens.select("doc_id", "th", "n", F.explode(cut).alias("piece"))
    pieces = pieces.select("doc_id", "th", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    groups = max(1, -(-pieces.count() // docs_per_group))
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th", "piece"), F.lit(groups)).cast("int"))
    # pandas has no NULL among whole numbers: it travels as a flag.
    grouped = grouped.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "no_id", "doc_id", "th", "piece"], ascending=[False, False, True, True, True], kind="stable").reset_index(drop=True)
        n = rows["n_tokens"].to_numpy()
        rows["seq"] = assign(n, capacity, linear, quadratic)
        rows["cost"] = linear * n + quadratic * n.astype("float64") * n
        return rows[["doc_id", "no_id", "piece", "first_token", "n_tokens", "cost", "pack_group", "seq"]]

    placed = grouped.groupBy("pack_group").applyInPandas(pack, "doc_id long, no_id boolean, piece long, first_token long, n_tokens long, cost double, pack_group int, seq long")
    return placed.withColumn("doc_id", F.expr("if(no_id, NULL, doc_id)")).drop("no_id")
