"""Mixing sources to target weights: every source fills its token budget as exactly as its documents allow.

Per source, documents are counted by exact token length. The same share of every length is taken first, so the
mix keeps each source's length distribution; what remains of the budget is filled by a bounded-knapsack
(subset-sum) dynamic programme over the lengths that are left. Which documents of a length go in is decided by a seeded hash:
all below a cutoff of (source, length). Only (source, length, count) rows meet in one task per source; the
documents themselves are never collected, a length that a third of them have is ranked in slices of its hashes, and the documents
that stay are found by a map that compares hashes with the broadcast cutoffs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER, durable, stored, text_of, token_lengths, unused

#: Tokens at the end of a budget that the dynamic programme fills (a proportional pass fills what is before them).
DP_SPAN = 65_536
#: Documents of one source and length that are ranked in one go, on average; more are cut into slices by their hash.
SLICE = 50_000
#: Cutoffs (one per source and length) up to which they are broadcast (60 MB, at the 250 bytes a row that were measured); beyond, they are joined by a shuffle.
BROADCAST_CUTS = 250_000
#: What the query asks for: this part of all tokens, by weights n ** 0.7 of sources of n tokens.
SHARE = 0.8


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most its count) give the largest sum up to budget."""
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    parent = np.full(budget + 1, -1, dtype=np.int64)
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable"):
        n = int(lengths[k])
        left = min(int(counts[k]), budget // n) if 0 < n <= budget else 0
        size = 1
        while left > 0 and not reach[budget]:
            size = min(size, left)  # 1, 2, 4, ... copies at once
            step = n * size
            fresh = np.flatnonzero(reach[: budget + 1 - step] & ~reach[step:]) + step
            parent[fresh] = len(items)
            reach[fresh] = True
            items.append((k, size))
            left -= size
            size *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, size = items[parent[at]]
        take[k] += size
        at -= int(lengths[k]) * size
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = DP_SPAN) -> np.ndarray:
    """How many documents of each length fill the budget: an equal share of each length, then subset_sum for the last span tokens."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    # Whole numbers throughout: a float share could overshoot.
    exact = [int(c) * budget for c in counts]
    take = np.array([e // total for e in exact], dtype=np.int64)
    take[lengths <= 0] = 0
    rest = budget - int((take * lengths).sum())
    order = sorted(range(len(lengths)), key=lambda i: (-(exact[i] % total), int(lengths[i])))
    moved = True
    while rest > span and moved:
        moved = False
        for i in order:
            n = int(lengths[i])
            if rest <= span:
                break
            if 0 < n <= rest and take[i] < counts[i]:
                take[i] += 1
                rest -= n
                moved = True
    def refill(most: int) -> np.ndarray:
        """The programme needs choice: it may place anew up to `most` documents of each length, the shortest lengths first, within the span."""
        kept, free = take.copy(), rest
        for i in np.argsort(lengths, kind="stable"):
            if lengths[i] > 0 and (back := min(most, int(kept[i]), max(0, span - free) // int(lengths[i]))):
                kept[i] -= back
                free += back * int(lengths[i])
        return kept + subset_sum(lengths, counts - kept, free)

    # The fewest documents that meet the budget are placed anew, so that the rest keep their lengths' shares.
    best, most = take, 1
    while int((best * lengths).sum()) < budget:
        found = refill(most)
        if int((found * lengths).sum()) > int((best * lengths).sum()):
            best = found
        if most >= int(take.max(initial=0)):
            break
        most *= 2
    return best


def _measured(docs: DataFrame, seed: int, tokenizer: str, id_col: str, text_col: str, source_col: str) -> list:
    """Columns of what the choice needs of a document: id, source, source key (a NULL one is its own), text hash, tokens, seeded hash."""
    number, digest = F.col(f"`{id_col}`").cast("long"), F.xxhash64(f"`{text_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    return [
        number.alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("NULL")).alias("skey"), digest.alias("th"),
        token_lengths(tokenizer)(text_of(f"`{text_col}`")).alias("n_tokens"), F.xxhash64(F.lit(seed), number, digest).alias("rh"),
    ]


def _cutoffs(lens: DataFrame, weights: dict[str, float] | None, temperature: float, budget: int | None, share: float | None, span: int) -> DataFrame:
    """skey, source, n_tokens, whole, last, c_rh, c_id, c_th: of each source and length that is chosen, whether all of its documents are, else the last one and how often that is."""
    counts = durable(lens.groupBy("skey", "n_tokens").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    per_source = counts.groupBy("skey").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("total"))
    if weights is None:
        weigh = F.pow(F.col("total").cast("double"), F.lit(float(temperature)))
    else:
        weigh = F.lit(0.0)
        for name, w in sorted(weights.items()):
            weigh = F.when(F.col("skey") == f"={name}", F.lit(float(w))).otherwise(weigh)
    per_source = per_source.withColumn("w", weigh).where("w > 0")
    room = F.min(F.col("total") / F.col("w")) * F.sum("w") if budget is None else F.lit(float(budget))
    if budget is None and share is not None:
        room = F.sum("total").cast("double") * F.lit(float(share))
    whole = per_source.agg(room.alias("tokens"))
    # With level tokens a weight, a source gives least(total, level * w). From the first source that runs short on, what is left of
    # the budget over the weights that are left bounds the level from below, and meets it at the last one that does.
    rising = Window.orderBy(F.col("total") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    falling = Window.orderBy((F.col("total") / F.col("w")).desc(), F.col("skey").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked_sources = per_source.withColumn("given", F.coalesce(F.sum("total").over(rising), F.lit(0))).withColumn("open_w", F.sum("w").over(falling))
    level = ranked_sources.crossJoin(whole).agg(F.max((F.col("tokens") - F.col("given")) / F.col("open_w")).alias("level"))
    part = F.least(F.col("total"), F.floor(F.col("level") * F.col("w") + F.lit(1e-6)).cast("long"))
    shares = per_source.crossJoin(level).select("skey", part.alias("budget"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        take = fit_budget(rows["n_tokens"].to_numpy(), rows["n"].to_numpy(), int(rows["budget"].iloc[0]), span)
        return pd.DataFrame({"skey": rows["skey"], "source": rows["source"], "n_tokens": rows["n_tokens"], "n": rows["n"], "take": take})

    plan = durable(counts.join(shares, "skey").groupBy("skey").applyInPandas(solve, "skey string, source string, n_tokens long, n long, take long").where("take > 0"))
    # Where some of a length go in: the slice of hashes in which the number is reached, then the place in it.
    some = plan.where("take < n")
    cuts = F.ceil(F.col("n") / SLICE)
    at = F.least(cuts - 1, F.floor((F.col("rh") / F.lit(2.0**64) + 0.5) * cuts)).cast("long")
    sliced = lens.drop("source").join(some, ["skey", "n_tokens"]).withColumn("slice", at)
    up_to = Window.partitionBy("skey", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("skey", "n_tokens", "take", "slice").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(up_to), F.lit(0)))
    crossed = slices.where("before < take AND take <= before + rows").select("skey", "n_tokens", "slice", (F.col("take") - F.col("before")).alias("left"))
    order = Window.partitionBy("skey", "n_tokens").orderBy("rh", "doc_id", "th")
    ranked = sliced.join(crossed, ["skey", "n_tokens", "slice"]).withColumn("row", F.row_number().over(order)).withColumn("first", F.rank().over(order)).where("row = left")
    last = ranked.select("skey", "source", "n_tokens", F.lit(False).alias("whole"), (F.col("row") - F.col("first") + 1).cast("long").alias("last"), F.col("rh").alias("c_rh"), F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"))
    none = F.lit(None).cast("long")
    return durable(last.unionByName(plan.where("take = n").select("skey", "source", "n_tokens", F.lit(True).alias("whole"), none.alias("last"), none.alias("c_rh"), none.alias("c_id"), none.alias("c_th"))))


def _with_cutoffs(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (skey, n_tokens, ...) of chosen sources and lengths with their cutoffs."""
    narrow = cuts.drop("source")
    return rows.join(F.broadcast(narrow) if narrow.count() <= BROADCAST_CUTS else narrow, ["skey", "n_tokens"])


def _place(prefix: str) -> Column:
    """A row's place among those of its source and length; a NULL id comes first."""
    return F.struct(F.col(f"{prefix}rh"), F.col(f"{prefix}id").isNotNull(), F.coalesce(f"{prefix}id", F.lit(0).cast("long")), F.col(f"{prefix}th"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, budget: int | None = None, share: float | None = None, seed: int = 17,
    span: int = DP_SPAN, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The chosen documents: doc_id, source, n_tokens, th (hash of the text).

    weights gives each source's share of the tokens (sources that it lacks get none); without it a source
    of n tokens weighs n ** temperature. budget is the tokens of the mix, or share their part of all tokens of the weighed sources; without either, as many as the
    weights allow with no document used twice. A source with too few tokens for its part gives all it has, and the others fill the rest by their weights.
    The dynamic programme sees the last span tokens of a source's budget, whatever its size: it takes span bytes and, with lengths of thousands of
    tokens, meets the budget exactly or, where no sum of lengths does, as nearly as the lengths that are left allow.
    Defined cases: a NULL source is a source of its own; empty and NULL texts have no tokens and are never chosen;
    every row counts as a document, repeated ones too; a NULL doc_id is carried as it is; ties in the seeded order
    go by doc_id (NULL first), then text hash; very long texts are counted whole; other columns are ignored, whatever their names; no rows give no rows.
    """
    lens = durable(docs.select(*_measured(docs, seed, tokenizer, id_col, text_col, source_col))).where("n_tokens > 0")
    cuts = _cutoffs(lens, weights, temperature, budget, share, span)
    below = _with_cutoffs(lens.withColumn("id", F.col("doc_id")), cuts).where(F.col("whole") | (_place("") < _place("c_"))).select("doc_id", "source", "n_tokens", "th")
    ends = cuts.where("NOT whole").select(F.col("c_id").alias("doc_id"), "source", "n_tokens", F.col("c_th").alias("th"), F.explode(F.sequence(F.lit(1).cast("long"), "last"))).drop("col")
    return below.unionByName(ends)


def select_mix(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, budget: int | None = None, share: float | None = None, seed: int = 17,
    span: int = DP_SPAN, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs in the mix: the rows that mix_sources (with these options) chooses.

    The texts are written once beside their lengths and read again by a map: they pass no shuffle. Defined cases: as in mix_sources; all columns are returned as
    they are, whatever their names; rows that repeat the last chosen one of a source and length (its id and text) can't be told apart and all stay.
    """
    mark = unused(docs, "__measured")
    held = stored(docs.select("*", F.struct(*_measured(docs, seed, tokenizer, id_col, text_col, source_col)).alias(mark)))
    lens = held.select(f"{mark}.*").where("n_tokens > 0")
    cuts = _cutoffs(lens, weights, temperature, budget, share, span)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    rows = _with_cutoffs(held.select(kept, f"{mark}.*").withColumn("id", F.col("doc_id")), cuts)
    chosen = rows.where(F.col("whole") | (_place("") <= _place("c_")))
    return chosen.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
