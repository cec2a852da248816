"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose rate (of symbols, capitals, digits, repeated words) is above a cutoff. Cutoffs are not set by
hand: on labelled good documents, per stratum, cutoffs are tested from the most lenient down; each test is an exact
binomial test of "more than alpha of the good documents are rejected", at the level delta / (strata * rules), and the first
one that fails ends the sequence (fixed-sequence testing inside, Bonferroni across). So with probability 1 - delta no
stratum loses more than alpha * rules of its good documents, whatever their distribution.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

RULES = ("symbol_rate", "upper_rate", "digit_rate", "repeat_rate")
#: Cutoffs, from the most lenient; each is a multiple of 1/64, so that no engine rounds it.
CUTOFFS = tuple(k / 64 for k in (48, 40, 32, 24, 20, 16, 14, 12, 10, 8, 7, 6, 5, 4, 3, 2))
#: False rejections that a rule may cause in a stratum, and the chance that any rule does not keep to it.
ALPHA, DELTA = 0.02, 0.1
#: Strata up to which their cutoffs are broadcast to the documents.
BROADCAST_STRATA = 10_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\n\\t]+", -1), lambda w: w != "")


def rates(text: Column, words: Column) -> dict[str, Column]:
    """The four rates of a text that is not NULL and its words; all are 0 for an empty one."""
    chars = F.greatest(F.length(text), F.lit(1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b)
    again = F.size(F.filter(pairs, lambda same: same))

    def rate(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double") / chars

    return {
        "symbol_rate": rate("[#$%&*|!<>{}=~^\\\\]+"),
        "upper_rate": rate("\\p{Lu}+"),
        "digit_rate": rate("[0-9]+"),
        "repeat_rate": again.cast("double") / F.greatest(F.size(words), F.lit(1)),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1)
    lp, lq = math.log(p), math.log1p(-p)
    return min(1.0, math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k + 1)))


def stratum_key(name: str) -> Column:
    """A key that keeps a NULL stratum apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("NULL"))


def calibrate(measured: DataFrame, good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """stratum, n_good and per rule its certified cutoff (NULL: none), from measured (doc_id, th, stratum, rates) and good (doc_id).

    Equal texts count once in a stratum, as exact bounds need independent documents.
    """
    held = measured.join(good, "doc_id", "left_semi").groupBy("stratum", "th").agg(*[F.max(r).alias(r) for r in RULES])
    over = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(cutoffs)]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *over)
    counts = counts.crossJoin(counts.agg(F.count(F.lit(1)).alias("n_strata")))
    named = ", ".join(f"{r} double" for r in RULES)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": rows["stratum"], "n_good": rows["n_good"]}
        for r in RULES:
            chosen = []
            for row in rows.to_dict("records"):
                level, best = delta / (row["n_strata"] * len(RULES)), None
                for i, c in enumerate(cutoffs):
                    k, n = row[f"{r}_{i}"], row["n_good"]
                    # With k at the mean or above, the tail is far above any level.
                    if k >= n * alpha or binomial_tail(k, n, alpha) > level:
                        break
                    best = c
                chosen.append(best)
            out[r] = pd.Series(chosen, dtype="float64", index=rows.index)
        return pd.DataFrame(out)

    return counts.mapInPandas(lambda batches: (choose(b) for b in batches), f"stratum string, n_good long, {named}")


def quality_rules(
    docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: tuple[float, ...] = CUTOFFS,
    id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """doc_id, stratum, the four rates, rejected_by (rule names, comma-separated, or '') and keep, for every row.

    labels (doc_id, quality): a document is good if all its labels are 1 or more. Defined cases: a NULL stratum is a stratum of its
    own; a stratum without enough good labels has no cutoffs and keeps everything; NULL and empty texts have rates
    of 0 and are kept; NULL ids are carried and never match a label; repeated rows are judged alike and count once in the
    holdout; a rate equal to the cutoff passes; very long texts are measured whole; other columns are ignored, whatever their names; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(stratum_col).cast("string").alias("lang"), stratum_key(stratum_col).alias("stratum"), text.alias("text"), words_of(text).alias("words"))
    measured = durable(base.select("doc_id", "th", "lang", "stratum", *[c.alias(r) for r, c in rates(F.col("text"), F.col("words")).items()]))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("worst")).where("worst >= 1").select("doc_id")
    chosen = durable(calibrate(measured, good, alpha, delta, cutoffs).select("stratum", *[F.col(r).alias(f"{r}_cut") for r in RULES]))
    small = chosen.count() <= BROADCAST_STRATA
    judged = measured.join(F.broadcast(chosen) if small else chosen, "stratum", "left")
    failed = F.array_join(F.filter(F.array(*[F.when(F.col(r) > F.col(f"{r}_cut"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()), ",")
    return judged.select("doc_id", F.col("lang").alias("stratum"), *RULES, failed.alias("rejected_by"), (failed == "").alias("keep"))


_GRID = ", ".join(f"({k}, {c!r})" for k, c in enumerate(CUTOFFS))
_UNPIVOT = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS v FROM held" for r in RULES)
SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, greatest(length(text), 1) AS chars, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '') AS words FROM d),
m AS (
  SELECT doc_id, lang, text, coalesce('=' || lang, 'NULL') AS stratum,
    CAST(length(text) - length(regexp_replace(text, '[#$%&*|!<>{{}}=~^\\]+', '', 'g')) AS DOUBLE) / chars AS symbol_rate,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS DOUBLE) / chars AS upper_rate,
    CAST(length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) AS DOUBLE) / chars AS digit_rate,
    CAST(len(list_filter(list_zip(words[:-2], words[2:]), lambda x: x[1] = x[2])) AS DOUBLE) / greatest(len(words), 1) AS repeat_rate
  FROM w),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) >= 1),
held AS (
  SELECT stratum, text, max(symbol_rate) AS symbol_rate, max(upper_rate) AS upper_rate, max(digit_rate) AS digit_rate, max(repeat_rate) AS repeat_rate
  FROM m WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY stratum, text),
grid(step, c) AS (VALUES {_GRID}),
size AS (SELECT count(DISTINCT stratum) AS strata FROM held),
v AS ({_UNPIVOT}),
counts AS (SELECT stratum, rule, step, c, count(*) AS n, count(*) FILTER (WHERE v > c) AS k FROM v CROSS JOIN grid GROUP BY ALL),
terms AS (
  SELECT stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counts WHERE k < n * {ALPHA}) GROUP BY stratum, rule, step),
passed AS (
  SELECT c.stratum, c.rule, c.step, c.c, coalesce(t.tail <= {DELTA} / (strata * {len(RULES)}), false) AS ok
  FROM counts c CROSS JOIN size LEFT JOIN terms t USING (stratum, rule, step)),
cut AS (
  SELECT p.stratum, p.rule, min(p.c) AS c FROM passed p
  WHERE p.ok AND NOT EXISTS (SELECT 1 FROM passed q WHERE q.stratum = p.stratum AND q.rule = p.rule AND q.step <= p.step AND NOT q.ok)
  GROUP BY p.stratum, p.rule),
wide AS (SELECT stratum, {", ".join(f"max(c) FILTER (WHERE rule = '{r}') AS {r}_cut" for r in RULES)} FROM cut GROUP BY stratum),
judged AS (
  SELECT m.*, concat_ws(',', {", ".join(f"CASE WHEN {r} > {r}_cut THEN '{r}' END" for r in RULES)}) AS rejected_by
  FROM m LEFT JOIN wide USING (stratum))
SELECT doc_id, lang AS stratum, {", ".join(RULES)}, rejected_by, rejected_by = '' AS keep FROM judged
"""
