"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its words (spaces count, so that words have edges),
hashed to buckets. Each is scaled by the log of how much more common it is in toxic than in other labelled
texts; logistic regression is fitted on the scaled features (Wang & Manning 2012). Fitting sees a bounded sample of
labelled texts in one task; scoring is a map over all documents, which moves no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .hashed import Distinct, Rows, lbfgs, ngram_buckets, words_only

ORDERS = (4, 5, 6)
BITS = 20
#: Labelled texts that fitting sees at most.
MAX_TRAIN = 5_000
#: Probability from which a text is called toxic.
THRESHOLD = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # n-gram weight times its log-count ratio, by bucket
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def features(text: str, distinct: Distinct, orders: tuple[int, ...], bits: int) -> np.ndarray:
    points = words_only(text)
    return distinct(np.concatenate([ngram_buckets(points, n, bits) for n in orders]))


def _constant(bias: float, orders: tuple[int, ...], bits: int) -> ToxicityModel:
    return ToxicityModel(np.zeros(1 << bits, dtype=np.float32), bias, orders, bits)


def _linear(rows: Rows, y: np.ndarray, smooth: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights (times ratios) and bias of a logistic regression on the scaled features; both classes count alike."""
    pos, neg = rows.back(y.astype(float)), rows.back((~y).astype(float))
    seen = (pos > 0) | (neg > 0)
    pos, neg = pos + smooth, neg + smooth
    ratio = np.where(seen, np.log((pos / pos.sum()) / (neg / neg.sum())), 0.0)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    sign = np.where(y, 1.0, -1.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (rows.dot(v[:-1] * ratio) + v[-1])
        p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
        g = -weight * sign * p
        value = float((weight * np.logaddexp(0, -margin)).sum() + 0.5 * l2 * (v[:-1] @ v[:-1]))
        return value, np.append(rows.back(g) * ratio + l2 * v[:-1], g.sum())

    v = lbfgs(loss, np.zeros(rows.width + 1), steps=50)
    return v[:-1] * ratio, float(v[-1])


def calibrate(z: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """a and b for which logistic(a z + b) fits y best, after Platt; a is above 0."""
    centre, spread = float(z.mean()), float(z.std()) or 1.0
    unit, sign = (z - centre) / spread, np.where(y, 1.0, -1.0)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        slope = np.exp(v[0])
        margin = sign * (slope * unit + v[1])
        g = -sign / (1 + np.exp(np.clip(margin, -500, 500))) / len(z)
        return float(np.logaddexp(0, -margin).mean() + 0.5 * l2 * (v @ v)), np.array([(g * unit).sum() * slope, g.sum()]) + l2 * v

    u, b = lbfgs(loss, np.zeros(2), steps=100, tol=1e-10)
    a = float(np.exp(u)) / spread
    return a, float(b) - a * centre


def fit_rows(texts: list[str], toxic: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS, smooth: float = 1.0, l2: float = 1e-2) -> ToxicityModel:
    """fit_features of texts."""
    distinct = Distinct(bits)
    return fit_features([features(t, distinct, orders, bits) for t in texts], toxic, orders, bits, smooth, l2)


def fit_features(found: list[np.ndarray], toxic: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS, smooth: float = 1.0, l2: float = 1e-2) -> ToxicityModel:
    """The model of texts with these features; with one class only, a constant.

    Three quarters of the texts give the weights. On the other quarter, which the weights have not seen, the score is made a
    probability: a threshold set on the texts that were fitted would miss toxic texts of other words.
    """
    y = np.asarray(toxic, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return _constant(20.0 if len(y) and y.all() else -20.0, orders, bits)
    held = np.arange(len(y)) % 4 == 3
    if not (y[held].any() and not y[held].all() and y[~held].any() and not y[~held].all()):
        held[:] = False
    rows = Rows([found[i] for i in np.flatnonzero(~held)], 1 << bits)
    weights, bias = _linear(rows, y[~held], smooth, l2)
    if held.any():
        z = np.array([weights[found[i]].sum() for i in np.flatnonzero(held)])
        a, bias = calibrate(z, y[held])
        weights = a * weights
    return ToxicityModel(weights.astype(np.float32), bias, orders, bits)


def score_text(model: ToxicityModel, text: str, distinct: Distinct) -> float:
    """The probability that text is toxic, from its whole length."""
    z = float(model.weights[features(text, distinct, model.orders, model.bits)].sum()) + model.bias
    return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, y and text of at most limit labelled documents, drawn by a seeded hash of the id.

    A document with several labels takes the highest; one id with several texts takes the smallest text. NULL ids, labels and texts are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).dropna()
    drawn = marks.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).dropna()
    # At most `limit` ids and marks are broadcast, whatever the size of the corpus.
    return texts.join(F.broadcast(drawn), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, seed: int = 5, orders: tuple[int, ...] = ORDERS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model of the labelled documents, fitted in one executor task; only its weights come to the driver.

    Texts become features as they arrive at that task, so it holds their features (2 ** bits a text at most) and one batch of texts.
    """
    rows = training_rows(docs, labels, label, max_train, seed, id_col, text_col)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = Distinct(bits)
        found, y = [], []
        for batch in batches:
            found += [features(t, distinct, orders, bits) for t in batch["text"]]
            y += (batch["y"] > 0).tolist()
        model = fit_features(found, np.array(y, dtype=bool), orders, bits)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    sent = rows.repartition(1).sortWithinPartitions("_id").select("text", "y")
    got = sent.mapInPandas(train, "weights binary, bias double").collect()
    if not got:
        return fit_rows([], np.zeros(0), orders, bits)
    return ToxicityModel(np.frombuffer(got[0]["weights"], dtype=np.float32), got[0]["bias"], orders, bits)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_toxic and toxic (p_toxic >= threshold) of every row.

    Defined cases: a NULL, empty or blank text scores what the bias alone gives, but is never called toxic; NULL ids
    are carried; repeated rows are scored alike; very long texts are scored whole; other columns are ignored, whatever their names; no rows give no rows. With labels of one class only,
    or none, every text gets that class (none: not toxic).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        model = sent.value
        distinct = Distinct(model.bits)
        return pd.Series([score_text(model, t, distinct) for t in texts], dtype="float64")

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = out.select("doc_id", probability("text").alias("p_toxic"), F.col("text").rlike("\\S").alias("any"))
    return out.select("doc_id", "p_toxic", (F.col("any") & (F.col("p_toxic") >= threshold)).alias("toxic"))
