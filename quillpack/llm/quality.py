"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(theta_k - s(text)): one set of weights over hashed text features gives the score s, and ordered
thresholds cut it into grades. Features are the character n-grams of the text as it stands (case and symbols kept), each order as
frequencies, and the share of words that repeat the word before, so s does not depend on a text's length.
Fitting sees a bounded sample in one task; scoring is a map. Documents are selected by the tail probability P(grade >= k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused
from .hashed import Rows, code_points, lbfgs, ngram_buckets
from .toxicity import training_rows

ORDERS = (1, 2, 3)
BITS = 16
#: Rated texts that fitting sees at most.
MAX_TRAIN = 6_000


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # by bucket; two more for the repetition features
    thresholds: np.ndarray  # ascending, one fewer than grades
    grades: tuple[int, ...]


def repetition(points: np.ndarray) -> tuple[float, float]:
    """Of a text's words: the share that equals the word before, and the share that is new (white space separates)."""
    space = np.concatenate(([True], (points == 32) | ((points >= 9) & (points <= 13)), [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < 2:
        return 0.0, 1.0
    power = np.cumprod(np.full(len(points), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(7)) * power)))
    # Two words are equal if their sums are after each is moved to the same power.
    inverse = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    shift = np.cumprod(np.full(len(points), inverse, dtype=np.uint64))
    words = (total[ends] - total[starts]) * shift[starts]
    words = words ^ ((ends - starts).astype(np.uint64) << np.uint64(56))
    same = float((words[1:] == words[:-1]).mean())
    return same, len(np.unique(words)) / len(words)


def parts(text: str) -> tuple[list[np.ndarray], tuple[float, float]]:
    points = code_points(text)
    return [ngram_buckets(points, n, BITS) for n in ORDERS], repetition(points)


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    grams, (same, fresh) = parts(text)
    found = [np.unique(g, return_counts=True) for g in grams]
    columns = [c.astype(np.int64) for c, _ in found] + [np.array([1 << BITS, (1 << BITS) + 1])]
    values = [n / max(1, n.sum()) for _, n in found] + [np.array([same, 1 - fresh])]
    return np.concatenate(columns), np.concatenate(values)


def fit_rows(texts: list[str], grades: np.ndarray, l2: float = 1e-5) -> QualityModel:
    """fit_features of texts."""
    return fit_features([frequencies(t) for t in texts], grades, l2)


def ordered(u: np.ndarray) -> np.ndarray:
    """Thresholds from free numbers: the first as it is, then the logarithms of the gaps."""
    return np.cumsum(np.concatenate((u[:1], np.exp(np.clip(u[1:], -30, 30)))))


def loss_of(rows: Rows, y: np.ndarray, cuts: int, l2: float):
    """The mean loss of rated rows (y from 0 to cuts), and its gradient, by weights and then free thresholds."""
    width = rows.width

    def logistic(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, u = v[:width], v[width:]
        theta = ordered(u)
        s = rows.dot(w)
        upper = np.where(y < cuts, logistic(np.append(theta, 0)[y] - s), 1.0)
        lower = np.where(y > 0, logistic(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_theta = np.bincount(np.minimum(y, cuts - 1), weights=np.where(y < cuts, -du, 0), minlength=cuts) + np.bincount(np.maximum(y - 1, 0), weights=np.where(y > 0, dl, 0), minlength=cuts)
        n = len(y)
        tail = np.cumsum(by_theta[::-1])[::-1]
        scale = np.concatenate((np.ones(1), np.exp(np.clip(u[1:], -30, 30))))
        value = -float(np.log(p).sum()) / n + 0.5 * l2 * float(w @ w)
        return value, np.concatenate((rows.back(du - dl) / n + l2 * w, tail * scale / n))

    return loss


def fit_features(pairs: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, l2: float = 1e-5) -> QualityModel:
    """The model of rated texts with these columns and values. With fewer than two grades there is nothing to tell apart and no threshold."""
    width = (1 << BITS) + 2
    names, y = np.unique(np.asarray(grades, dtype=np.int64), return_inverse=True)
    if len(names) < 2:
        return QualityModel(np.zeros(width), np.zeros(0), tuple(names.tolist()) or (0,))
    rows = Rows([c for c, _ in pairs], width, [v for _, v in pairs])
    cuts = len(names) - 1
    share = np.cumsum(np.bincount(y, minlength=len(names)))[:-1] / len(y)
    start = np.log(share / (1 - share))
    # thresholds = first, then gaps as exponentials: they stay in order
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))

    v = lbfgs(loss_of(rows, y, cuts, l2), np.concatenate((np.zeros(width), free)), steps=120)
    return QualityModel(v[:width], ordered(v[width:]), tuple(names.tolist()))


def score_text(model: QualityModel, text: str) -> np.ndarray:
    """P(grade >= k) for each grade k but the lowest, in ascending order of k."""
    grams, (same, fresh) = parts(text)
    s = sum(float(model.weights[g].mean()) for g in grams if len(g)) + float(model.weights[-2]) * same + float(model.weights[-1]) * (1 - fresh)
    return 1 / (1 + np.exp(np.clip(model.thresholds - s, -500, 500)))


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "grade", max_train: int = MAX_TRAIN, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model of the rated documents, fitted in one executor task; only its weights come to the driver.

    Features are made where the texts are and sent to that task, so what it holds is bounded by their number however long the texts.
    """
    rows = training_rows(docs, ratings, grade, max_train, seed, id_col, text_col)

    @F.pandas_udf("columns binary, values binary")
    def measure(texts: pd.Series) -> pd.DataFrame:
        pairs = [frequencies(t) for t in texts]
        return pd.DataFrame({"columns": [c.astype(np.uint32).tobytes() for c, _ in pairs], "values": [v.astype(np.float32).tobytes() for _, v in pairs]})

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, y = [], []
        for batch in batches:
            pairs += [(np.frombuffer(c, dtype=np.uint32), np.frombuffer(v, dtype=np.float32)) for c, v in zip(batch["columns"], batch["values"], strict=True)]
            y += batch["y"].tolist()
        model = fit_features(pairs, np.array(y, dtype=np.int64))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()], "grades": [list(model.grades)]})

    sent = rows.select("_id", "y", measure("text").alias("f")).select("_id", "y", "f.columns", "f.values").repartition(1).sortWithinPartitions("_id")
    got = sent.select("columns", "values", "y").mapInPandas(train, "weights binary, thresholds array<double>, grades array<int>").collect()
    if not got:
        return fit_rows([], np.zeros(0))
    return QualityModel(np.frombuffer(got[0]["weights"], dtype=np.float64), np.array(got[0]["thresholds"], dtype=float), tuple(got[0]["grades"]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings out of the two labels: 0 bad, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def grade(docs: DataFrame, model: QualityModel, at_least: int = 1, cutoff: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, p_tail = P(grade >= at_least) and keep = p_tail >= cutoff; its own columns of these names are replaced.

    Defined cases: an empty or NULL text (or only white space) has no evidence: expected grade and p_tail are 0 and keep is false; repeated rows are
    graded alike; very long texts are graded whole; NULLs elsewhere and further columns pass through; no rows give no rows. Ratings with fewer than two
    grades (none: grade 0) give every text that grade; p_tail is then 1 or 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def rate(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        grades = np.array(model.grades, dtype=float)
        expected, tail = np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text or text.isspace():
                continue
            above = score_text(model, text) if len(grades) > 1 else np.zeros(0)
            expected[i] = grades[0] + float((np.diff(grades) * above).sum())
            k = int(np.searchsorted(grades, at_least))
            tail[i] = 1.0 if k == 0 else 0.0 if k == len(grades) else above[k - 1]
        return pd.DataFrame({"expected": expected, "tail": tail})

    kept = [c for c in docs.columns if c.lower() not in ("expected_grade", "p_tail", "keep")]
    rated = unused(docs, "__rated")
    own = [F.col(f"`{c}`") for c in kept]
    expected, tail = F.col(rated)["expected"], F.col(rated)["tail"]
    return docs.select(*own, rate(text_of(text_col)).alias(rated)).select(*own, expected.alias("expected_grade"), tail.alias("p_tail"), (tail >= cutoff).alias("keep"))
