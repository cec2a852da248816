"""Toxicity and quality: held-out accuracy, the parts of the models, and awkward rows."""

import math
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.llm import hashed, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").orderBy(F.xxhash64("doc_id")).collect()
    return rows[:2400], rows[2400:]


def test_toxicity_on_held_out_texts(labelled):
    train, held = labelled
    model = toxicity.fit_rows([r.text for r in train], np.array([r.toxic for r in train]))
    distinct = hashed.Distinct(model.bits)
    scores = np.array([toxicity.score_text(model, r.text, distinct) for r in held])
    # One in nine of these toxic texts is junk that shows no sign of it.
    toxic, clean = (scores[[bool(r.toxic) == t for r in held]] for t in (True, False))
    assert (toxic >= toxicity.THRESHOLD).mean() > 0.65 and (clean >= toxicity.THRESHOLD).mean() < 0.005
    assert np.mean([(clean < s).mean() for s in toxic]) > 0.95


def test_log_count_ratios_scale_the_features():
    texts = ["you idiot person", "you lovely person"] * 9
    model = toxicity.fit_rows(texts, np.array([1, 0] * 9), (4,), 12)
    distinct = hashed.Distinct(12)
    only = np.setdiff1d(toxicity.features("idiot", distinct, (4,), 12), toxicity.features("you lovely person", distinct, (4,), 12))
    shared = toxicity.features("person", distinct, (4,), 12)
    assert model.weights[only].min() > 0 and abs(model.weights[shared]).max() < 1e-6


def test_distinct_agrees_with_unique():
    b = np.random.default_rng(0).integers(0, 64, 500).astype(np.uint32)
    assert sorted(hashed.Distinct(6)(b).tolist()) == np.unique(b).tolist()


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = hashed.lbfgs(lambda v: (float(0.5 * v @ a @ v - v.sum()), a @ v - 1), np.zeros(3), 100, tol=1e-14)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def test_quality_on_held_out_texts(labelled):
    train, held = labelled
    model = quality.fit_rows([r.text for r in train], np.array([r.quality * (2 - r.toxic) for r in train]))
    assert model.grades == (0, 1, 2) and (np.diff(model.thresholds) > 0).all()
    kept = [quality.score_text(model, r.text)[0] >= 0.5 for r in held]
    good, bad = [k for k, r in zip(kept, held) if r.quality], [k for k, r in zip(kept, held) if not r.quality]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.05


def test_quality_grades_in_order():
    texts = ["good words here " * 3] * 20 + ["so so words !! " * 3] * 20 + ["$$$ %%% " * 5] * 20
    model = quality.fit_rows(texts, np.array([2] * 20 + [1] * 20 + [0] * 20))
    tails = [quality.score_text(model, t) for t in (texts[0], texts[20], texts[40])]
    assert all(math.isfinite(x) for t in tails for x in t) and all((np.diff(t) <= 0).all() for t in tails)
    assert tails[0][1] > 0.5 > tails[1][1] and tails[1][0] > 0.5 > tails[2][0]


# --- brute force: features, losses and scores in plain Python and dense matrices


def bucket(gram, bits):
    h, full = len(gram) * 7919 + 1, (1 << 32) - 1
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & full
        h ^= h >> 15
    return (h * 0x9E3779B1 & full) >> (32 - bits)


def plain_toxicity_features(text, orders=toxicity.ORDERS, bits=toxicity.BITS):
    spaced = re.sub(" +", " ", "".join(c if c.isalnum() or ord(c) >= 0x250 else " " for c in f" {text.lower()} "))
    return {bucket(spaced[i : i + n], bits) for n in orders for i in range(len(spaced) - n + 1)}


def plain_quality_features(text):
    out = Counter()
    for n in quality.ORDERS:
        grams = [text[i : i + n] for i in range(len(text) - n + 1)]
        for g in grams:
            out[bucket(g, quality.BITS)] += 1 / len(grams)
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    if len(words) > 1:
        out[1 << quality.BITS] = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        out[(1 << quality.BITS) + 1] = 1 - len(set(words)) / len(words)
    return out


def test_toxicity_query_against_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.p_toxic, r.toxic) for r in queries.op2_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        z = sum(float(model.weights[k]) for k in plain_toxicity_features(r.text)) + model.bias
        p = 1 / (1 + math.exp(-z))
        assert abs(got[r.doc_id][0] - p) < 1e-3 and (got[r.doc_id][1] == (p >= toxicity.THRESHOLD and bool(r.text.strip())) or abs(p - toxicity.THRESHOLD) < 1e-3)
    assert len(got) == docs.count()


def test_toxicity_ratios_and_weights_against_a_dense_fit(labelled):
    """Log-count ratios by counting, and the regression by Newton's method on a dense matrix."""
    some, bits = labelled[0][:300], 9
    y = np.array([bool(r.toxic) for r in some])
    sets = [plain_toxicity_features(r.text[:2000], (4,), bits) for r in some]
    x = np.array([[float(k in s) for k in range(1 << bits)] for s in sets])
    pos, neg = x[y].sum(axis=0) + 1, x[~y].sum(axis=0) + 1
    ratio = np.where(x.any(axis=0), np.log((pos / pos.sum()) / (neg / neg.sum())), 0)
    scaled, sign, weight, l2 = np.hstack((x * ratio, np.ones((len(y), 1)))), np.where(y, 1.0, -1.0), np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()), 1e-2
    ridge = np.append(np.full(1 << bits, l2), 0)

    def value(v):
        return float((weight * np.logaddexp(0, -sign * (scaled @ v))).sum() + 0.5 * (ridge * v * v).sum())

    best = np.zeros((1 << bits) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(scaled @ best)))
        step = np.linalg.solve(scaled.T @ (scaled * (weight * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), scaled.T @ (weight * (p - y)) + ridge * best)
        best -= step
    rows = hashed.Rows([toxicity.features(r.text[:2000], hashed.Distinct(bits), (4,), bits) for r in some], 1 << bits)
    got, bias = toxicity._linear(rows, y, 1.0, l2)
    seen = ratio != 0
    mine = np.append(np.where(seen, got / np.where(seen, ratio, 1), 0), bias)
    assert value(mine) <= value(best) + 1e-4 and np.corrcoef(scaled @ mine, scaled @ best)[0, 1] > 0.999
    z = scaled @ mine
    a, b = toxicity.calibrate(z, y)
    # Its penalty is on the logarithm of the slope and on the place of the middle, of scores in units of their spread.
    at = lambda a, b: float(np.logaddexp(0, -sign * (a * z + b)).mean()) + 0.5e-3 * (math.log(a * z.std()) ** 2 + (b + a * z.mean()) ** 2)
    assert a > 0 and all(at(a, b) <= at(a * s, b + d) + 1e-6 for s in (0.5, 0.9, 1.1, 2) for d in (-0.5, -0.05, 0.05, 0.5))


def test_quality_query_against_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.graded(labels))
    got = {r.doc_id: r for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
    for r in docs.collect():
        s = sum(float(model.weights[k]) * v for k, v in plain_quality_features(r.text).items())
        above = [1 / (1 + math.exp(min(500, t - s))) for t in model.thresholds]
        expected = model.grades[0] + sum((b - a) * p for a, b, p in zip(model.grades, model.grades[1:], above))
        tail = above[model.grades.index(1) - 1] if 1 in model.grades[1:] else above[0]
        row = got[r.doc_id]
        if r.text.strip():
            assert abs(row.expected_grade - expected) < 1e-6 and abs(row.p_tail - tail) < 1e-6 and row.keep == (row.p_tail >= 0.5)
    assert len(got) == docs.count()


def test_quality_loss_and_gradient(labelled):
    """The loss by its definition, the gradient by finite differences, and a fit that no step improves."""
    some = labelled[0][:120]
    y = np.array([r.quality * (2 - r.toxic) for r in some])
    pairs = [quality.frequencies(r.text[:3000]) for r in some]
    width = (1 << quality.BITS) + 2
    rows = hashed.Rows([c for c, _ in pairs], width, [v for _, v in pairs])
    loss = quality.loss_of(rows, y, 2, 1e-5)
    rng = np.random.default_rng(4)
    used = np.unique(rows.columns)
    v = np.zeros(width + 2)
    v[used] = rng.normal(size=len(used))
    v[-2:] = (-0.7, 0.3)
    theta = (-0.7, -0.7 + math.exp(0.3))
    total = 0.0
    for r, grade in zip(some, y):
        s = sum(float(v[k]) * x for k, x in plain_quality_features(r.text[:3000]).items())
        below = [1 / (1 + math.exp(s - t)) for t in theta]
        total -= math.log([below[0], below[1] - below[0], 1 - below[1]][grade])
    value, grad = loss(v)
    assert abs(value - total / len(y) - 0.5e-5 * float(v[:width] @ v[:width])) < 1e-5
    for k in [*rng.choice(used, 20).tolist(), width - 2, width - 1, width, width + 1]:
        e = np.zeros(len(v))
        e[k] = 1e-5
        assert abs((loss(v + e)[0] - loss(v - e)[0]) / 2e-5 - grad[k]) < 1e-6
    model = quality.fit_features(pairs, y)
    gap = np.log(np.diff(model.thresholds))
    at = np.concatenate((model.weights, model.thresholds[:1], gap))
    least, slope = loss(at)
    assert np.linalg.norm(slope) < 0.05 * np.linalg.norm(loss(np.zeros(width + 2))[1])
    assert all(loss(at + rng.normal(scale=0.01, size=len(at)) * np.isin(np.arange(len(at)), [*used, width, width + 1]))[0] > least - 1e-4 for _ in range(20))


def test_repetition_does_not_depend_on_place():
    points = hashed.code_points("ab ab ab cd")
    assert quality.repetition(points) == (2 / 3, 0.5)
    assert quality.repetition(hashed.code_points("")) == (0.0, 1.0) and quality.repetition(hashed.code_points("one")) == (0.0, 1.0)


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_of_awkward_rows(spark, labelled):
    train, _ = labelled
    model = toxicity.fit_rows([r.text for r in train[:600]], np.array([r.toxic for r in train[:600]]))
    docs = cases.awkward(spark).unionByName(cases.documents(spark, [(30, "you are an idiot and a moron, you pathetic worthless clown")]))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if r.toxic} == {30} and all(0 <= r.p_toxic <= 1 for r in got)
    assert cases.same(toxicity.score(cases.crowded(docs), model), toxicity.score(docs, model))
    assert toxicity.score(cases.empty(spark), model).count() == 0


def test_fits_on_awkward_labels(spark):
    docs = cases.awkward(spark)
    none = spark.createDataFrame([], LABELS)
    assert not toxicity.score(docs, toxicity.fit(docs, none)).where("toxic").count()
    one = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, 1, None), (None, 1, 1), (99, 1, 1)], LABELS)
    assert toxicity.score(docs, toxicity.fit(cases.crowded(docs), one)).where("NOT toxic").count() == 3
    graded = quality.graded(one)
    assert quality.grade(docs, quality.fit(docs, none.withColumn("grade", F.lit(1)))).where("keep").count() == 0
    assert quality.grade(docs, quality.fit(cases.crowded(docs), graded)).where("keep").count() > 0
    assert toxicity.fit(cases.empty(spark), one).bias < 0


def test_labels_are_drawn_up_to_the_limit(spark):
    docs = cases.documents(spark, [(i, f"text {i}") for i in range(50)] * 2)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)], LABELS)
    drawn = toxicity.training_rows(docs, labels, "toxic", 20, 1)
    assert drawn.count() == 20 and drawn.select("_id").distinct().count() == 20


def test_grades_of_awkward_rows(spark, labelled):
    train, _ = labelled
    model = quality.fit_rows([r.text for r in train[:600]], np.array([r.quality * (2 - r.toxic) for r in train[:600]]))
    docs = cases.awkward(spark)
    got = quality.grade(docs, model)
    assert got.columns == [*docs.columns, "expected_grade", "p_tail", "keep"] and got.count() == docs.count()
    assert all(not r.keep and r.p_tail == 0 and r.expected_grade == 0 for r in got.collect() if r.text is None or not r.text.strip())
    crowded = quality.grade(cases.crowded(docs), model)
    assert crowded.count() == docs.count() and dict(crowded.dtypes)["keep"] == "boolean"
    assert quality.grade(cases.empty(spark), model).count() == 0
