import math
from fractions import Fraction

import cases
from pyspark.sql import functions as F

from quillpack.llm import rules as R


def exact_tail(k, n, p):
    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact():
    for n in (1, 7, 60):
        for k in range(n + 1):
            assert math.isclose(R.binomial_tail(k, n, 0.02), exact_tail(k, n, 0.02), rel_tol=1e-9)


def test_rates(spark):
    text = F.col("text")
    docs = cases.documents(spark, [(1, "a a B 1#"), (2, ""), (3, "the the the cat"), (4, "  \n ")])
    got = {r.doc_id: r for r in docs.select("doc_id", "text", R.words_of(text).alias("words")).select("doc_id", *[c.alias(n) for n, c in R.rates(text, F.col("words")).items()]).collect()}
    assert (got[1].symbol_rate, got[1].upper_rate, got[1].digit_rate, got[1].repeat_rate) == (1 / 8, 1 / 8, 1 / 8, 1 / 4)
    assert got[3].repeat_rate == 0.5 and got[2].repeat_rate == 0 and got[4].repeat_rate == 0


def test_cutoffs_against_brute_force(spark):
    measured, good = [], []
    for i in range(2000):
        measured.append((i, i, "en" if i % 4 else None, (i % 100) / 100 if i % 50 == 0 else 0.01, 0.02, 0.0, 0.0))
        if i % 5:
            good.append((i,))
    frame = spark.createDataFrame(measured, "doc_id long, th long, lang string, symbol_rate double, upper_rate double, digit_rate double, repeat_rate double").withColumn("stratum", R.stratum_key("lang"))
    got = {r.stratum: r for r in R.calibrate(frame, spark.createDataFrame(good, "doc_id long"), 0.05, 0.1).collect()}
    ids = {g for (g,) in good}
    assert set(got) == {"=en", "NULL"}
    for name, lang in (("=en", "en"), ("NULL", None)):
        values = [m[3] for m in measured if m[2] == lang and m[0] in ids]
        best = None
        for c in R.CUTOFFS:
            k = sum(v > c for v in values)
            if exact_tail(k, len(values), 0.05) > 0.1 / 8:
                break
            best = c
        assert got[name].symbol_rate == best and got[name].n_good == len(values)


def test_few_good_documents_certify_nothing(spark):
    docs = cases.documents(spark, [(i, "#### $$$$") for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert R.quality_rules(docs, labels).where("NOT keep").count() == 0


def test_good_documents_are_kept_and_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    judged = R.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id")
    rate = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.5


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = R.quality_rules(docs, labels)
    assert got.count() == docs.count() and got.where("NOT keep").count() == 0
    assert [r.symbol_rate for r in got.where("doc_id IN (2, 3)").collect()] == [0.0, 0.0]
    assert cases.same(R.quality_rules(cases.crowded(docs), labels), got)
    assert R.quality_rules(cases.empty(spark), labels.limit(0)).count() == 0
