"""The pipeline, and the entry module with and without it."""

import os

import cases
import pytest

import corpus_pipeline as C
from quillpack.llm import common, jaccard_join, mixing, packing, quality
from test_jaccard_join import brute as brute_pairs
from test_jaccard_join import groups
from test_line_dedup import brute as brute_lines
from test_mixing_packing import check_mix, measured


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, over the table and awkward rows."""
    d = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{d}/documents.parquet")
    extra = [(None, "words of a document without any id at all, but of good length"), (5001, ""), (5002, None), (5003, "une phrase de plus pour la fin"), (5003, "une phrase de plus pour la fin")]
    docs = base.unionByName(cases.documents(spark, extra))
    folder = tmp_path_factory.mktemp("stages")
    out = []
    for k, (_, f) in enumerate(C.STAGES):
        f(spark, docs, d).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_the_stages_stand_in_order():
    assert [name for name, _ in C.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_schemas(stages):
    for before, after in stages[:-1]:
        assert after.columns == list(C.COLUMNS) and after.dtypes == stages[0][0].dtypes and after.count() <= before.count()


def test_quality_stage(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(before, quality.graded(labels))
    want = [r.doc_id for r in before.collect() if r.text and not r.text.isspace() and quality.score_text(model, r.text)[0] >= 0.5]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in after.collect())


def test_line_stage(stages):
    before, after = stages[1]
    want = {}
    for (doc_id, text), keep in brute_lines([(r.doc_id, r.text) for r in before.collect()]).items():
        kept = "\n".join(x for x, k in zip(text.split("\n"), keep, strict=True) if k)
        if kept.replace("\n", "").strip(" "):
            want[doc_id] = kept
    assert {r.doc_id: r.text for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_join_stage(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    label = groups(brute_pairs(rows))
    assert sorted(map(str, (k for k, _ in rows if label.get(k, k) == k))) == sorted(str(r.doc_id) for r in after.collect())


def test_mixing_stage(stages):
    before, after = stages[3]
    rows = [(str(i), s, n, h) for i, s, n, h in measured(before)]
    check_mix(rows, [str(r.doc_id) for r in after.collect()], mixing.SHARE)


def test_packing_stage(stages):
    before, after = stages[4]
    assert cases.same(after, packing.pack_balanced(before)) and after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_run_goes_through_all_stages(spark):
    shared = common.ensure_checkpoint_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(shared))
    rows = C.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and C.ORACLE_SQL is None and jaccard_join.N == 2
    # Only the last stage's rows are left of the run.
    (left,) = (x for x in set(os.listdir(shared)) - before if x.startswith(("pipeline-", "stored-")))
    assert os.listdir(os.path.join(shared, left)) == ["4"]


def test_every_stage_takes_an_empty_table(spark):
    for _, f in C.STAGES:
        assert f(spark, cases.empty(spark), "/root/testdata/sf0.001").count() == 0
