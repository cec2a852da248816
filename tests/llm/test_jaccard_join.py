import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from quillpack.llm import jaccard_join as J


def brute(rows, threshold=J.THRESHOLD, n=J.N):
    sets = {k: set(J.shingles(t, n).tolist()) for k, t in rows if t is not None and k is not None}
    sets = {k: s for k, s in sets.items() if s}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def pairs(df):
    out = set()
    for r in df.collect():
        assert r.doc_id_a in r.ids_a and r.doc_id_b in r.ids_b
        out |= {(min(a, b), max(a, b)) for a in r.ids_a for b in r.ids_b if a != b}
    return out


def groups(found):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in list(parent)}


def variants(seed, size, rate, base=120):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    text = [rng.choice(vocabulary) for _ in range(base)]
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in text) for _ in range(size)]


def test_shingles():
    assert len(J.shingles("a b c a b")) == 3 and len(J.shingles("One")) == 1 and len(J.shingles(" .. ")) == 0 and len(J.shingles("")) == 0
    assert J.shingles("A, b! C").tolist() == J.shingles("a b c").tolist()


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.65, 0.9):
        hits = []
        for _ in range(300):
            common = int(400 * share)
            pool = rng.integers(0, 2**63, 800, dtype=np.uint64)
            a, b = np.unique(pool[:400]), np.unique(np.concatenate((pool[:common], pool[400 : 800 - common])))
            jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((J.signature(a) == J.signature(b)).mean() - jaccard)
        assert abs(np.mean(hits)) < 0.02


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got = brute([(r.doc_id, r.text) for r in docs.collect()]), pairs(J.near_pairs(docs))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100


@pytest.fixture
def small_nodes(monkeypatch):
    """Nodes are split and passed on at sizes that a test can afford."""
    monkeypatch.setattr(J, "BRUTE", 8)


def test_splitting_in_memory_keeps_the_recall(small_nodes):
    texts = [t for k in range(60) for t in variants(k, 4, 0.03)] + variants(999, 120, 0.02)
    sig = np.array([J.signature(J.shingles(t)) for t in texts])
    want = brute(list(enumerate(texts)))
    found = set()
    for run in range(3 * J.RUNS):
        s = J.Splitter(J.THRESHOLD, J.T, run + 1)
        s.node(np.arange(len(texts)), sig, run + 1, 0)
        found |= {tuple(p) for p in s.take().tolist()}
    assert len(found & want) >= 0.9 * len(want)


def test_a_tight_node_is_compared_in_one_task(spark):
    """Sets that splitting would not part end in brute force, at any level."""
    texts = variants(5, 300, 0.02)
    sig = np.array([J.signature(J.shingles(t)) for t in texts])
    splitter = J.Splitter(J.THRESHOLD, J.T, 1)
    splitter.node(np.arange(300), sig, 7, 40)
    assert {tuple(p) for p in splitter.take().tolist()} >= brute(list(enumerate(texts)))


@pytest.mark.parametrize("broadcast", [J.BROADCAST_NODES, 0])
def test_large_nodes_are_split_by_blocks_and_tiles(spark, monkeypatch, broadcast):
    """With blocks of 20 sets nearly all goes the way of large nodes; it finds what brute force finds."""
    monkeypatch.setattr(J, "LOCAL", 20)
    monkeypatch.setattr(J, "BRUTE", 8)
    monkeypatch.setattr(J, "BROADCAST_NODES", broadcast)
    rows = list(enumerate([*variants(1, 150, 0.02), *(t for k in range(40) for t in variants(100 + k, 3, 0.02)), *(f"the same start of all texts then {t}" for t in variants(7, 60, 0.9, 12))]))
    docs = cases.documents(spark, rows)
    want, got = brute(rows), pairs(J.near_pairs(docs))
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 10_000
    assert classes(J.near_classes(docs)) == brute_classes(rows)


def test_a_tight_node_passes_its_pairs_on(monkeypatch):
    """A node of many near sets never has all its pairs in memory: a task that splits it hands them on in batches."""
    monkeypatch.setattr(J, "FLUSH", 5000)
    texts = variants(5, 1500, 0.02)
    sig = np.array([J.signature(J.shingles(t)) for t in texts])
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(1500, np.int32)), pa.array(np.full(1500, 7)), pa.array(np.ones(1500, np.int32)), pa.array(np.arange(1500)), pa.array([x.tobytes() for x in sig]), pa.array(np.zeros(1500, np.int64))],
        names=["run", "path", "level", "sid", "sig", "hub"],
    )
    sizes, found = [], set()
    for batch in J._split(J.THRESHOLD, J.T)(iter([rows])):
        sizes.append(batch.num_rows)
        found |= set(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    assert max(sizes) <= 5000 + (1 << 22) // J.T and len(sizes) > 20
    assert len(found) > 1_000_000


def test_hubs_are_counted_and_not_spread_as_pairs(spark, monkeypatch):
    """Clusters above HOT, whether their nodes are above LOCAL or not, give few candidate pairs, but every link, class and pair, also across the blocks of a hub and to sets outside of it."""
    monkeypatch.setattr(J, "LOCAL", 300)
    monkeypatch.setattr(J, "HUB_SETS", 120)
    rows = list(enumerate([*variants(1, 400, 0.02), *variants(2, 280, 0.02), *(t for k in range(20) for t in variants(100 + k, 3, 0.02))]))
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    docs, want, spread, candidates = cases.documents(spark, rows), brute(rows), [], J._candidates
    monkeypatch.setattr(J, "_candidates", lambda *a: spread.append(J.durable(candidates(*a))) or spread[-1])
    joined = J._join(docs, J.N, J.THRESHOLD, J.RECALL, J.T, "doc_id", "text")
    monkeypatch.setattr(J, "_join", lambda *_: joined)
    assert joined[2].select("hub").distinct().count() == 2 and sum(df.count() for df in spread) < 0.1 * len(want)
    assert classes(J.near_classes(docs)) == brute_classes(rows)
    assert pairs(J.near_pairs(docs)) == want
    label = groups(want)
    assert {r.doc_id for r in J.keep_one(docs).collect()} == {k for k, _ in rows if label.get(k, k) == k}


def test_every_root_has_coordinates():
    assert all(len(J.chosen(run + 1, 0, run + 1, J.T, J.THRESHOLD)) for run in range(200))


def test_root_sizes_count_the_roots(spark):
    sets = J._sets(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), J.N, J.T, "doc_id", "text").where("sid IS NOT NULL")
    rows = sets.select("sid", "sig").mapInArrow(J._roots(range(3), J.THRESHOLD, J.T), J._NODE)
    want = {(r.run, r.path): r["count"] for r in rows.groupBy("run", "path").count().collect()}
    got = sets.select("sig").mapInArrow(J._root_sizes(range(3), J.THRESHOLD, J.T), "run int, path long, n long").groupBy("run", "path").agg({"n": "sum"}).collect()
    assert {(r.run, r.path): r["sum(n)"] for r in got} == want and want


def classes(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def brute_classes(rows, threshold=J.THRESHOLD):
    """(doc_id, class_id, n_links) of documents with one text each, by plain sets."""
    found = brute(rows, threshold)
    label, links = groups(found), {}
    for a, b in found:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    return sorted((k, label.get(k, k), links.get(k, 0)) for k, _ in rows)


def test_classes_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = classes(J.near_classes(docs)), brute_classes(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)
    # Every link is counted at both of its ends, copies each for themselves.
    assert 0.97 * sum(w[2] for w in want) <= sum(g[2] for g in got) <= sum(w[2] for w in want)


def test_classes_of_awkward_rows(spark):
    docs = cases.awkward(spark).unionByName(cases.documents(spark, [(50, ""), (50, ""), (51, "tie one two three four"), (None, None)]))
    got = [(r.doc_id, r.class_id, r.n_links) for r in J.near_classes(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (None, None, 0), (4, 4, 2), (5, 4, 2), (51, 4, 2), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (50, 50, 0)]))
    assert cases.same(J.near_classes(cases.crowded(docs)), J.near_classes(docs))
    assert J.near_classes(cases.empty(spark)).count() == 0


def test_long_texts_count_whole(spark):
    """Two texts that differ only far behind are near; two that agree only at their start are not."""
    start, a, b = variants(1, 1, 0, 3000)[0], variants(2, 1, 0, 60_000)[0], variants(3, 1, 0, 60_000)[0]
    docs = cases.documents(spark, [(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {a} and a little more")])
    assert classes(J.near_classes(docs)) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]


def test_groups_of_copies_and_near_copies(spark):
    rows = [(i, t) for i, t in enumerate(variants(1, 150, 0.02))]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(2000 + i, t) for i, t in enumerate(t for k in range(40) for t in variants(100 + k, 2, 0.01))]
    rows += [(3000 + i, variants(500 + i, 1, 0)[0]) for i in range(50)]
    docs = cases.documents(spark, rows)
    want, got = brute(rows), pairs(J.near_pairs(docs))
    assert got <= want and len(got) >= 0.95 * len(want)
    kept = {r.doc_id for r in J.keep_one(docs).collect()}
    label = groups(want)
    assert kept == {k for k, _ in rows if label.get(k, k) == k}


def test_recall_estimate():
    assert J.estimated_recall(0, 0, 0) == 1.0 and J.estimated_recall(0, 10, 100) == 1.0
    assert J.estimated_recall(50, 10, 100) < 0.6


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = pairs(J.near_pairs(docs))
    assert got == {(4, 5)}
    assert cases.same(J.near_pairs(cases.crowded(docs)), J.near_pairs(docs))
    assert J.near_pairs(cases.empty(spark)).count() == 0
    kept = J.keep_one(cases.crowded(docs))
    assert kept.columns == cases.crowded(docs).columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, 1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert J.keep_one(cases.empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.x: r.label for r in J.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == groups(chain)
