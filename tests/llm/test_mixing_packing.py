import itertools
import random

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpack.llm import common
from quillpack.llm import mixing as M
from quillpack.llm import packing as P

POOL = st.lists(st.tuples(st.integers(1, 40), st.integers(1, 3)), max_size=6, unique_by=lambda p: p[0])


@given(POOL, st.integers(0, 200))
@settings(deadline=None)
def test_subset_sum_is_the_best(pool, budget):
    lengths, counts = np.array([n for n, _ in pool], dtype=np.int64), np.array([c for _, c in pool], dtype=np.int64)
    take = M.subset_sum(lengths, counts, budget)
    best = max((s for pick in itertools.product(*[range(c + 1) for _, c in pool]) if (s := sum(k * n for k, (n, _) in zip(pick, pool))) <= budget), default=0)
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == best


def test_budgets_are_met_exactly_and_shares_follow():
    rng = random.Random(1)
    lengths = np.array(sorted({rng.randint(5, 4000) for _ in range(900)}))
    counts = np.array([rng.randint(1, 500) for _ in lengths])
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total - 7, total, total + 1):
        take = M.fit_budget(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take >= 0).all() and (take <= counts).all() and got <= budget
        if budget >= total:
            assert got == total
        else:
            assert got == budget or budget in (1, total - 7) and got > budget - 20
    take = M.fit_budget(lengths, counts, total // 2)
    assert (abs(take - counts / 2)[counts >= 100] <= 40).all()


@given(POOL, st.integers(0, 200))
@settings(deadline=None)
def test_a_budget_is_met_whenever_it_can_be(pool, budget):
    take = M.fit_budget(np.array([n for n, _ in pool], dtype=np.int64), np.array([c for _, c in pool], dtype=np.int64), budget)
    assert all(0 <= t <= c for t, (_, c) in zip(take, pool)) and sum(int(t) * n for t, (n, _) in zip(take, pool)) == best_sum([n for n, c in pool for _ in range(c)], budget)


def best_sum(lengths, budget):
    """The largest sum up to budget of some of the lengths: bit k of a number says whether k is a sum."""
    sums, mask = 1, (1 << budget + 1) - 1
    for n in lengths:
        sums |= sums << n & mask
    return sums.bit_length() - 1


def budgets(total, tokens, temperature=0.7):
    """Each source's tokens, by giving small sources all they have one after the other."""
    w, out, left = {s: float(t) ** temperature for s, t in total.items()}, {}, dict(total)
    while left:
        level = tokens / sum(w[s] for s in left)
        short = [s for s in left if left[s] <= level * w[s]]
        if not short:
            return out | {s: int(level * w[s] + 1e-6) for s in left}
        s = min(short, key=lambda s: left[s] / w[s])
        tokens -= left[s]
        out[s] = left.pop(s)
    return out


def check_mix(rows, chosen, share):
    """rows: (doc_id, source, n, hash). chosen: ids. Every source's sum is the best there is, and of each length the ids of the least hashes are taken."""
    total = {}
    for _, s, n, _ in rows:
        if n:
            total[s] = total.get(s, 0) + n
    assert len(chosen) == len(set(chosen))
    taken = set(chosen)
    for s, budget in budgets(total, share * sum(total.values())).items():
        mine = [r for r in rows if r[1] == s and r[2]]
        assert sum(n for i, _, n, _ in mine if i in taken) == best_sum([n for _, _, n, _ in mine], budget)
        for length in {n for _, _, n, _ in mine}:
            ids = [i for _, i in sorted((h, i) for i, _, n, h in mine if n == length)]
            k = sum(i in taken for i in ids)
            assert set(ids[:k]) == {i for i in ids if i in taken}
    return total


def measured(docs, seed=17):
    """(doc_id, source, tokens, seeded hash) of documents."""
    encode = common.encoding(common.TOKENIZER).encode_ordinary
    return [(r.doc_id, r.source, len(encode(r.text or "")), r.h) for r in docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))).collect()]


def test_mix_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, got = measured(docs), M.mix_sources(docs, share=M.SHARE).collect()
    lengths = {i: n for i, _, n, _ in rows}
    assert all(lengths[r.doc_id] == r.n_tokens for r in got)
    total = check_mix(rows, [r.doc_id for r in got], M.SHARE)
    assert 0.99 * M.SHARE * sum(total.values()) <= sum(r.n_tokens for r in got) <= M.SHARE * sum(total.values()) and len(total) > 2
    assert cases.same(M.mix_sources(docs, share=M.SHARE).drop("th"), M.mix_sources(docs.repartition(5), share=M.SHARE).drop("th"))
    assert sorted(r.doc_id for r in M.select_mix(docs, share=M.SHARE).collect()) == sorted(r.doc_id for r in got)


def test_hot_lengths_are_ranked_in_slices(spark, monkeypatch):
    """A third of all documents of one length and source, in slices of a few rows, with and without broadcast cutoffs; repeated rows are counted one by one."""
    rows = [(i, f"word {i % 90 + 10} here", "en", "hot") for i in range(400)] + [(1000 + i, "word " * (2 + i % 30), "en", "b") for i in range(600)]
    docs = cases.documents(spark, rows)
    want = sorted(r.doc_id for r in M.mix_sources(docs, share=0.5).collect())
    check_mix(measured(docs), want, 0.5)
    for slice_, most in ((7, M.BROADCAST_CUTS), (7, 0)):
        monkeypatch.setattr(M, "SLICE", slice_)
        monkeypatch.setattr(M, "BROADCAST_CUTS", most)
        assert sorted(r.doc_id for r in M.mix_sources(docs, share=0.5).collect()) == want
        assert sorted(r.doc_id for r in M.select_mix(docs, share=0.5).collect()) == want
    repeated = cases.documents(spark, [(1, "one two three", "en", "s")] * 60 + [(2, "one two three", "en", "s")] * 40)
    assert M.mix_sources(repeated, share=0.5).count() == 50


def test_mix_to_given_weights(spark):
    docs = cases.documents(spark, [(i, "word " * (1 + i % 9), "en", "a" if i % 3 else "b") for i in range(600)] + [(900, "c c", "en", "c")])
    got = {r.source: r.n for r in M.mix_sources(docs, {"a": 3, "b": 1}, budget=800).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {"a": 600, "b": 200}


def test_mix_of_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = M.mix_sources(docs, {"a": 1.0, "b": 1.0}, budget=10**9)
    assert got.where("source IS NULL").count() == 0 and got.where("doc_id = 1").count() == 3 and got.where("doc_id IN (2, 3)").count() == 0
    assert M.mix_sources(docs, budget=10**9).where("source IS NULL").count() == 2
    assert cases.same(M.mix_sources(cases.crowded(docs)), M.mix_sources(docs))
    assert M.mix_sources(cases.empty(spark)).count() == 0 and M.select_mix(cases.empty(spark)).count() == 0
    kept = M.select_mix(cases.crowded(docs), budget=10**9)
    assert kept.columns == cases.crowded(docs).columns and kept.count() == docs.count() - 2


def brute_pack(lengths, capacity, linear, quadratic):
    size = max(1, -(-sum(lengths) // capacity))
    cost, free, out = [0.0] * size, [capacity] * size, []
    for n in lengths:
        fits = [k for k in range(len(cost)) if free[k] >= n]
        if not fits:
            cost.append(0.0)
            free.append(capacity)
            fits = [len(cost) - 1]
        k = min(fits, key=lambda j: (cost[j], j))
        cost[k] += linear * n + quadratic * n * n
        free[k] -= n
        out.append(k)
    return out


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(deadline=None)
def test_assignment_against_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    assert P.assign(np.array(lengths, dtype=np.int64), 50, 1.0, 0.5).tolist() == brute_pack(lengths, 50, 1.0, 0.5)


def test_packing_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = common.encoding(common.TOKENIZER).encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    got = P.pack_balanced(docs, capacity=4096, docs_per_group=80).collect()
    tokens, load, cost, group = {}, {}, {}, {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        key = (r.pack_group, r.seq)
        load[key], cost[key] = load.get(key, 0) + r.n_tokens, cost.get(key, 0) + r.cost
        group.setdefault(r.pack_group, []).append(r)
        assert r.first_token == r.piece * 4096
    assert tokens == {k: n for k, n in want.items() if n} and max(load.values()) <= 4096 and len(group) > 1
    for rows in group.values():
        rows.sort(key=lambda r: -r.n_tokens)
        assert sorted(zip([r.n_tokens for r in rows], brute_pack([r.n_tokens for r in rows], 4096, 1.0, 1 / 24_576))) == sorted((r.n_tokens, r.seq) for r in rows)
    full = [c for k, c in cost.items() if load[k] > 3000]
    assert max(full) < 2.5 * min(full)


def test_packing_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = P.pack_balanced(docs)
    assert got.where("doc_id IN (2, 3)").count() == 0 and got.where("doc_id IS NULL").count() == 1 and got.where("doc_id = 7 AND piece > 0").count() > 0
    assert got.where("doc_id = 1").count() == 3
    assert cases.same(P.pack_balanced(cases.crowded(docs)), got)
    assert P.pack_balanced(cases.empty(spark)).count() == 0


def test_tiny_and_null_sources_do_not_shrink_a_hot_one(spark):
    rows = [(i, "word " * (1 + i % 9), "en", "hot") for i in range(2000)] + [(5000 + i, "word " * 5, "en", "mid") for i in range(200)] + [(9000, "c c", "en", "tiny"), (9001, "d d d", "en", None)]
    docs = cases.documents(spark, rows).withColumn("source", F.when(F.col("doc_id") != 9001, F.col("source")))
    every = {r.source: r.n for r in M.mix_sources(docs, share=1.0).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    got = {r.source: r.n for r in M.mix_sources(docs, share=M.SHARE).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(every.values())
    assert len(every) == 4 and M.mix_sources(docs, share=1.0).count() == len(rows)
    assert got["tiny"] == every["tiny"] and got[None] == every[None] and got["mid"] == every["mid"]
    assert total * M.SHARE - 20 <= sum(got.values()) <= total * M.SHARE
