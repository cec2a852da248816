import cases
from hypothesis import given
from hypothesis import strategies as st

from quillpack.llm import line_dedup as L


@given(st.lists(st.booleans(), max_size=60))
def test_runs_round_trip(bits):
    assert L.decode_runs(L.encode_runs(len(bits), [i for i, b in enumerate(bits) if b])) == bits


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line in text.split("\n") if text is not None else []:
            keep.append(not line.strip(" ") or line not in seen)
            seen.add(line)
        out[(doc_id, text)] = keep
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {k[0]: v for k, v in brute([(r.doc_id, r.text) for r in docs.collect()]).items()}
    got = {r.doc_id: r for r in L.line_dedup(docs).collect()}
    assert got.keys() == want.keys()
    for k, keep in want.items():
        assert L.decode_runs(got[k].keep_runs) == keep
        assert (got[k].n_lines, got[k].n_kept) == (len(keep), sum(keep))


def test_a_line_of_many_documents_stays_once(spark):
    docs = cases.documents(spark, [(i, f"shared\nown {i}\n\nshared") for i in range(500)]).repartition(7)
    got = {r.doc_id: r.keep_runs for r in L.line_dedup(docs).collect()}
    assert got[0] == "k3d1"
    assert all(got[i] == "d1k2d1" for i in range(1, 500))


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = L.line_dedup(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_kept, r.keep_runs))
    assert got[2] == [(1, 1, "k1")] and got[3] == [(0, 0, "")] and got[6] == [(2, 2, "k2")]
    assert got[4] == [(1, 1, "k1")] and got[5] == [(1, 0, "d1")]
    assert sorted(got[1]) == [(1, 1, "k1"), (2, 2, "k2")] and len(got[None]) == 1
    assert got[9] == [(2, 1, "k1d1")]
    assert cases.same(L.line_dedup(cases.crowded(docs)), L.line_dedup(docs))
    assert L.line_dedup(cases.empty(spark)).count() == 0


def test_apply_bitmaps(spark):
    docs = cases.awkward(spark)
    got = L.apply_bitmaps(docs)
    assert got.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert (5, "tie one two three four") not in texts and (4, "tie one two three four") in texts
    assert (9, "un été à la mer, ça va") in texts and not {2, 3, 6} & {t[0] for t in texts}
    assert [t for t in texts if t[0] == 1] == [(1, "alpha beta gamma delta\nsecond line here"), (1, "one id with another text altogether")]
    crowded = L.apply_bitmaps(cases.crowded(docs))
    assert crowded.count() == len(texts) and crowded.columns == cases.crowded(docs).columns
