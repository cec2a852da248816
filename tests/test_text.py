"""Tokens, the minifier and phrase compression."""

import random

import pytest
from pyspark.sql import functions as F

from quillpack.functions import phrases as P
from quillpack.functions.minify import minify, minify_udf
from quillpack.functions.tokens import token_estimate
from quillpack.operators import lines, transforms

TOKENS = {"XMLParser": 2, "IConfigurationValidator": 3, "_configurationValidator": 2, "foo_bar": 1, "public async Task<Result>": 6, "abcтекdef": 1, "日start": 2, "": 0}
MINIFIED = [
    ("int x = 5; // this is a comment", None, "int x = 5;"), ("int x = 5; /* multi\nline\ncomment */ int y = 10;", None, "int x = 5;\n  int y = 10;"),
    ('var s = "hello // not a comment";', None, 'var s ="hello // not a comment" ;'), ("public    static    void    Main()", None, "public static void Main()"),
    ("   public void Foo()   ", None, "   public void Foo()"), ("a\n   \n  b", None, "a\n     b"), ("    // c\n    foo();", "cs", "        foo();"), ('x  "y";', "cs", 'x"y" ;'),
    ("#[derive(Debug)]\nstruct A;", None, "struct A;"), ("see https://a.b/c", None, "see https://a.b/c"), ("#!/bin/sh\n# c\necho", "bash", "#!/bin/sh\necho"),
    ('x = R"a"', "py", 'x =r"a"'), ("a // c\rb\nc", "cs", "a\nc"), ("", "cs", ""), (None, "cs", None), ("<!-- c --><p>a</p>", "html", " <p>a</p>"), ("SELECT 1 -- one\nFROM t", "sql", "SELECT 1\nFROM t"),
]


def test_tokens(spark):
    texts = list(TOKENS)
    rng = random.Random(42)
    texts += ["".join(rng.choice("aZ9_ .-\n\t(é日😀") for _ in range(rng.randrange(60))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.n for r in rows.select("k", token_estimate(F.col("t")).alias("n")).collect()}
    assert [got[k] for k in range(len(TOKENS))] == list(TOKENS.values())
    assert all(got[k] == P.count_tokens(t) for k, t in enumerate(texts))
    assert spark.range(1).select(token_estimate(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("code,language,expected", MINIFIED)
def test_minify(code, language, expected):
    assert minify(code, language) == expected


def test_minify_of_columns(spark):
    rows = spark.createDataFrame([(c, x) for c, x, _ in MINIFIED], "c string, x string")
    assert [r[0] for r in rows.select(minify_udf("c", "x")).collect()] == [e for _, _, e in MINIFIED]


def test_minify_of_documents_is_that_of_each_text(spark):
    from quillpack.plans.queries import QUERIES
    from quillpack.sources.tables import document_files

    d = "/root/testdata/sf0.001"
    want = {r.ord: minify(r.content, r.language) for r in document_files(spark, d).collect()}
    assert {r.ord: r.content for r in QUERIES["minify"](spark, d).collect()} == want


def test_suffix_array():
    assert P.suffix_array("banana").tolist() == [5, 3, 1, 0, 4, 2] and P.suffix_array("").tolist() == []
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randrange(1, 60)))
        order = P.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = P.common_prefixes(text, order).tolist()
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_phrases_save_and_come_back():
    for text in ("bucketCapacityMask = true; " * 15, "\n".join(["var x = ConfigurationValidatorServiceInstance;"] * 20)):
        done = P.compress(text)
        assert done.replacements >= 1 and done.tokens_saved > 0 and len(done.output) < len(text) and P.expand(done.output, done.legend) == text
    assert P.compress("int x = 1; " * 20).replacements == 0
    assert P.compress("").output == "" and P.compress(None).output is None


def test_only_code_in_fences_is_compressed():
    line = "ConfigurationValidatorServiceInstance.Run();"
    text = "\n".join(["```cs", *[line] * 20, "```", line, "```json", line, "```"])
    done = P.compress(text)
    assert done.output.split("\n")[-4:] == [line, "```json", line, "```"] and P.expand(done.output, done.legend) == text


def test_phrase_candidates_against_brute_force(spark):
    texts = ["the quick brown fox; " * 4 + "x", "short", None, "", "abcdefghijklmnop\nabcdefghijklmnop\nabcdefghijklmnop"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in transforms.phrase_candidates(docs, "doc_id", "text").collect():
        text = texts[r.doc_id]
        assert text.count(r.phrase) == r.frequency >= 3 and r.savings == (len(r.phrase) - 1) * r.frequency and "\n" not in r.phrase and len(r.phrase) >= 11
    transforms.register_phrase_table(spark)
    assert spark.sql("SELECT * FROM frequent_phrases('alpha beta gamma; alpha beta gamma; alpha beta gamma; ')").count() > 0


def test_transforms_in_sequence(spark):
    docs = spark.createDataFrame([("bucketCapacityMask = true; " * 15,), ("nothing",)], "document string")
    got = transforms.apply_transforms(docs, [transforms.compress_phrases(), transforms.pipe_through(["tr", "a-z", "A-Z"])]).collect()
    assert got[0].tokens_saved > 0 and got[0].document.startswith(transforms.CONTEXT_HEADER) and "NOTHING" in got[1].document
    kept = transforms.apply_transforms(docs, [transforms.pipe_through(["false"])]).collect()
    assert kept[1].document.endswith("nothing")


def test_lines(spark):
    one = spark.createDataFrame([("a\r\n  // b\n\x85c \n  \nd",)], "t string")
    assert one.select(lines.drop_lines(F.col("t"), ["//"])).first()[0] == "a\n\nc\n\n  \nd"
    assert one.select(lines.drop_lines(F.col("t"), ["\\n", "//"])).first()[0] == "a\nc\nd"
    assert one.select(lines.drop_lines(F.col("t"), [""])).first()[0] == "a\r\n  // b\n\x85c \n  \nd"


def peak_mb(f):
    """MB that Python and numpy hold at most while f runs."""
    import tracemalloc

    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def as_bytes(texts):
    import numpy as np

    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]).astype(np.int32)


def test_tokens_are_counted_in_pieces(monkeypatch):
    """A batch's count takes no more memory than that of a piece, and cuts in long texts change nothing."""
    from quillpack.functions import tokens as N

    rng = random.Random(7)
    for piece in (1, 3, 20):
        monkeypatch.setattr(N, "PIECE", piece)
        for _ in range(60):
            texts = ["".join(rng.choice("aZ9_ .-\n(é日😀") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
            assert N.count_batch(*as_bytes(texts)).tolist() == [P.count_tokens(t) for t in texts]
    monkeypatch.undo()
    for texts in (["some words of a text; " * 50] * 8000, ["some words of a text; " * 400_000]):
        batch = as_bytes(texts)
        assert peak_mb(lambda: N.count_batch(*batch)) < 60  # noqa: B023
        assert N.count_batch(*batch).sum() == 6 * 400_000


def test_minified_texts_leave_memory_in_pieces():
    import pyarrow as pa

    from quillpack.functions.minify import minify_batch

    for texts in (["some words of a  text\n" * 400] * 1200, ["some words of a  text\n" * 100_000] * 2):
        code, language, out = pa.array(texts), pa.array(["html"] * len(texts)), []
        assert peak_mb(lambda: out.append(minify_batch(code, language))) < 20  # noqa: B023
        assert out[0].to_pylist() == [t.replace("  ", " ") for t in texts]
    assert minify_batch(pa.array([None, "", "a  b"]), pa.array(["cs", None, None])).to_pylist() == [None, "", "a b"]


def test_phrases_of_many_texts_leave_in_pieces(spark):
    """Rows of phrases are sent on as they are found, not held for a whole batch of texts."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["quick brown fox", "lazy dog jumps", "over the fence", "red\n"]) for _ in range(k)) for k in range(0, 300, 10)]
    docs = spark.createDataFrame([*((k % 28, t) for k, t in enumerate(texts)), (None, texts[-1])], "doc_id int, text string").coalesce(1)
    found = transforms.phrase_candidates(docs, "doc_id", "text")
    want = [(k, *row) for k, t in [*((k % 28, t) for k, t in enumerate(texts)), (None, texts[-1])] for row in P.frequent_phrases(t)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and want
    assert found.dtypes == [("doc_id", "int"), ("phrase", "string"), ("frequency", "int"), ("savings", "int")] and "MapInArrow" in found._jdf.queryExecution().toString()
    held = []

    def many():
        for k in range(95):
            held.append(k)
            yield k, 1

    assert [(len(x), len(held)) for x in transforms._gathered(many(), 10)][:3] == [(10, 10), (10, 20), (10, 30)]


def test_compressed_texts_leave_in_pieces(spark):
    text = "\n".join(f"var x{k} = ConfigurationValidatorServiceInstance({k * k});" for k in range(30))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([text, None, "", "short"] * 3)], "k int, document string").coalesce(1)
    got = sorted(transforms.compress_phrases()(docs).collect())
    assert [(r.document, r.legend, r.tokens_saved) for r in got] == [(d.output, d.legend, d.tokens_saved) for d in map(P.compress, [text, None, "", "short"] * 3)]
    assert got[0].tokens_saved > 0


def test_repeated_words_are_not_all_counted(monkeypatch):
    """A run of n characters has n nested ranges; those whose places are too close together are never walked."""
    counted, real = [], P._apart
    monkeypatch.setattr(P, "_apart", lambda places, length: counted.append(len(places)) or real(places, length))
    text = "Theo " * 800
    found = P.frequent_phrases(text)
    assert len(counted) < len(text) / 2 and len(found) > 50
    assert all(text.count(p) == k for p, k, _ in found)
