"""Globs and the other path filters."""

import pytest
from pyspark.sql import functions as F

from quillpack.functions import text as X
from quillpack.functions.globs import glob_match
from quillpack.operators import filters

GLOBS = [
    ("Test.cs", "test.cs", True), ("test", "test.cs", False), ("a/b/c", "*", True), ("test12.cs", "test?.cs", False), ("test1.cs", "test?.cs", True),
    ("test.cs", "**/*.cs", True), ("a/b/c/test.cs", "a/**/test.cs", True), ("main.cs", "*/*.cs", False), ("test/test_file.cs", "*/test/*", False),
    ("test/file.bench.cs", "*.bench.*", True), ("boost/algorithm.hpp", "**/boost/**", True), ("build_output.dll", "build/**", False),
    ("src/module/file.cs", "src/**/*.cs", True), ("src/a.cs", "src/**/*.cs", False), ("src", "src/**", False), ("x/prod.env", ".env", True), (".env.local", ".env", False),
    ("src\\a\\b.cs", "src/**/b.cs", True), ("a/bin/b", "bin", True), ("a/binary/b", "bin", False), ("bin", "bin/", False), ("a/bin/x", "bin/", True),
    ("a+b(c).txt", "a+b(c).txt", True), ("aab(c).txt", "a+b(c).txt", False), ("a/[x]/b", "[x]", True),
]


@pytest.mark.parametrize("path,pattern,expected", GLOBS)
def test_globs(spark, path, pattern, expected):
    assert spark.createDataFrame([(path,)], "p string").select(glob_match(F.col("p"), pattern)).first()[0] is expected


def test_any_of_several_globs(spark):
    one = spark.createDataFrame([("src/main.cs",)], "p string")
    assert [one.select(glob_match(F.col("p"), x)).first()[0] for x in (["*.txt", "*.json"], ["*.txt", "*.cs"], [])] == [False, True, False]


def test_rules_decide_in_order(spark):
    rules = filters.PathRules(extensions=(".CS",), exclude=("*.g.cs",), exclude_path=("old/**",), include_path=("src/**", "old/**"), search=("./src/",))
    rows = spark.createDataFrame([(p,) for p in ("a.py", "bin/a.cs", "src/a.g.cs", "old/a.cs", "lib/a.cs", "src/a.cs", "x/src/y.cs")], "p string")
    got = [r[0] for r in rows.select(filters.explain(F.col("p"), rules)).collect()]
    assert got == ["extension", "system_ignore", "exclude", "exclude_path", "include_path", "included", "include_path"]
    assert [r[0] for r in rows.where(filters.passes(F.col("p"), rules)).collect()] == ["src/a.cs"]


def test_filters_reach_the_scan_without_the_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("source") == "src1").select("doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_names_and_presets(spark):
    rows = spark.createDataFrame([(p,) for p in ("Dockerfile", "a/package.json", "x.", "y.json", "noext")], "p string")
    assert [r[0] for r in rows.where(filters.passes(F.col("p"), filters.PathRules(presets=("config",), system_ignore=()))).collect()] == ["Dockerfile", "a/package.json"]


def test_scalars(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column).first()[0]

    assert [value(X.language(F.lit(p))) for p in ("a.PY", "b/Makefile", "c.zig", "d")] == ["python", "makefile", "zig", "d"]
    assert [value(X.size_in_bytes(F.lit(s))) for s in ("100B", "1KB", "100MB", "10GB", "1", "", "x MB")] == [100, 1024, 104857600, 10737418240, None, None, None]
    assert [X.parse_size(s) for s in ("100B", "1KB", "100MB", "10GB")] == [100, 1024, 104857600, 10737418240] and X.parse_size("?", 7) == 7
    assert [value(X.module_key(F.lit(p))) for p in ("a/b", "a", "./a", "a\\b")] == ["a", "_root", "_root", "a"]
    assert value(X.fence_for(F.lit("a ```` b ``"))) == "`" * 5 and value(X.trim_end(F.lit("a \t\r\n"))) == "a"
    assert value(X.replace_word(F.lit("cat concat cat_ cat"), "cat", "$1")) == "$1 concat cat_ $1"
    assert X.parse_shard("2/3") == (2, 3) and X.normalise_extensions([".CS, py", "cs"]) == ("cs", "py")
    with pytest.raises(ValueError):
        X.parse_shard("4/3")


def test_limit_takes_the_first_discovered(spark):
    rows = spark.createDataFrame([(k, "", f"f{k}") for k in range(50)], "ord long, repo string, relative string").repartition(7)
    assert [r.ord for r in filters.first_files(rows, 5).collect()] == [0, 1, 2, 3, 4]
