"""Every registered query of the engine: its rows against those of its SQL in another engine."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from quillpack.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    want = duck.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    have = sorted(str([r[c] for c in columns]) for r in got.collect())
    expected = sorted(str([x for _, x in sorted(zip(want.columns, row), key=lambda p: p[0])]) for row in want.fetchall())
    assert have == expected and have


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_without_sql(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert E.entry(spark).columns == ["ord", "relative", "language", "size", "tokens"] and E.entry(spark).count() > 0


def test_names():
    assert set(Q.QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """A copy of the repository without those folders still registers the engine's queries."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "quillpack"), tmp_path / "quillpack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(Q.QUERIES)
