"""The registered queries: names, and SQL results where SQL can express them."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", ["op3_tiff_pages", "op5_quality_rules", "op6_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(E.oracle_sql()[name])
    got = E.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([x for _, x in sorted(zip(want.columns, row))]) for row in want.fetchall())
