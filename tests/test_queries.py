"""Every registered query with SQL against DuckDB on the smallest tables, row for row."""

import glob
import math
import os

import duckdb
import pytest

from topolidar.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [df.columns.index(n) for n in names]
    left = sorted(tuple(map(plain, (r[i] for i in order))) for r in got) if got else []
    right = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_merge_of_all_rows_reaches_past_the_first_orders(spark, tmp_path):
    at = [*range(0, 100, 10), *range(12000, 12100, 10)]
    spark.createDataFrame([(i, 3, "click", float(i)) for i in at], "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(3 * (i // 3), 2, 7.0) for i in at], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registry.queries()["topobathy_merge"](spark, str(tmp_path)).collect()
    assert {r["key_id"]: r["als_h_te_median"] for r in rows} == {0: 7.0, 1: 7.0, 240: 7.0, 241: 7.0}
