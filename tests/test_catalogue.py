"""Every catalogued query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weirflow import behaviours, catalogue

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def _rows(found):
    plain = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted({*catalogue.oracle_sql(), *behaviours.BEHAVIOURS}))
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert _rows(out.select(*columns).collect()) == _rows(want)


def test_division_of_odd_values(spark, tmp_path):
    """Missing, negative and non-finite numbers give what the SQL gives."""
    odd = [None, 0.0, -0.0, 0.05, -0.05, math.inf, -math.inf, math.nan, 1e-308, 1e308, -1e308]
    rows = [(k, n, x, y) for k, x in enumerate(odd) for n, y in enumerate(odd)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_tax double, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = connection.execute(entry.oracle_sql()["derive_division"]).fetchall()
    key = lambda found: sorted((k, n, str(ratio)) for k, n, ratio in found)  # noqa: E731  a NaN is itself
    assert len(want) == 121 and key(map(tuple, entry.queries()["derive_division"](spark, str(tmp_path)).collect())) == key(want)


def test_similar_names(spark):
    out = catalogue.queries()["fuzzy_parts"](spark, SF)
    parts = spark.read.parquet(f"{SF}/part.parquet")
    assert out.columns == ["p_partkey", "p_name_x", "p_name_y", "name"] and out.count() == parts.count()


def test_flagship_plan(spark):
    plan = catalogue.run_case(spark, SF, catalogue.FLAGSHIP)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "Cartesian" not in plan
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "l_shipdate" not in scan and "o_totalprice" not in scan


def test_entry_module():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "blueprint_e2e" in entry.queries()
