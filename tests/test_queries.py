"""Every query against its SQL on the smallest tables, as the driver does."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from plumbline.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the test tables are not there")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def normal(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    expected = oracle.sql(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({ORACLE_SQL[name]})")
    assert sorted(oracle.sql(ORACLE_SQL[name]).columns) == names
    assert normal(df.select(*(f"`{n}`" for n in names)).collect()) == normal(expected.fetchall())


@pytest.mark.parametrize("name, table", [("mixed", "orders"), ("nulls", "supplier"), ("nulls_desc", "supplier"), ("by_group", "nation"), ("stable", "nation")])
def test_sorts_keep_whole_tables(spark, name, table):
    places = [r.place for r in QUERIES[f"arrange_{name}_whole"](spark, FOLDER).collect()]
    assert places == list(range(spark.read.parquet(f"{FOLDER}/{table}.parquet").count()))


def test_division_by_any_zero(spark, tmp_path):
    odd = (None, 0.0, -0.0, math.nan, math.inf, -math.inf, 5e-324, -1e308, 0.05, 1.0)
    pairs = [(k, 1, 1.0, 1.0, a, b) for k, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    spark.createDataFrame(pairs, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert normal(QUERIES["mutate_div_zero"](spark, str(tmp_path)).collect()) == normal(con.sql(ORACLE_SQL["mutate_div_zero"]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
