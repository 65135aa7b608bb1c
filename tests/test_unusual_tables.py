"""Registered queries on small tables changed to hold an unusual case, against their check SQL."""

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as contract

SMALL = Path("/root/testdata/sf0.001")


def against_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = contract.queries()[name](spark, str(folder))
    cur = con.execute(contract.oracle_sql()[name])
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.fixture
def busy_day(tmp_path):
    """The small tables with every fiftieth order on the last day, so that entrants start several times on it."""
    duckdb = pytest.importorskip("duckdb")
    for f in SMALL.glob("*.parquet"):
        if f.stem != "orders":
            shutil.copyfile(f, tmp_path / f.name)
    duckdb.sql(f"""copy (select * replace (case when o_orderkey % 50 = 0 then (select max(o_orderdate) from '{SMALL}/orders.parquet')
      else o_orderdate end as o_orderdate) from '{SMALL}/orders.parquet') to '{tmp_path}/orders.parquet'""")
    return tmp_path


def test_second_start_of_a_day_sees_the_first(spark, busy_day):
    got, want = against_sql(spark, busy_day, "live_cards_looked_up")
    assert len(want) > 100 and got == want
