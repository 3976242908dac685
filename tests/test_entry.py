"""The driver's contract, and queries against their SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["count_days", "tx90p_etccdi", "warm_spell_days", "period_mean", "ensemble_stats", "rankings_table", "portfolio_compare", "point_in_unit", "rasterize_units", "spi_transform", "merge_master", "scan_table_filtered"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["state", "district", "value", "rank", "percentile", "risk_class", "risk_code"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    place = [want.columns.index(c) for c in columns]
    text = lambda v: "null" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    rows = lambda it: sorted(tuple(map(text, r)) for r in it)
    assert rows(got.select(*columns).collect()) == rows([r[i] for i in place] for r in want.fetchall())


@pytest.mark.parametrize("outlier", [False, True])
def test_map_of_one_value_is_the_same_as_its_sql(spark, tmp_path, outlier):
    """All units have the same number of hot days, or one of them fewer: the range of the map has no extent."""
    con = duckdb.connect()
    days = "SELECT f, d FROM (SELECT unnest(['A', 'N']) AS f), (SELECT unnest(generate_series(TIMESTAMP '1995-01-05', TIMESTAMP '2001-12-05', INTERVAL 1 MONTH)) AS d)"
    units = 60  # the outlier's share must be below the 2nd percentile's place
    con.sql(f"COPY (SELECT 1 AS l_orderkey, u AS l_suppkey, f AS l_returnflag, 'F' AS l_linestatus, d AS l_shipdate, CASE WHEN {outlier} AND u = 7 AND month(d) = 3 THEN 3.0 ELSE 40.0 END AS l_quantity, 0.05 AS l_discount FROM (SELECT unnest(range({units})) AS u), ({days})) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"COPY (SELECT u AS s_suppkey, 'Supplier ' || u AS s_name, CAST(u AS INT) AS s_nationkey, 0.0 AS s_acctbal FROM (SELECT unnest(range({units})) AS u)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"COPY (SELECT CAST(u AS INT) AS n_nationkey, 'NATION_' || u AS n_name, CAST(u % 5 AS INT) AS n_regionkey FROM (SELECT unnest(range({units})) AS u)) TO '{tmp_path}/nation.parquet'")
    con.sql(f"COPY (SELECT * FROM '{SF}/region.parquet') TO '{tmp_path}/region.parquet'")
    for t in ("lineitem", "supplier", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = entry.queries()["map_enrichment"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['map_enrichment']}) ORDER BY ALL").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == want and len(rows) == units and len({r[-1] for r in rows}) == 1 + outlier


@pytest.mark.parametrize("name", ["cells_to_units", "align_variables"])
def test_readings_are_dealt_out_by_their_number(spark, monkeypatch, name):
    """6,000 readings at 100 a task make 60 tasks, whatever Spark's number is, and no other shuffle carries groups of a cell and day."""
    from isohyet.sources import adapter

    monkeypatch.setattr(adapter, "ROWS_A_TASK", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    made = entry.queries()[name](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # the bridge's own distinct rows, by cell and unit, may be dealt out by Spark's number
    of_cells = [int(k) for k in re.findall(r"Exchange hashpartitioning\(cell#\w+(?:, date#\w+)?, (\d+)\)", plan)]
    assert of_cells and set(of_cells) == {n}
