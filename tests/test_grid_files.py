"""Planned grid files: damaged and empty ones, filters answered by the listing, sources kept."""

import datetime as dt
import os

from pyspark.sql import functions as F

from isohyet.sources import grid_files


def folder(spark, tmp_path, years=(1995, 1996, 1997)):
    rows = [(s, v, m, y, dt.date(y, 1, 1 + i), float(i), float(i % 2), float("nan") if i == 3 else y + i / 10) for s in ("historical", "ssp245") for v in ("tas", "pr") for m in ("A", "N") for y in years for i in range(5)]
    made = spark.createDataFrame(rows, "scenario string, var string, model string, year int, time date, lat double, lon double, value double")
    path = str(tmp_path / "grid")
    grid_files.write_grid_files(made, path)
    return path, rows


def test_files_and_their_rows(spark, tmp_path):
    path, rows = folder(spark, tmp_path)
    got = grid_files.scan_grid_files(spark, path).collect()
    assert len(got) == len(rows) and all(r.file.endswith(f"{r.scenario}/{r.var}/{r.model}/{r.year}.parquet") for r in got)
    want = {(s, v, m, y, t): None if x != x else x for s, v, m, y, t, _, _, x in rows}
    assert {(r.scenario, r["var"], r.model, r.year, r.time): r.value for r in got} == want


def test_damaged_and_empty_files_are_rows_with_a_reason(spark, tmp_path):
    path, _ = folder(spark, tmp_path)
    open(f"{path}/historical/tas/A/1996.parquet", "wb").close()
    with open(f"{path}/historical/tas/N/1995.parquet", "wb") as f:
        f.write(b"PAR1 not a table")
    with open(f"{path}/historical/tas/A/notes.txt", "w") as f:
        f.write("no year")
    spark.createDataFrame([(1,)], "other int").toPandas().to_parquet(f"{path}/historical/pr/A/1995.parquet")
    bad = {(r["var"], r.model, r.year): r.reason for r in grid_files.grid_file_report(spark, path).where("reason is not null").collect()}
    assert bad == {("tas", "A", 1996): "zero_size", ("tas", "N", 1995): "open_failed", ("pr", "A", 1995): "no_such_columns"}
    assert {(r["var"], r.model, r.year): r.reason for r in grid_files.unreadable(spark, path).collect()} == bad
    years = grid_files.scan_grid_files(spark, path, F.col("scenario") == "historical").select("var", "model", "year").distinct().collect()
    assert len(years) == 12 - 3
    usable = {(r.model, r.year) for r in grid_files.usable_years(grid_files.grid_file_report(spark, path, F.col("scenario") == "historical"), ["tas", "pr"]).collect()}
    assert usable == {("A", 1997), ("N", 1996), ("N", 1997)}


def test_a_damaged_row_group_leaves_the_others(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder_ = tmp_path / "g" / "historical" / "tas" / "A"
    os.makedirs(folder_)
    n = 4000
    table = pa.table({"date": pa.array([dt.date(1995, 1, 1)] * n), "latitude": [float(i) for i in range(n)], "x": [0.0] * n, "value": [float(i) for i in range(n)]})
    name = str(folder_ / "1995.parquet")
    pq.write_table(table, name, row_group_size=1000, use_dictionary=False, compression="zstd")
    meta = pq.ParquetFile(name).metadata
    at = meta.row_group(1).column(3).data_page_offset
    data = bytearray(open(name, "rb").read())
    data[at : at + 200] = b"\xff" * 200
    open(name, "wb").write(bytes(data))
    path = str(tmp_path / "g")
    got = grid_files.scan_grid_files(spark, path)
    assert got.count() == 3000 and got.where("lat >= 1000 and lat < 2000").isEmpty()
    assert [r.reason for r in grid_files.unreadable(spark, path).collect()] == ["read_failed in row group 1"]


def test_files_outside_the_filter_are_never_opened(spark, tmp_path):
    """Folders that can't be listed and files that can't be read stand outside the filter; the listing has only what is inside."""
    path, _ = folder(spark, tmp_path)
    reader = grid_files.GridReader(path, True)
    left = list(reader.pushFilters([grid_files.EqualTo(("var",), "tas"), grid_files.In(("year",), (1995, 1997)), grid_files.EqualTo(("lat",), 1.0)]))
    assert [f.attribute for f in left] == [("lat",)]
    assert {p.place[1:4] for p in reader.partitions()} == {("tas", m, y) for m in ("A", "N") for y in (1995, 1997)}
    some = grid_files.scan_grid_files(spark, path, (F.col("var") == "tas") & F.col("year").isin(1995, 1997) & (F.col("model") == "A") & (F.col("scenario") == "ssp245"))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 10


def test_an_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert grid_files.scan_grid_files(spark, str(tmp_path / "none")).count() == 0
    assert grid_files.grid_file_report(spark, str(tmp_path / "none")).count() == 0


def test_months_of_a_file_are_sorted_by_several_tasks(spark, tmp_path):
    """A year in falling order with times that are null: one file in order, made of a part for each month, and no part is left."""
    import pyarrow.parquet as pq

    days = spark.range(365 * 3).select(F.lit("historical").alias("scenario"), F.lit("tas").alias("var"), F.lit("A").alias("model"), F.lit(1995).alias("year"), F.date_add(F.lit("1995-12-31"), -(F.col("id") % 365).cast("int")).alias("time"), (-F.col("id")).cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.col("id").cast("double").alias("value"))
    days = days.unionByName(days.limit(2).withColumn("time", F.lit(None).cast("date")))
    for tasks in (None, 7):
        path = str(tmp_path / f"grid{tasks}")
        grid_files.write_grid_files(days, path, tasks)
        file = pq.ParquetFile(f"{path}/historical/tas/A/1995.parquet")
        rows = file.read().to_pylist()
        order = [(r["time"] is not None, r["time"] or dt.date.min, r["lat"]) for r in rows]
        assert len(rows) == 365 * 3 + 2 and order == sorted(order) and file.num_row_groups == 13
        assert sorted(os.listdir(tmp_path)) == sorted({f"grid{t}" for t in ((None,) if tasks is None else (None, 7))})
