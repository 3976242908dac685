"""Queries of scans, sinks, scalar functions, names, joins, geometry and SPI."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.functions import names, units
from isohyet.functions.special import gamma_cdf_sql, normal_quantile_sql
from isohyet.operators import ensemble, matching, order_stats, ranking, spatial, spi
from isohyet.plans.catalog import query
from isohyet.plans.index_queries import MONTHLY, monthly
from isohyet.plans import registry
from isohyet.plans.table_queries import CASE_SQL, COLUMNS, ENS, MASTER, PV, SMA, WIDE_SQL, YEARLY, current, master, period_dim, yearly
from isohyet.sources import commits, csv_folder, geojson, grid_files, io
from isohyet.sources.adapter import SERIES, UNIT, observations, panel, table, tasks_for
from isohyet.sources.io import scratch

S = ", ".join(SERIES)
LONG = "grid AS (SELECT cell, model, scenario, date, 'tas' AS var, avg(q) + 273.15 AS value FROM obs GROUP BY ALL UNION ALL SELECT cell, model, scenario, date, 'pr', sum(q) / 10 FROM obs WHERE q > 5 GROUP BY ALL)"


def grid(spark, d):
    """Long grid table: cell, model, scenario, date, var, value. Nearly every reading is a group of its own, so tasks are made by their number, and a cell has at most its days as groups."""
    o = observations(spark, d).repartition(tasks_for(spark, d), "cell")
    keys = ["cell", "model", "scenario", "date"]
    tas = o.groupBy(*keys).agg((F.avg("q") + 273.15).alias("value")).withColumn("var", F.lit("tas"))
    pr = o.where("q > 5").groupBy(*keys).agg((F.sum("q") / 10).alias("value")).withColumn("var", F.lit("pr"))
    return tas.unionByName(pr)


@query(f"WITH {LONG} SELECT model, scenario, date, CAST(cell AS DOUBLE) AS lat, CAST(cell % 7 AS DOUBLE) AS lon, var, round(value, 6) AS value FROM grid WHERE var = 'tas' AND scenario = 'historical'", last=1998)
def scan_grid_daily(spark, d):
    path = scratch(spark, "grid")
    rows = grid(spark, d).withColumn("latitude", F.col("cell").cast("double")).withColumn("longitude", (F.col("cell") % 7).cast("double")).drop("cell")
    io.write_partitioned(rows, path, "var", "scenario")
    return io.scan_grid_daily(spark, path, ["tas"], ["historical"]).select("model", "scenario", "date", "lat", "lon", "var", "value")


FILES_SQL = f"WITH {LONG} SELECT scenario, var, model, CAST(year(date) AS INT) AS year"


def grid_folder(spark, d):
    """The grid as one file for each scenario, variable, model and year; the folder."""
    path = scratch(spark, "grid-files")
    rows = grid(spark, d).select("scenario", "var", "model", F.year("date").alias("year"), F.col("date").alias("time"), F.col("cell").cast("double").alias("lat"), (F.col("cell") % 7).cast("double").alias("lon"), "value")
    grid_files.write_grid_files(rows, path, tasks_for(spark, d))
    return path


@query(FILES_SQL + ", date AS time, CAST(cell AS DOUBLE) AS lat, CAST(cell % 7 AS DOUBLE) AS lon, round(value, 6) AS value FROM grid WHERE var = 'pr' AND scenario = 'historical' AND year(date) IN (1995, 1996)", last=1998)
def scan_grid_files(spark, d):
    """Planned files: the listing answers variable, scenario and years."""
    asked = (F.col("var") == "pr") & (F.col("scenario") == "historical") & F.col("year").isin(1995, 1996)
    return grid_files.scan_grid_files(spark, grid_folder(spark, d), asked).drop("file")


@query(FILES_SQL + ", scenario || '/' || var || '/' || model || '/' || year(date) || '.parquet' AS file, NULL::VARCHAR AS reason FROM grid GROUP BY ALL", last=1998)
def grid_file_report(spark, d):
    report = grid_files.grid_file_report(spark, grid_folder(spark, d))
    return report.select("scenario", "var", "model", "year", F.substring_index("file", "/", -4).alias("file"), "reason")


@query("SELECT DISTINCT l_returnflag AS model FROM lineitem")
def discover_models(spark, d):
    return io.discover_models(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model")))


@query(f"WITH {LONG} SELECT model, scenario, CAST(year(date) AS INT) AS year FROM grid GROUP BY ALL HAVING count(DISTINCT var) = 2", last=1998)
def required_years(spark, d):
    return io.required_years(grid(spark, d), ["tas", "pr"])


@query("SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year FROM lineitem INTERSECT SELECT DISTINCT CAST(year(o_orderdate) AS INT) FROM orders")
def intersect_years(spark, d):
    years = lambda name, date: table(spark, d, name).select(F.year(date).alias("year"))
    return io.intersect_distinct(years("lineitem", "l_shipdate"), years("orders", "o_orderdate"))


@query(f"WITH {YEARLY} SELECT slug, {S}, year, round(value, 6) AS value FROM yearly", last=1998)
def scan_csv_table(spark, d):
    path = scratch(spark, "yearly-csv")
    y = yearly(spark, d).select("slug", *SERIES, "year", "value")
    y.write.csv(path, header=True)
    return io.scan_csv_table(spark, path, "slug string, state string, district string, model string, scenario string, year int, value double")


@query(f"WITH {YEARLY} SELECT district, year, round(value, 6) AS value FROM yearly WHERE slug = 'prcptot' AND scenario = 'historical' AND model = 'A'", last=1998)
def scan_table_filtered(spark, d):
    path = scratch(spark, "yearly")
    io.write_partitioned(yearly(spark, d), path, "slug", "scenario")
    return io.scan_table_filtered(spark, path, ["district", "year", "value"], {"slug": "prcptot", "scenario": "historical", "model": "A"})


BLOCK_PV = "bpanel AS (SELECT state, district, block, model, scenario, date, CAST(year(date) AS INT) AS year, max(q) + 273.15 AS tasmax, sum(q) / 10 AS pr FROM obs GROUP BY ALL), " + PV.replace("state, district", "state, district, block").replace("FROM panel", "FROM bpanel")
OUTPUT = "slug, state, replace(district, '_', ' ') AS district, {b} AS block, model, scenario, CAST({t} AS VARCHAR) AS time, round(value, 6) AS value"


@query(f"""SELECT 'district' AS level, 'yearly' AS kind, {OUTPUT.format(b="''", t='year')} FROM (WITH {YEARLY} SELECT * FROM yearly) UNION ALL SELECT 'district', 'period', {OUTPUT.format(b="''", t='period')} FROM (WITH {PV} SELECT * FROM pv)
UNION ALL SELECT 'block', 'yearly', {OUTPUT.format(b='block', t='year')} FROM (WITH {BLOCK_PV} SELECT * FROM yearly) UNION ALL SELECT 'block', 'period', {OUTPUT.format(b='block', t='period')} FROM (WITH {BLOCK_PV} SELECT * FROM pv)""", last=1998)
def sink_and_collect_unit_outputs(spark, d):
    """Yearly and period rows of districts and blocks, written by kind, metric, level and scenario, and read as one table."""
    path = scratch(spark, "unit-outputs")
    slugs = ["tx_mean", "hot_days", "prcptot"]
    outputs = None
    for level, unit in (("district", UNIT), ("block", [*UNIT, "block"])):
        rows = registry.build(panel(spark, d, keys=[*unit, "model", "scenario"]), [*unit, "model"], slugs)
        means = ensemble.period_mean(rows, period_dim(spark), unit, min_years=3)
        block = F.col("block") if level == "block" else F.lit("")
        for kind, part, time in (("yearly", rows, "year"), ("period", means, "period")):
            named = part.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), "slug", "state", F.replace("district", F.lit(" "), F.lit("_")).alias("district"), block.alias("block"), "model", "scenario", F.col(time).cast("string").alias("time"), "value")
            outputs = named if outputs is None else outputs.unionByName(named)
    io.write_partitioned(outputs, path, "kind", "slug", "level", "scenario")
    back = spark.read.schema(outputs.schema).parquet(path)
    return back.select("level", "kind", "slug", "state", F.replace("district", F.lit("_"), F.lit(" ")).alias("district"), F.coalesce("block", F.lit("")).alias("block"), "model", "scenario", "time", "value")


@query(f"WITH {YEARLY} SELECT slug, state, district, scenario, year, {ENS} FROM yearly GROUP BY ALL", last=1998)
def sink_yearly_ensemble(spark, d):
    path = scratch(spark, "ensemble")
    io.write_partitioned(ensemble.yearly_ensemble(yearly(spark, d), UNIT), path, "slug", "scenario")
    return spark.read.parquet(path)


STATE_SQL = "SELECT '{kind}_models' AS kind, slug, state, scenario, CAST({t} AS VARCHAR) AS time, model, round(value, 6) AS value, NULL::DOUBLE AS std, NULL::DOUBLE AS median, NULL::DOUBLE AS p05, NULL::DOUBLE AS p95, NULL::BIGINT AS n_models, n_units FROM {s} UNION ALL SELECT '{kind}_ensemble', slug, state, scenario, CAST({t} AS VARCHAR), NULL, round(avg(value), 6), round(stddev_pop(value), 6), round(median(value), 6), round(quantile_cont(value, 0.05), 6), round(quantile_cont(value, 0.95), 6), count(value), max(n_units) FROM {s} GROUP BY slug, state, scenario, {t}"


@query(f"WITH {PV}, {SMA.format(t='period', src='pv')}, {SMA.format(t='year', src='yearly').replace('sma AS', 'smy AS')} {STATE_SQL.format(kind='period', t='period', s='sma')} UNION ALL {STATE_SQL.format(kind='yearly', t='year', s='smy')}", last=1998)
def sink_state_summaries(spark, d):
    """The four state tables, each written and read back."""
    path = scratch(spark, "states")
    y = yearly(spark, d)
    tables = ensemble.state_summaries(ensemble.period_mean(y, period_dim(spark), UNIT, min_years=3), y, ["state", "district"])
    out = None
    for kind, rows in tables.items():
        io.write_partitioned(rows, f"{path}/{kind}", "slug")
        back = spark.read.parquet(f"{path}/{kind}").withColumnsRenamed({"ensemble_mean": "value", **{f"ensemble_{c}": c for c in ("std", "median", "p05", "p95")}, "period": "time", "year": "time"})
        back = back.withColumn("time", F.col("time").cast("string")).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back, allowMissingColumns=True)
    return out.select("kind", "slug", "state", "scenario", "time", "model", "value", "std", "median", "p05", "p95", "n_models", "n_units")


@query(WIDE_SQL, last=1998)
def sink_master_wide(spark, d):
    """The whole wide master as CSV, JSON columns quoted, read back under its own schema."""
    path = scratch(spark, "master")
    wide = ensemble.wide_master(master(spark, d), UNIT, COLUMNS)
    wide.write.option("escape", '"').csv(path, header=True)
    return spark.read.option("escape", '"').csv(path, header=True, schema=wide.schema)


@query(f"WITH {YEARLY}, e AS (SELECT slug, state, district, scenario, year, avg(value) AS m, median(value) AS md FROM yearly GROUP BY ALL) SELECT slug, state, district, scenario, year, round(coalesce(m, md), 6) AS mean FROM e WHERE lower(scenario) = 'historical'", last=1998)
def load_unit_yearly(spark, d):
    e = ensemble.yearly_ensemble(yearly(spark, d), UNIT)
    return e.where(F.lower("scenario") == "historical").select("slug", *UNIT, "scenario", "year", F.coalesce("ensemble_mean", "ensemble_median").alias("mean")).where("year is not null and mean is not null")


@query(f"WITH {YEARLY} SELECT slug, state, scenario, year, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM yearly GROUP BY ALL", last=1998)
def load_state_yearly(spark, d):
    return yearly(spark, d).groupBy("slug", "state", "scenario", "year").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


@query(f"WITH {YEARLY}, r AS (SELECT *, dense_rank() OVER (PARTITION BY slug, state, district, scenario ORDER BY lower(model)) AS k FROM yearly WHERE value IS NOT NULL) SELECT slug, {S}, year, round(round(value, 9), 6) AS value FROM r WHERE k <= 2", last=1998)
def load_model_members(spark, d):
    """Models' yearly series from one folder of files of three headers; of each unit the first two models by name."""
    from pyspark.sql import Window

    path = scratch(spark, "members")
    y = order_stats.written(yearly(spark, d), "yearly")
    y.where("model = 'A'").select("slug", *SERIES, "year", "value").write.csv(f"{path}/a", header=True)
    y.where("model = 'N'").select("year", "model", "state", F.col("value").alias("mean_of_year"), "district", "scenario", "slug").write.csv(f"{path}/n", header=True)
    y.where("model = 'R'").select(F.lit("none").alias("value"), "scenario", "year", F.col("value").alias("amount"), "slug", "district", "state", "model").write.csv(f"{path}/r", header=True)
    read = csv_folder.yearly_series(spark, path, ("slug", *SERIES))
    w = Window.partitionBy("slug", *UNIT, "scenario").orderBy(F.lower("model"))
    return read.withColumn("k", F.dense_rank().over(w)).where("k <= 2").select("slug", *SERIES, "year", F.round("value", ranking.PLACES).alias("value"))


@query("SELECT DISTINCT r_name AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def list_states(spark, d):
    return observations(spark, d).select("state").distinct()


@query("SELECT DISTINCT state, district, block FROM obs", last=1998)
def list_blocks(spark, d):
    return observations(spark, d).select(*UNIT, "block").distinct()


@query("SELECT state, count(DISTINCT district) AS n_units, count(DISTINCT block) AS n_blocks FROM obs GROUP BY ALL", last=1998)
def distinct_units(spark, d):
    return observations(spark, d).groupBy("state").agg(F.count_distinct("district").alias("n_units"), F.count_distinct("block").alias("n_blocks"))


@query("SELECT r_name AS state, n_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN (SELECT district FROM obs)", last=1998)
def missing_states(spark, d):
    """Units of the portfolio (every nation) that no reading is from."""
    wanted = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    return io.missing_from(wanted, observations(spark, d), UNIT)


@query("WITH p AS (SELECT r_name AS state, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT lower(state) AS state_key, CASE WHEN min(pos) % 2 = 0 THEN arg_min(state, pos) ELSE lower(arg_min(state, pos)) END AS state FROM p GROUP BY 1")
def portfolio_states(spark, d):
    """States of a portfolio whose spellings differ in case from unit to unit, with an "All" among them: the first spelling stays."""
    p = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = p.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.lower("r_name")).alias("state"), F.col("n_nationkey").cast("long").alias("place"))
    rows = rows.unionByName(spark.range(1).select(F.lit("All").alias("state"), F.lit(-1).cast("long").alias("place")))
    return matching.portfolio_states(rows, "state", "place", "none")


@query("WITH a AS (SELECT state, district, avg(q) AS warm FROM obs WHERE state < 'B' GROUP BY ALL), b AS (SELECT state, district, max(q) AS top FROM obs WHERE state >= 'B' GROUP BY ALL) SELECT state, district, round(warm, 6) AS warm, NULL::DOUBLE AS top FROM a UNION ALL SELECT state, district, NULL, round(top, 6) FROM b", last=1998)
def union_states(spark, d):
    o = observations(spark, d)
    a = o.where("state < 'B'").groupBy(*UNIT).agg(F.avg("q").alias("warm"))
    return a.unionByName(o.where("state >= 'B'").groupBy(*UNIT).agg(F.max("q").alias("top")), allowMissingColumns=True)


@query("SELECT model, count(*) FILTER (scenario = 'historical') AS base_days, count(*) AS all_days FROM panel WHERE scenario IN ('historical', 'ssp245') GROUP BY ALL", last=1998)
def union_hist_scenario(spark, d):
    days = panel(spark, d)
    both = days.where("scenario = 'historical'").unionByName(days.where("scenario = 'ssp245'"))
    return both.groupBy("model").agg(F.count_if(F.col("scenario") == "historical").alias("base_days"), F.count(F.lit(1)).alias("all_days"))


@query("SELECT state, district, model, scenario, date, round(tas, 6) AS tas FROM panel WHERE tas IS NOT NULL", last=1998)
def unit_daily_mean(spark, d):
    cells = observations(spark, d)
    return cells.groupBy(*SERIES, "date").agg((F.avg("q") + 273.15).alias("tas")).where("tas is not null")


@query(f"WITH {LONG}, b AS (SELECT DISTINCT cell, state, district FROM obs) SELECT state, district, model, scenario, date, round(avg(value), 6) AS value FROM grid JOIN b USING (cell) WHERE var = 'tas' GROUP BY ALL", last=1998)
def cells_to_units(spark, d):
    """Means over the cells of a unit; the bridge is dealt out as the grid is, so that isn't shuffled again."""
    bridge = observations(spark, d).select("cell", *UNIT).distinct().repartition(tasks_for(spark, d), "cell")
    return grid(spark, d).where("var = 'tas'").join(bridge, "cell").groupBy(*SERIES, "date").agg(F.avg("value").alias("value"))


@query("SELECT cell, model, scenario, date, round(avg(q) + 273.15, 6) AS tas, round(sum(q) FILTER (q > 5) / 10, 6) AS pr FROM obs GROUP BY ALL HAVING count(*) FILTER (q > 5) > 0", last=1998)
def align_variables(spark, d):
    """Cells' days that have both variables: one aggregate with a column for each, in place of a join of two."""
    wet = F.when(F.col("q") > 5, F.col("q"))
    seen = observations(spark, d).repartition(tasks_for(spark, d), "cell", "date")
    both = seen.groupBy("cell", "model", "scenario", "date").agg((F.avg("q") + 273.15).alias("tas"), (F.sum(wet) / 10).alias("pr"))
    return both.where("tas is not null and pr is not null")


@query("SELECT p.state, p.district, p.model, p.scenario, CAST(p.year AS INT) AS year, round(avg(p.tas) - any_value(b.m), 6) AS anomaly FROM panel p LEFT JOIN (SELECT state, district, model, avg(tas) AS m FROM panel WHERE scenario = 'historical' GROUP BY ALL) b USING (state, district, model) GROUP BY p.state, p.district, p.model, p.scenario, p.year", last=1998)
def attach_baseline_source(spark, d):
    days = panel(spark, d)
    base = days.where("scenario = 'historical'").groupBy(*UNIT, "model").agg(F.avg("tas").alias("m"))
    return days.groupBy(*SERIES, "year").agg(F.avg("tas").alias("v")).join(base, [*UNIT, "model"], "left").select(*SERIES, "year", (F.col("v") - F.col("m")).alias("anomaly"))


@query("SELECT n_name AS district, round(CASE WHEN n_nationkey % 3 = 0 THEN v * 86400 WHEN n_nationkey % 3 = 1 THEN v * 1000 ELSE v END, 6) AS mm FROM (SELECT n_nationkey, n_name, avg(s_acctbal) / 86400 AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)")
def pr_to_mm_day(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg((F.avg("s_acctbal") / 86400).alias("v"))
    u = F.element_at(F.array(F.lit(" kg m-2 s-1 "), F.lit("m"), F.lit("mm")), F.col("n_nationkey") % 3 + 1)
    return rows.select(F.col("n_name").alias("district"), units.pr_to_mm_day(F.col("v"), u, staging=True).alias("mm"))


@query("WITH t AS (SELECT state, district, date, avg(q) + CASE WHEN district < 'I' THEN 273.15 ELSE 0 END AS v FROM obs GROUP BY state, district, date) SELECT state, district, date, round(CASE WHEN district < 'I' THEN v - 273.15 ELSE v END, 6) AS value FROM t", last=1998)
def infer_celsius(spark, d):
    t = observations(spark, d).groupBy(*UNIT, "date").agg((F.avg("q") + F.when(F.col("district") < "I", 273.15).otherwise(0.0)).alias("value")).withColumn("units", F.lit("unknown"))
    return io.infer_celsius(t, "district").select(*UNIT, "date", "value")


@query("WITH x AS (SELECT state, district, date, avg(q) AS t, avg(q) - avg(h) AS td FROM obs GROUP BY ALL) SELECT state, district, date, round(6.112 * exp(17.67 * t / (t + 243.5)), 6) AS es, round(least(greatest(100 * (6.112 * exp(17.67 * td / (td + 243.5))) / (6.112 * exp(17.67 * t / (t + 243.5))), 0), 100), 6) AS rh FROM x", last=1998)
def relative_humidity(spark, d):
    x = observations(spark, d).groupBy(*UNIT, "date").agg(F.avg("q").alias("t"), (F.avg("q") - F.avg("h")).alias("td"))
    return x.select(*UNIT, "date", units.saturation_vapour_pressure(F.col("t")).alias("es"), units.relative_humidity(F.col("t"), F.col("td")).alias("rh"))


ASCII = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[_-]', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT s_name AS name, {ASCII.format(c='s_name')} AS plain, replace({ASCII.format(c='s_name')}, ' ', '') AS compact, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM supplier")
def normalize_name(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").select(n.alias("name"), names.normalize_name(n).alias("plain"), names.normalize_compact(n).alias("compact"), names.slugify(n).alias("slug"))


@query(f"SELECT n_name AS name, CASE {ASCII.format(c='n_name')} WHEN 'united states' THEN 'usa' WHEN 'united kingdom' THEN 'uk' ELSE {ASCII.format(c='n_name')} END AS alias FROM nation")
def alias_name(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), names.alias_name(F.col("n_name"), {"united states": "usa", "united kingdom": "uk"}).alias("alias"))


@query("SELECT DISTINCT o_orderpriority AS priority, year(o_orderdate)::VARCHAR || '-' || (year(o_orderdate) + 20)::VARCHAR AS period FROM orders")
def canonical_period(spark, d):
    y = F.year("o_orderdate")
    raw = F.concat(y.cast("string"), F.lit("_"), (y + 20).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), names.canonical_period(raw).alias("period")).distinct()


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'Unknown' END AS district, s_name AS block, s_name || ', ' || n_name || ', ' || r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def split_unit_key(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("||", "n_name", "s_name")).otherwise(F.col("s_name"))
    district, block = names.split_unit_key(key)
    return s.select("s_suppkey", district.alias("district"), block.alias("block"), names.unit_label(F.col("r_name"), F.col("n_name"), F.col("s_name")).alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 40 BETWEEN 6 AND 38 THEN CAST(s_suppkey % 40 AS DOUBLE) END AS lat, CASE WHEN s_suppkey % 40 BETWEEN 6 AND 38 THEN CAST(70 + s_suppkey % 25 AS DOUBLE) END AS lon, CASE WHEN s_suppkey % 40 BETWEEN 6 AND 38 THEN s_name END AS label FROM supplier")
def parse_coordinates(spark, d):
    line = F.concat_ws(", ", (F.col("s_suppkey") % 40).cast("string"), F.concat(F.lit("'"), (F.col("s_suppkey") % 25 + 70).cast("string"), F.lit("'")), "s_name")
    return table(spark, d, "supplier").select("s_suppkey", *names.parse_coordinates(line))


@query("SELECT state, district, model, scenario, date FROM panel WHERE state = 'MIDDLE EAST'", last=1998)
def filter_state(spark, d):
    return matching.filter_state(panel(spark, d), "state", "middle_east", {}).select(*SERIES, "date")


# --- geometry: nations are polygons on a 5 x 5 board, suppliers are points and cells -----------------------------
BOARD = """sq AS (SELECT n_name AS unit_key, n_regionkey, (n_nationkey % 5) * 2.0 + 70 AS x0, (n_nationkey // 5) * 2.0 + 10 AS y0, 1.0 + (n_nationkey % 3) * 0.5 AS w FROM nation),
pts AS (SELECT s_suppkey, (s_suppkey * 37 % 1000) / 100.0 + 70.003 AS x, (s_suppkey * 61 % 1000) / 100.0 + 10.007 AS y FROM supplier),
tri AS (SELECT unit_key, n_regionkey, x0, y0, w, x0 + w AS x1, y0 + w AS y1 FROM sq)"""


def features(spark, d):
    """A GeoJSON text for each nation: a right triangle, as a Polygon or a MultiPolygon."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("unit_key"), ((F.col("n_nationkey") % 5) * 2.0 + 70).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 2.0 + 10).alias("y0"), (1.0 + (F.col("n_nationkey") % 3) * 0.5).alias("w"), "n_nationkey")
    ring = F.format_string("[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]", "x0", "y0", F.col("x0") + F.col("w"), "y0", "x0", F.col("y0") + F.col("w"), "x0", "y0")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.format_string('{"type":"Polygon","coordinates":[%s]}', ring)).otherwise(F.format_string('{"type":"MultiPolygon","coordinates":[[%s]]}', ring))
    return n.select("unit_key", text.alias("geometry"))


def edges(spark, d):
    return spatial.explode_geojson(features(spark, d))


def points(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 1000) / 100 + 70.003).alias("x"), ((F.col("s_suppkey") * 61 % 1000) / 100 + 10.007).alias("y"))


EDGES = "SELECT unit_key, CAST(0 AS INT) AS part, CAST(0 AS INT) AS ring, CAST(0 AS INT) AS seq, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 AS y2 FROM sq UNION ALL SELECT unit_key, 0, 0, 1, x0 + w, y0, x0, y0 + w FROM sq UNION ALL SELECT unit_key, 0, 0, 2, x0, y0 + w, x0, y0 FROM sq"


@query(f"WITH {BOARD} SELECT unit_key, part, ring, seq, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM ({EDGES})")
def explode_geojson(spark, d):
    return edges(spark, d)


@query(f"WITH {BOARD} SELECT unit_key, round(w * w / 2, 6)::DOUBLE AS area, round(x0 + w / 3, 6)::DOUBLE AS cx, round(y0 + w / 3, 6)::DOUBLE AS cy FROM tri")
def polygon_area_centroid(spark, d):
    return spatial.area_centroid(edges(spark, d))


NOTE = "}{ \"quoted\" [x] \\"


@query("SELECT n_name AS district_name, r_name AS state_name, CAST(3 AS BIGINT) AS n_edges, '" + NOTE + "' AS note FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_boundary_file(spark, d):
    """Nations as one FeatureCollection in a line, read back by byte ranges under canonical names, with the edges of each."""
    path = scratch(spark, "boundaries")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("STATE_UT"), F.lit("all").alias("world"))
    f = features(spark, d).join(n, F.col("unit_key") == F.col("n_name")).withColumn("DISTRICT", F.concat(F.lit(" "), "n_name", F.lit(" "))).withColumn("note", F.lit(NOTE))
    whole = io.feature_collections(f.withColumn("geometry", F.from_json("geometry", "type string, coordinates string")), "world", "geometry", ["DISTRICT", "STATE_UT", "note"], "unit_key")
    whole.select(F.regexp_replace(F.regexp_replace("geojson", r'"coordinates":"([^"]*)"', '"coordinates":$1'), "\n", " ").alias("value")).coalesce(1).write.text(path)
    read = geojson.district_boundaries(spark, path).withColumn("note", F.col("properties")["note"])
    n_edges = spatial.explode_geojson(read, keys=["district_name"]).groupBy("district_name").agg(F.count(F.lit(1)).alias("n_edges"))
    return read.join(n_edges, "district_name").select("district_name", "state_name", "n_edges", "note")


@query(f"WITH {BOARD}, e AS ({EDGES}), {spatial.ELLIPSOID_SQL} SELECT unit_key, round(area_km2, 4) AS area_km2 FROM ellipsoid_area")
def ellipsoid_area(spark, d):
    return spatial.ellipsoid_area_km2(edges(spark, d)).select("unit_key", F.round("area_km2", 4).alias("area_km2"))


EARTH = 6371.0088


@query(f"WITH {BOARD}, e AS ({EDGES}) SELECT unit_key, round(abs(sum(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))))) * {EARTH} ** 2 / 2, 4) AS area_km2 FROM e GROUP BY ALL")
def spherical_area(spark, d):
    return spatial.spherical_area_km2(edges(spark, d)).select("unit_key", F.round("area_km2", 4).alias("area_km2"))


IN = "x > x0 AND y > y0 AND (x - x0) + (y - y0) < w"


@query(f"""WITH {BOARD}, ins AS (SELECT s_suppkey, min(unit_key) AS unit_key FROM pts, tri WHERE {IN} GROUP BY ALL),
f AS (SELECT s_suppkey, arg_min(unit_key, struct_pack(d := (x - x0 - w / 3) * (x - x0 - w / 3) + (y - y0 - w / 3) * (y - y0 - w / 3), u := unit_key)) AS unit_key FROM pts, tri WHERE s_suppkey NOT IN (SELECT s_suppkey FROM ins) GROUP BY ALL)
SELECT s_suppkey, unit_key, true AS inside FROM ins UNION ALL SELECT s_suppkey, unit_key, false FROM f""")
def point_in_unit(spark, d):
    return spatial.point_in_unit(points(spark, d), edges(spark, d), "s_suppkey")


@query("SELECT n_name AS unit_key, CASE WHEN n_nationkey < 25 THEN r_name ELSE 'Unknown' END AS state FROM nation JOIN region ON n_regionkey = r_regionkey")
def state_of_unit(spark, d):
    """The state whose area holds a point inside each unit: a state's edges are those of its units."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("unit_key"), "r_name")
    e = edges(spark, d)
    inside = spatial.representative_points(e)
    states = e.join(n, "unit_key").withColumn("unit", F.col("unit_key")).select(F.col("r_name").alias("state"), "x1", "y1", "x2", "y2")
    held = spatial.containing(inside, states, "unit_key", "state").groupBy("unit_key").agg(F.min("state").alias("state"))
    return inside.select("unit_key").join(held, "unit_key", "left").select("unit_key", F.coalesce("state", F.lit("Unknown")).alias("state"))


CELLS = "cells AS (SELECT DISTINCT floor(x / 0.5)::BIGINT * 100000 + floor(y / 0.5)::BIGINT AS cell_id, floor(x / 0.5) * 0.5 + 0.25 AS x, floor(y / 0.5) * 0.5 + 0.25 AS y FROM pts)"


@query(f"WITH {BOARD}, {CELLS} SELECT DISTINCT unit_key, cell_id FROM cells, tri WHERE x + 0.25 >= x0 AND y + 0.25 >= y0 AND x - 0.25 <= x0 + w AND y - 0.25 <= y0 + w AND (greatest(x - 0.25, x0) - x0) + (greatest(y - 0.25, y0) - y0) <= w")
def rasterize_units(spark, d):
    p = points(spark, d).select(F.floor(F.col("x") / 0.5).alias("i"), F.floor(F.col("y") / 0.5).alias("j")).distinct()
    cells = p.select((F.col("i") * 100000 + F.col("j")).alias("cell_id"), (F.col("i") * 0.5 + 0.25).alias("x"), (F.col("j") * 0.5 + 0.25).alias("y"))
    return spatial.rasterize_units(cells, edges(spark, d), 0.5)


@query(f"WITH {BOARD} SELECT unit_key FROM tri WHERE x0 <= 75 AND x0 + w >= 72.2 AND y0 <= 15.5 AND y0 + w >= 12.1")
def bbox_filter(spark, d):
    return spatial.units_in_box(edges(spark, d), 72.2, 12.1, 75.0, 15.5)


@query()
def sink_featurecollection(spark, d):
    f = features(spark, d).join(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("unit_key") == F.col("n_name"))
    return io.feature_collections(f.withColumn("geometry", F.from_json("geometry", "type string, coordinates string")), "r_name", "geometry", ["n_name", "n_comment"] if "n_comment" in f.columns else ["n_name"], "unit_key")


ALIASES = {"nation 1": "first nation", "nation 2": "second nation", "canada": "first nation", "peru": "second nation"}


@query("""SELECT DISTINCT r_name AS state, CASE n_name WHEN 'NATION_1' THEN 'First-Nation' WHEN 'CANADA' THEN 'First-Nation' WHEN 'NATION_2' THEN 'SECOND nation' WHEN 'PERU' THEN 'SECOND nation' ELSE lower(n_name) || '!' END AS item, n_name AS unit, CAST(0 AS INT) AS tier
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def resolve_unit_name(spark, d):
    """Display names (another case, a mark at the end, or an alias) to stored ones."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("state"), "n_name")
    shown = F.when(F.col("n_name").isin("NATION_1", "CANADA"), "First-Nation").when(F.col("n_name").isin("NATION_2", "PERU"), "SECOND nation").otherwise(F.concat(F.lower("n_name"), F.lit("!")))
    return matching.match_names(n.select("state", shown.alias("shown")), n, "shown", "n_name", ["state"], aliases=ALIASES).select("state", "item", "unit", "tier")


@query()
def match_unit_fuzzy(spark, d):
    """Suppliers' block names with their last letter changed, found again within the nation."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_name")
    return matching.match_names(s.withColumn("typo", F.concat(F.expr("substring(s_name, 1, length(s_name) - 1)"), F.lit("x"))), s, "typo", "s_name", ["s_nationkey"], 0.7)


@query(f"WITH {MASTER}, m AS (SELECT state, district, mean AS value FROM master WHERE slug = 'hot_days' AND scenario = 'ssp245') SELECT n_name AS district_name, r_name AS state_name, round(value, 6) AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN m ON m.state = r_name AND m.district = n_name WHERE r_name IN (SELECT state FROM m)", last=1998)
def merge_master(spark, d):
    b = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.initcap("n_name").alias("district_name"), F.lower("r_name").alias("state_name"), F.col("n_name").alias("dn"), F.col("r_name").alias("sn"))
    m = current(spark, d).select(*UNIT, "value")
    return matching.merge_master(b, m, "state_name", "district_name").select(F.col("dn").alias("district_name"), F.col("sn").alias("state_name"), "value")


@query("""WITH m AS (SELECT state, district, block, avg(q) AS value FROM obs GROUP BY ALL) SELECT s_suppkey, r_name AS state_name, n_name AS district_name, s_name AS block_name, CASE WHEN m.block IS NOT NULL THEN r_name END AS state, round(value, 6) AS value, CASE WHEN m.block IS NOT NULL THEN 'master' END AS note_csv
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN m ON m.state = r_name AND m.district = n_name AND m.block = s_name WHERE r_name IN (SELECT state FROM m)""", last=1998)
def merge_master_blocks(spark, d):
    """Boundaries of blocks with the master's values, by district and block; a column of both is the master's with _csv."""
    b = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = b.select("s_suppkey", F.col("r_name").alias("state_name"), F.col("n_name").alias("district_name"), F.col("s_name").alias("block_name"), F.lit("boundary").alias("note"))
    m = observations(spark, d).groupBy(*UNIT, "block").agg(F.avg("q").alias("value")).withColumn("note", F.lit("master"))
    return matching.merge_master(b, m, "state_name", "district_name", block="block_name").select("s_suppkey", "state_name", "district_name", "block_name", "state", "value", "note_csv")


# --- SPI: history until 1999, baseline 1995-1999 ------------------------------------------------------------------
B5 = (1995, 1999)
UM = [*UNIT, "model"]
ACC = f"{MONTHLY}, acc AS (SELECT {S}, month, total, CASE WHEN count(total) OVER w = 3 THEN sum(total) OVER w END AS acc FROM monthly WINDOW w AS (PARTITION BY {S} ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"
FIT = f"{ACC}, fit AS (SELECT state, district, model, month(month) AS moy, count(*) AS n, avg(acc) AS m, stddev_pop(acc) AS s FROM acc WHERE scenario = 'historical' AND year(month) BETWEEN 1995 AND 1999 AND acc IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"
SPI = f"{FIT}, spi AS (SELECT acc.*, CASE WHEN s = 0 THEN 0 WHEN (acc - m) / nullif(s, 0) IS NOT NULL THEN greatest(least((acc - m) / nullif(s, 0), 4.753424308822899), -4.753424308822899) END AS spi FROM acc LEFT JOIN fit ON acc.state = fit.state AND acc.district = fit.district AND acc.model = fit.model AND month(acc.month) = fit.moy)"


def accumulated(spark, d):
    return spi.accumulate(monthly(spark, d, 1999), SERIES, 3)


def spi_values(spark, d):
    a = accumulated(spark, d)
    return spi.transform(a, spi.fit(a, UM, B5, least=3), UM)


def _digamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - (" + " + ".join(f"1 / ({x} + {i})" for i in range(6)) + "))"


def _trigamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) + " + " + ".join(f"1 / ({x} + {i}) ** 2" for i in range(6)) + ")"


STEPS = ", ".join(f"k{i + 1} AS (SELECT *, k{i} - (ln(k{i}) - {_digamma_sql(f'k{i}')} - s) / (1 / k{i} - {_trigamma_sql(f'k{i}')}) AS k{i + 1} FROM k{i})" for i in range(3))
POOLED = f"""{ACC}, g AS (SELECT state, month(month) AS moy, count(*) AS n, avg(CASE WHEN acc = 0 THEN 1.0 ELSE 0.0 END) AS q, count(*) FILTER (acc > 0) AS n_pos, avg(acc) AS mean, stddev_pop(acc) AS std, avg(CASE WHEN acc > 0 THEN acc END) AS pm, avg(CASE WHEN acc > 0 THEN ln(acc) END) AS lm
  FROM acc WHERE scenario = 'historical' AND year(month) BETWEEN 1995 AND 1999 AND acc IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT *, ln(pm) - lm AS s FROM g), k0 AS (SELECT *, CASE WHEN n_pos >= 20 AND s > 0 THEN (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) END AS k0 FROM k), {STEPS}"""


@query(f"WITH {POOLED} SELECT state, CAST(moy AS INT) AS moy, n, n_pos, round(q, 6) AS q, round(mean, 6) AS mean, round(std, 6) AS std, round(k3, 5) AS shape, round(pm / k3, 5) AS scale FROM k3", last=1999)
def spi_fit(spark, d):
    """All parameters, gamma's by maximum likelihood, of a state's districts and models together: 20 positive sums and more of each month."""
    p = spi.fit(accumulated(spark, d), ["state"], B5)
    return p.select("state", "moy", "n", "n_pos", "q", "mean", "std", F.round("shape", 5).alias("shape"), F.round("scale", 5).alias("scale"))


@query(f"WITH {SPI} SELECT {S}, month, round(acc, 6) AS acc, round(spi, 6) AS spi FROM spi", last=1999)
def spi_transform(spark, d):
    return spi_values(spark, d)


@query(f"WITH {SPI} SELECT {S}, CAST(year(month) AS INT) AS year, round(avg(spi), 6) AS spi_mean, CAST(count(*) FILTER (spi < -1) AS DOUBLE) AS months_below, CAST(count(*) FILTER (spi > 1) AS DOUBLE) AS months_above FROM spi GROUP BY ALL HAVING count(spi) >= 9", last=1999)
def spi_annualize(spark, d):
    return spi.annualize(spi_values(spark, d), SERIES)


STAT = ("mean", "std", "min", "max", "median", "pct_below_1", "pct_below_2", "pct_above_1", "pct_above_2", "base_mean", "base_std")


@query(f"""WITH {SPI}, g AS (SELECT {S}, count(spi) AS n, avg(spi) AS mean, stddev_samp(spi) AS std, min(spi) AS min, max(spi) AS max, median(spi) AS median, avg(CASE WHEN spi < -1 THEN 1 ELSE 0 END) * 100 AS pct_below_1, avg(CASE WHEN spi < -2 THEN 1 ELSE 0 END) * 100 AS pct_below_2,
avg(CASE WHEN spi > 1 THEN 1 ELSE 0 END) * 100 AS pct_above_1, avg(CASE WHEN spi > 2 THEN 1 ELSE 0 END) * 100 AS pct_above_2, avg(spi) FILTER (year(month) BETWEEN 1995 AND 1999) AS base_mean, stddev_samp(spi) FILTER (year(month) BETWEEN 1995 AND 1999) AS base_std FROM spi WHERE spi IS NOT NULL GROUP BY ALL)
SELECT {S}, n, {', '.join(f'round({c}, 6) AS {c}' for c in STAT)}, abs(base_mean) < 0.3 AS mean_ok, base_std BETWEEN 0.7 AND 1.3 AS std_ok FROM g""", last=1999)
def spi_diagnostics(spark, d):
    return spi.diagnostics(spi_values(spark, d), SERIES, B5)


def adapter_inputs(spark, d):
    """Series of full years, scenarios spliced to their history, summed over three months."""
    return spi.spliced(monthly(spark, d, 1999), UM, 3)


ADAPTER = f"""{MONTHLY}, e AS (SELECT {S}, min(month) AS a, max(month) AS b FROM monthly GROUP BY ALL),
e2 AS (SELECT {S}, CASE WHEN month(a) = 1 THEN a ELSE CAST(date_trunc('year', a) + INTERVAL 12 MONTH AS DATE) END AS a, CASE WHEN month(b) = 12 THEN b ELSE CAST(date_trunc('year', b) - INTERVAL 1 MONTH AS DATE) END AS b FROM e),
fy AS (SELECT {S}, month, total, count(*) OVER (PARTITION BY {S}) = date_diff('month', a, b) + 1 AS contiguous FROM monthly JOIN e2 USING ({S}) WHERE month BETWEEN a AND b),
own AS (SELECT {S}, min(month) AS a, max(month) AS b, any_value(contiguous) AS contiguous FROM fy GROUP BY ALL),
sp AS (SELECT o.state, o.district, o.model, o.scenario, o.a, o.contiguous, CAST(unnest(generate_series(least(o.a, coalesce(h.a, o.a)), o.b, INTERVAL 1 MONTH)) AS DATE) AS month FROM own o LEFT JOIN (SELECT * FROM own WHERE scenario = 'historical') h ON h.state = o.state AND h.district = o.district AND h.model = o.model),
fl AS (SELECT sp.*, coalesce(x.total, h.total, 0) AS total FROM sp LEFT JOIN fy x ON x.state = sp.state AND x.district = sp.district AND x.model = sp.model AND x.scenario = sp.scenario AND x.month = sp.month LEFT JOIN fy h ON h.state = sp.state AND h.district = sp.district AND h.model = sp.model AND h.scenario = 'historical' AND h.month = sp.month),
ac AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN sum(total) OVER w END AS acc FROM fl WINDOW w AS (PARTITION BY {S} ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
cu AS (SELECT {S}, month, contiguous, CASE WHEN scenario = 'historical' OR date_diff('month', a, month) >= 2 THEN acc END AS acc FROM ac WHERE month >= a),
ad AS (SELECT {S}, month, contiguous, CASE WHEN contiguous AND count(acc) OVER (PARTITION BY {S}) >= 24 THEN acc END AS acc FROM cu)"""


@query(f"WITH {ADAPTER} SELECT {S}, month, contiguous, round(acc, 6) AS acc FROM ad", last=1999)
def spi_adapter_series(spark, d):
    return adapter_inputs(spark, d)


def _clipped(h: str) -> str:
    return f"greatest(1e-6, least(1 - 1e-6, {h}))"


def gamma_spi_sql(rows: str, unit: str, fit: str = "fit") -> str:
    """spi of rows beside parameters n, q, mean, std, shape, scale: the quantile is taken of a column of its own."""
    on = " AND ".join(f"r.{c} = {fit}.{c}" for c in unit.split(", "))
    return f"""pr AS (SELECT r.*, mean, std, shape, CASE WHEN shape IS NOT NULL AND acc IS NOT NULL THEN {_clipped(f'q + (1 - q) * ({gamma_cdf_sql("(acc / scale)", "shape")})')} END AS h FROM {rows} r LEFT JOIN {fit} ON {on} AND month(r.month) = {fit}.moy),
spi AS (SELECT *, CASE WHEN shape IS NOT NULL THEN {normal_quantile_sql('h')} WHEN std = 0 THEN 0 WHEN (acc - mean) / nullif(std, 0) IS NOT NULL THEN greatest(least((acc - mean) / nullif(std, 0), {spi.LIMIT}), -{spi.LIMIT}) END AS spi FROM pr)"""


@query(f"WITH {POOLED}, fit AS (SELECT *, k3 AS shape, pm / k3 AS scale FROM k3), {gamma_spi_sql('acc', 'state')} SELECT {S}, month, round(acc, 6) AS acc, round(spi, 6) AS spi FROM spi", last=1999)
def spi_transform_pooled(spark, d):
    """Values by parameters of a state's districts and models together: months of 20 positive sums and more go by the gamma law."""
    acc = accumulated(spark, d)
    return spi.transform(acc, spi.fit(acc, ["state"], B5), ["state"], SERIES)


THOM = """tb AS (SELECT state, district, model, CAST(month(month) AS INT) AS moy, avg(CASE WHEN acc = 0 THEN 1.0 ELSE 0.0 END) AS q, avg(acc) AS mean, stddev_pop(acc) AS std, avg(CASE WHEN acc > 0 THEN acc END) AS pm, ln(avg(CASE WHEN acc > 0 THEN acc END)) - avg(CASE WHEN acc > 0 THEN ln(acc) END) AS s
  FROM ad WHERE scenario = 'historical' AND year(month) BETWEEN 1995 AND 1999 AND acc IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
ts AS (SELECT *, CASE WHEN s > 1e-12 THEN (1 + sqrt(1 + 4 * s / 3)) / (4 * s) END AS shape FROM tb), fit AS (SELECT *, pm / shape AS scale FROM ts)"""
GAMMA_SQL = f"{ADAPTER}, {THOM}, {gamma_spi_sql('ad', 'state, district, model')}"
PEARSON = f"""pb AS (SELECT state, district, model, month(month) AS moy, acc, avg(acc) OVER w AS mean, stddev_pop(acc) OVER w AS sp, stddev_samp(acc) OVER w AS std FROM ad WHERE scenario = 'historical' AND year(month) BETWEEN 1995 AND 1999 AND acc IS NOT NULL WINDOW w AS (PARTITION BY state, district, model, month(month))),
pg AS (SELECT state, district, model, moy, any_value(mean) AS mean, any_value(std) AS std, avg((acc - mean) ** 3) / nullif(any_value(sp) ** 3, 0) AS skew FROM pb GROUP BY ALL),
pk AS (SELECT *, CASE WHEN abs(skew) < 1e-3 THEN 1e-3 ELSE skew END AS g FROM pg),
px AS (SELECT ad.*, std, g, 4 / (g * g) AS k, (acc - mean) / nullif(std, 0) * sign(g) * sqrt(4 / (g * g)) + 4 / (g * g) AS t FROM ad LEFT JOIN pk ON ad.state = pk.state AND ad.district = pk.district AND ad.model = pk.model AND month(ad.month) = pk.moy),
pc AS (SELECT *, CASE WHEN std > 0 AND acc IS NOT NULL THEN {gamma_cdf_sql('t', 'k')} END AS law FROM px),
ph AS (SELECT *, {_clipped('CASE WHEN g > 0 THEN law ELSE 1 - law END')} AS h FROM pc),
pearson AS (SELECT {{S}}, month, acc, CASE WHEN law IS NOT NULL THEN {normal_quantile_sql('h')} END AS spi FROM ph)""".replace("{S}", S)


@query(f"WITH {GAMMA_SQL} SELECT {S}, month, round(acc, 6) AS acc, round(spi, 6) AS spi FROM spi", last=1999)
def spi_adapter_gamma(spark, d):
    a = adapter_inputs(spark, d)
    return spi.transform(a, spi.thom_gamma(a, UM, B5), UM)


def pearson_values(spark, d):
    a = adapter_inputs(spark, d)
    base = a.where((F.col("scenario") == "historical") & F.year("month").between(*B5) & F.col("acc").isNotNull())
    p = base.groupBy(*UM, F.month("month").alias("moy")).agg(F.avg("acc").alias("mean"), F.stddev("acc").alias("std"), F.skewness("acc").alias("skew"))
    return spi.pearson3(a, p, UM)


@query(f"WITH {ADAPTER}, {PEARSON} SELECT {S}, month, round(acc, 6) AS acc, round(spi, 5) AS spi FROM pearson", last=1999)
def spi_adapter_pearson(spark, d):
    return pearson_values(spark, d).withColumn("spi", F.round("spi", 5))


@query(f"""WITH {GAMMA_SQL}, {PEARSON}, b AS (SELECT {S}, spi.spi AS g, pearson.spi AS p FROM spi JOIN pearson USING ({S}, month)),
m AS (SELECT *, avg(g) FILTER (p IS NOT NULL) OVER w AS mg, avg(p) FILTER (g IS NOT NULL) OVER w AS mp FROM b WINDOW w AS (PARTITION BY {S}))
SELECT {S}, round(avg((g - mg) * (p - mp)) / nullif(stddev_pop(g) * stddev_pop(p), 0), 5) AS correlation, count(*) AS n FROM m GROUP BY ALL""", last=1999)
def spi_compare(spark, d):
    """Correlation of the two laws over each series; months where one has no value don't count in it."""
    g = spi_adapter_gamma(spark, d)
    p = pearson_values(spark, d).select(*SERIES, "month", F.col("spi").alias("spi_p"))
    rows = g.join(p, [*SERIES, "month"]).groupBy(*SERIES)
    return rows.agg(F.round(F.covar_pop("spi", "spi_p") / F.nullif(F.stddev_pop("spi") * F.stddev_pop("spi_p"), F.lit(0.0)), 5).alias("correlation"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SPI} SELECT {S}, month, round(spi, 6) AS spi, CAST(3 AS INT) AS scale, 'normal' AS distribution, '1995-1999' AS baseline FROM spi", last=1999)
def sink_spi_monthly(spark, d):
    """Monthly SPI kept with its provenance, the model too: one model's scenario is committed first, then all history, then what is asked for and not held yet; a second writer of a key and one that died change nothing."""
    root = scratch(spark, "spi")
    how = ["scale", "distribution", "baseline", "model", "scenario"]
    marked = spi_values(spark, d).withColumn("scale", F.lit(3)).withColumn("distribution", F.lit("normal")).withColumn("baseline", F.lit("1995-1999"))
    of_one = marked.where("model = 'A' and scenario = 'ssp585'")
    commits.commit(of_one, root, how)
    commits.commit(marked.where("scenario = 'historical'"), root, how)
    commits.commit(of_one, root, how)
    commits.stage(marked.where("scenario = 'ssp245'"), root, how)  # never published
    wanted = panel(spark, d, 1999).select("model", "scenario").distinct().select(F.lit(3).alias("scale"), F.lit("normal").alias("distribution"), F.lit("1995-1999").alias("baseline"), "model", "scenario")
    commits.commit(marked.join(commits.missing_keys(wanted, root, how), how, "left_semi"), root, how)
    return commits.read_committed(spark, root, marked.schema, how).select(*SERIES, "month", "spi", "scale", "distribution", "baseline")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS time, user_id % 20 AS lat, user_id % 30 AS lon, event_id, CASE WHEN event_id % 5 > 0 THEN CASE event_id % 3 WHEN 0 THEN value * 1000 WHEN 1 THEN value * 86400 ELSE value END END AS mm FROM events)
SELECT time, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CAST(year(time) AS INT) AS year, round(arg_min(mm, event_id) FILTER (mm IS NOT NULL), 6) AS value FROM e WHERE lat BETWEEN 5 AND 15 AND lon BETWEEN 3 AND 22 GROUP BY ALL""")
def stage_reanalysis(spark, d):
    """Events as readings in metres, a flux or mm, a fifth of them missing; written by year and read back."""
    unit = F.element_at(F.array(F.lit("m"), F.lit("kg m-2 s-1"), F.lit("mm")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("valid_time"), (F.col("user_id") % 20).cast("double").alias("latitude"), (F.col("user_id") % 30).cast("double").alias("longitude"), F.when(F.col("event_id") % 5 == 0, F.lit(-999.0)).otherwise(F.col("value")).alias("value"), unit.alias("units"))
    path = scratch(spark, "staged")
    io.write_partitioned(io.stage_reanalysis(e, 3.0, 5.0, 22.0, 15.0, "event_id"), path, "year")
    return spark.read.parquet(path).select("time", "lat", "lon", "year", "value")


REPORT = "state, district, slug, scenario"


@query(f"""WITH {CASE_SQL} SELECT 'summary' AS kind, {REPORT}, '1999-2001' AS time, round(current, 6) AS value FROM p UNION ALL SELECT 'timeseries', {REPORT}, CAST(year AS VARCHAR), round(m, 6) FROM ye UNION ALL SELECT 'scenario_mean', {REPORT}, period, round(mean, 6) FROM master""", last=1998)
def sink_case_study(spark, d):
    """Summary, series and scenario means of every unit as CSV tables, read back as one."""
    path = scratch(spark, "case-study")
    y = yearly(spark, d)
    m = ensemble.ensemble_stats(ensemble.period_mean(y, period_dim(spark), UNIT, min_years=3), UNIT)
    parts = {
        "summary": m.where("period = '1999-2001'").select(*UNIT, "slug", "scenario", F.col("period").alias("time"), F.coalesce("mean", "median").alias("value")),
        "timeseries": y.groupBy(*UNIT, "slug", "scenario", F.col("year").cast("string").alias("time")).agg(F.avg("value").alias("value")),
        "scenario_mean": m.select(*UNIT, "slug", "scenario", F.col("period").alias("time"), F.col("mean").alias("value")),
    }
    out = None
    for kind, rows in parts.items():
        rows.write.csv(f"{path}/{kind}", header=True)
        back = io.scan_csv_table(spark, f"{path}/{kind}", "state string, district string, slug string, scenario string, time string, value double").withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out.select("kind", *UNIT, "slug", "scenario", "time", "value")
