"""Periods, ensembles, ranks, names, matching, geometry and SPI on small tables."""

import datetime as dt
import difflib
import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import names, risk, units
from isohyet.operators import ensemble, matching, ranking, spatial, spi
from isohyet.sources import commits, io


def test_period_gate(spark):
    rows = [("s", "u1", "m", "historical", y, float(y)) for y in range(1990, 2003)] + [("s", "u2", "m", "historical", 1990, 1.0), ("s", "u1", "n", "historical", 1990, 5.0)]
    yearly = spark.createDataFrame(rows, "slug string, unit string, model string, scenario string, year int, value double")
    dim = spark.createDataFrame([("historical", "1990-2010", 1990, 2010)], "scenario string, period string, first int, last int")
    got = {(r.unit, r.model): (r.value, r.years_used_count, r.years_requested) for r in ensemble.period_mean(yearly, dim, ["unit"]).collect()}
    assert got == {("u1", "m"): (1996.0, 13, 21), ("u2", "m"): (1.0, 1, 21)}  # years count over all units; model n has too few


def test_ensemble(spark):
    rows = [("s", "u", "ssp245", "p", m, v) for m, v in (("a", 1.0), ("a", 3.0), ("b", 4.0), ("c", None))]
    r = ensemble.ensemble_stats(spark.createDataFrame(rows, "slug string, unit string, scenario string, period string, model string, value double"), ["unit"]).first()
    assert (r.n_models, r["mean"], r["std"], r["median"], r.p05, r.p95, r.values_per_model) == (2, 3.0, 1.0, 3.0, 2.1, 3.9, {"a": 2.0, "b": 4.0})


def test_ranks_and_percentiles(spark):
    rows = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 2.0), ("B", "z", 3.0), ("A", "n", None)], "state string, district string, value double")
    got = {r.district: (r["rank"], r.percentile) for r in ranking.rank_in_group(rows, ["state"]).collect()}
    assert got == {"x": (2, 50.0), "y": (1, 100.0), "z": (1, 100.0), "n": (None, None)}
    low = {r.district: r["rank"] for r in ranking.rank_in_group(rows, ["state"], higher_is_worse=False).collect()}
    assert low["x"] == 1 and low["y"] == 2


def test_average_method_of_rankings(spark):
    rows = spark.createDataFrame([("A", float(v), d) for v, d in ((1, None), (2, 1.0), (2, 5.0), (3, 5.0))], "state string, value double, delta double")
    got = sorted((r.value, r.rank_value, r.percentile, r.rank_delta or 0) for r in ranking.rankings_table(rows, ["state"]).collect())
    assert [g[2] for g in got] == [25.0, 62.5, 62.5, 100.0] and [g[1] for g in got] == [4, 2, 2, 1] and sorted(g[3] for g in got) == [0, 1, 1, 3]


def test_risk_and_delta(spark):
    p = spark.createDataFrame([(v,) for v in (None, 80.0, 79.9, 60.0, 40.0, 20.0, 0.0)], "p double").select(risk.risk_class(F.col("p")).alias("c"), risk.risk_code(F.col("p")).alias("k")).collect()
    assert [r.c for r in p] == ["Unknown", "Very High", "High", "High", "Medium", "Low", "Very Low"] and [r.k for r in p] == [None, 4, 3, 3, 2, 1, 0]
    d = spark.createDataFrame([(20.0, 10.0), (5.0, 0.0)], "a double, b double").select(risk.delta_pct(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in d] == [100.0, None]


def test_wide_master_round_trip(spark):
    long = spark.createDataFrame([("m", "u", "ssp245", "2020-2040", 1.0, 0.5)], "slug string, unit string, scenario string, period string, mean double, std double")
    wide = ensemble.wide_master(long, ["unit"], [("m", "ssp245", "2020-2040")], ("mean", "std"))
    assert wide.columns == ["unit", "m__ssp245__2020-2040__mean", "m__ssp245__2020-2040__std"]
    old = wide.withColumn("rain_x_ssp585_2040_2060__mean", F.lit(7.0))
    got = {(r.slug, r.scenario, r.period, r.stat): r.value for r in ensemble.unpivot_master(old, ["unit"]).collect()}
    assert got == {("m", "ssp245", "2020-2040", "mean"): 1.0, ("m", "ssp245", "2020-2040", "std"): 0.5, ("rain_x", "ssp585", "2040-2060", "mean"): 7.0}


def test_names(spark):
    rows = spark.createDataFrame([(" Áb_c-d!  E ",)], "n string").select(names.normalize_name(F.col("n")).alias("a"), names.slugify(F.col("n")).alias("s"), names.normalize_name(F.col("n"), names.fold_full).alias("f")).first()
    assert rows.a == "ab c d e" == rows.f and rows.s == "ab_c_d_e"
    lines = spark.createDataFrame([("17.5, 78.5, Home",), ("17.5 78.5",), ("'17', \"78\"",), ("99, 78",), ("a, b",), ("",)], "t string").select(*names.parse_coordinates(F.col("t"))).collect()
    assert [(r.lat, r.lon, r.label) for r in lines] == [(17.5, 78.5, "Home"), (17.5, 78.5, None), (17.0, 78.0, None), (None, None, None), (None, None, None), (None, None, None)]
    p = spark.createDataFrame([("2020_2040",), ("x",)], "p string").select(names.canonical_period(F.col("p")).alias("p")).collect()
    assert [r.p for r in p] == ["2020-2040", "x"]


def test_merge_keeps_boundaries_of_the_masters_states(spark):
    b = spark.createDataFrame([("Pune", "MH"), ("Nashik", "MH"), ("Agra", "UP")], "district_name string, state_name string")
    m = spark.createDataFrame([("mh", "pune", 1.5)], "state string, district string, v double")
    got = {(r.district_name, r.v) for r in matching.merge_master(b, m, "state_name", "district_name").collect()}
    assert got == {("Pune", 1.5), ("Nashik", None)}


def test_match_tiers(spark):
    items = spark.createDataFrame([("S", "Pune"), ("S", "Pune City"), ("S", "Nasik"), ("S", "Qqq"), ("T", "Pune")], "state string, item string")
    u = spark.createDataFrame([("S", "PUNE"), ("S", "Nashik")], "state string, unit string")
    got = {(r.state, r.item): (r.unit, r.tier) for r in matching.match_names(items, u, "item", "unit", ["state"]).collect()}
    assert got == {("S", "Pune"): ("PUNE", 0), ("S", "Pune City"): ("PUNE", 1), ("S", "Nasik"): ("Nashik", 2), ("S", "Qqq"): (None, None), ("T", "Pune"): (None, None)}


def square(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[3,3],[3,1],[1,1]]]}'
    return spatial.explode_geojson(spark.createDataFrame([("sq", text), ("none", None), ("pt", '{"type":"Point","coordinates":[1,2]}')], "unit_key string, geometry string"))


def test_polygon_with_hole(spark):
    e = square(spark)
    assert e.count() == 8
    a = spatial.area_centroid(e).first()
    assert (a.area, a.cx, a.cy) == (12.0, 2.0, 2.0)
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 2.0), (4, 3.5, 2.0)], "id int, x double, y double")
    assert {r.id for r in spatial.containing(pts, e, "id").collect()} == {1, 4}
    got = {r.id: r.inside for r in spatial.point_in_unit(pts, e, "id").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_raster_touches(spark):
    cells = spark.createDataFrame([(i * 10 + j, i + 0.5, j + 0.5) for i in range(-1, 6) for j in range(-1, 6)], "cell_id int, x double, y double")
    tri = spatial.explode_geojson(spark.createDataFrame([("t", '{"type":"Polygon","coordinates":[[[0.5,0.5],[3.5,0.5],[0.5,3.5],[0.5,0.5]]]}')], "unit_key string, geometry string"))
    got = {r.cell_id for r in spatial.rasterize_units(cells, tri, 1.0).collect()}
    assert {0, 1, 2, 3, 10, 11, 12, 20, 21, 30} <= got <= {0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 30, 31}


def test_spherical_area(spark):
    e = spatial.explode_geojson(spark.createDataFrame([("c", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}')], "unit_key string, geometry string"))
    assert abs(spatial.spherical_area_km2(e).first().area_km2 - 12364) < 5


def test_ellipsoid_area(spark):
    """Boxes against the ellipsoid's zones, a triangle and a quadrilateral against a sum over thin strips, all within 1e-9."""
    rings = {"box": [(10, 20), (12, 20), (12, 23), (10, 23)], "south": [(-3, -60), (5, -60), (5, -58), (-3, -58)], "tri": [(70, 10), (73, 10.5), (71, 14)], "quad": [(0, 0), (2, 1), (1, 4), (-2, 3)]}
    rows = [(k, 0, 0, i, *map(float, (*r[i], *r[(i + 1) % len(r)]))) for k, r in rings.items() for i in range(len(r))]
    got = {r.unit_key: r.area_km2 for r in spatial.ellipsoid_area_km2(spark.createDataFrame(rows, "unit_key string, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")).collect()}
    a, e2 = 6378.137, 6.69437999014e-3
    for k, ring in rings.items():
        lat = np.linspace(min(y for _, y in ring), max(y for _, y in ring), 200_001)
        mid = (lat[1:] + lat[:-1]) / 2
        xs = []
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            inside = (mid > min(y1, y2)) & (mid < max(y1, y2))
            xs.append(np.where(inside, x1 + (mid - y1) * (x2 - x1) / (y2 - y1 or 1), np.nan))
        wide = np.nanmax(xs, axis=0) - np.nanmin(xs, axis=0)
        s = np.sin(np.radians(mid))
        want = float((np.radians(wide) * a * a * (1 - e2) * np.cos(np.radians(mid)) / (1 - e2 * s * s) ** 2).sum() * np.radians(lat[1] - lat[0]))
        assert abs(got[k] / want - 1) < 1e-9, k


def test_commits(spark, tmp_path):
    """Two writers of a key, one that died half way, and a key that only one model has."""
    root, keys = str(tmp_path / "t"), ["model", "scenario"]
    rows = lambda m, s, v: spark.createDataFrame([(m, s, i, v) for i in range(5)], "model string, scenario string, month int, v double")
    wanted = spark.createDataFrame([(m, s) for m in "ab" for s in ("past", "future")], "model string, scenario string")
    left = lambda: {tuple(r) for r in commits.missing_keys(wanted, root, keys).collect()}
    assert len(left()) == 4
    commits.commit(rows("a", "past", 1.0), root, keys)
    assert left() == {("a", "future"), ("b", "past"), ("b", "future")}  # model a hides nothing of b
    commits.stage(rows("b", "past", 9.0), root, keys)  # died before it was published
    assert ("b", "past") in left()
    first, second = commits.stage(rows("b", "past", 2.0), root, keys), commits.stage(rows("b", "past", 2.0), root, keys)
    for name in (first, second):
        commits.publish(spark, root, name, keys)
    got = commits.read_committed(spark, root, rows("a", "past", 1.0).schema, keys)
    assert sorted(map(tuple, got.collect())) == [("a", "past", i, 1.0) for i in range(5)] + [("b", "past", i, 2.0) for i in range(5)]
    assert left() == {("a", "future"), ("b", "future")}


def test_spi_stays_in_the_jvm(spark):
    acc = spark.createDataFrame([("u", "historical", dt.date(2000, 5, 1), 1.0)], "unit string, scenario string, month date, acc double")
    params = spark.createDataFrame([("u", 5, 1.0, 2.0, 0.3)], "unit string, moy int, mean double, std double, skew double")
    for out in (spi.transform(acc, spi.thom_gamma(acc, ["unit"], (1960, 2019)), ["unit"]), spi.pearson3(acc, params, ["unit"])):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_gamma_fit_and_transform(spark):
    rng = np.random.default_rng(0)
    rows = [("u", "m", "historical", f"{1981 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(rng.gamma(2.0, 50.0, 360))]
    monthly = spark.createDataFrame(rows, "unit string, model string, scenario string, month string, total double").withColumn("month", F.to_date("month"))
    keys = ["unit", "model", "scenario"]
    acc = spi.accumulate(monthly, keys, 3)
    p = spi.fit(acc, ["unit", "model"], (1981, 2010))
    assert all(2 < r["shape"] < 20 for r in p.collect())
    got = spi.transform(acc, p, ["unit", "model"]).where("spi is not null")
    stats = got.agg(F.avg("spi").alias("m"), F.stddev("spi").alias("s"), F.count("spi").alias("n")).first()
    assert abs(stats.m) < 0.05 and abs(stats.s - 1) < 0.1 and stats.n == 358
    yearly = spi.annualize(got, keys)
    assert yearly.count() == 30


def test_humidity(spark):
    r = spark.createDataFrame([(20.0, 20.0), (20.0, 10.0), (20.0, 30.0)], "t double, d double").select(units.relative_humidity(F.col("t"), F.col("d")).alias("rh")).collect()
    assert r[0].rh == 100 and abs(r[1].rh - 52.5) < 1 and r[2].rh == 100


def test_no_leap_days(spark):
    got = [r.d for r in spark.sql("select explode(array(date'2000-02-28', date'2000-02-29', date'2000-03-01', date'2001-03-01', date'2000-12-31')) as x").select(units.doy_noleap(F.col("x")).alias("d")).collect()]
    assert got == [59, None, 60, 60, 365]


@pytest.mark.parametrize("rows", [[("historical", "1995-2014"), ("historical", "1990_2010"), ("ssp245", "1980-1990")]])
def test_baseline_period(spark, rows):
    p = spark.createDataFrame([("s", *r) for r in rows], "slug string, scenario string, period string")
    assert ranking.find_baseline_period(p, ["slug"]).first().baseline_period == "1990_2010"
    assert ranking.find_baseline_period(p, ["slug"], ("2000-2020",)).first().baseline_period == "1990_2010"


def test_ties_of_averages_that_differ_in_their_last_bits(spark):
    rows = spark.createDataFrame([("A", "x", 5.222222222222221, 1.0), ("A", "y", 5.222222222222222, 1.0), ("A", "z", 1.0, None)], "state string, district string, value double, delta double")
    table = {r.district: (r.rank_value, r.percentile, r.rank_delta) for r in ranking.rankings_table(rows, ["state"]).collect()}
    assert table["x"] == table["y"] == (1, pytest.approx(250 / 3), 1) and table["z"] == (3, pytest.approx(100 / 3), None)
    assert {r["rank"] for r in ranking.rank_in_group(rows, ["state"]).where("district <> 'z'").collect()} == {1}
    assert {r.position for r in ranking.position_stats(rows, ["state"]).where("district <> 'z'").collect()} == {1}


def test_position_by_direction(spark):
    rows = spark.createDataFrame([("A", float(v)) for v in (1, 2, 2, 4)], "state string, value double")
    at = lambda **k: {r.value: (r.position, r.position_percentile) for r in ranking.position_stats(rows, ["state"], **k).collect()}
    assert at() == {1.0: (4, 25.0), 2.0: (2, 75.0), 4.0: (1, 100.0)}
    assert at(inclusive=False) == {1.0: (4, 0.0), 2.0: (2, 25.0), 4.0: (1, 75.0)}
    assert at(higher_is_worse=False) == {1.0: (1, 100.0), 2.0: (2, 75.0), 4.0: (4, 25.0)}
    assert at(higher_is_worse=False, inclusive=False) == {1.0: (1, 75.0), 2.0: (2, 25.0), 4.0: (4, 0.0)}


def test_top_increases_without_a_baseline(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, None), ("c", 2.0, None)], "u string, value double, delta double")
    assert [r.u for r in ranking.top_increases(rows, ["u"], 2).collect()] == ["b", "c"]


@pytest.mark.parametrize("cutoff", [0.6, 0.7, 0.72])
def test_matching_equals_all_pairs(spark, cutoff):
    """The best unit of each item against difflib over every pair of a block."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(1, 14)))
    units = [(s, word()) for s in "xy" for _ in range(25)]
    items = [(s, u[: rng.integers(0, len(u) + 1)] + word()[: rng.integers(0, 3)] + u[rng.integers(0, len(u) + 1) :]) for s, u in units]
    want = {}
    for s, i in items:
        scored = []
        for t, u in units:
            if s == t:
                if i.strip() == u:
                    scored.append((0, -1.0, u))
                elif i and u and (i in u or u in i):
                    scored.append((1, -1.0, u))
                elif (ratio := difflib.SequenceMatcher(None, i, u).ratio()) >= cutoff:
                    scored.append((2, -ratio, u))
        want[(s, i)] = (min(scored)[2], min(scored)[0]) if scored else (None, None)
    frame = lambda rows: spark.createDataFrame(rows, "state string, name string")
    got = {(r.state, r.item): (r.unit, r.tier) for r in matching.match_names(frame(items), frame(units), "name", "name", ["state"], cutoff).collect()}
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want) and sum(v[1] == 2 for v in want.values()) > 2


def test_alike_names_of_a_large_block_are_not_all_compared(spark, monkeypatch):
    """3,000 names of one block that share their first letters and all digits: only near ones are scored."""
    compared = spark.sparkContext.accumulator(0)
    ratio = matching.similarity.func

    def counted(a, b):
        compared.add(len(a))
        return ratio(a, b)

    monkeypatch.setattr(matching, "similarity", F.pandas_udf(counted, "double"))
    units = spark.range(3000).select(F.lit("s").alias("state"), F.format_string("Unit#%09d", F.col("id") * 7).alias("name"))
    items = units.select("state", F.concat(F.expr("substring(name, 1, length(name) - 1)"), F.lit("x")).alias("name"))
    got = {r.item: (r.unit, r.tier) for r in matching.match_names(items, units, "name", "name", ["state"], 0.7).collect()}
    every = [f"Unit#{i * 7:09d}" for i in range(3000)]
    assert len(got) == len({u[:-1] for u in every})
    for i in sorted(got)[::150]:
        plain = i.lower().replace("#", "")
        assert got[i] == (min((-difflib.SequenceMatcher(None, plain, u.lower().replace("#", "")).ratio(), u) for u in every)[1], 2)
    assert 0 < compared.value < 30 * 3000


def test_matching_of_names_without_a_near_one_equals_all_pairs(spark):
    """Names that differ in more than two characters, by letters left out, put in and repeated: they go through all steps."""
    rng = np.random.default_rng(4)
    units = ["".join(rng.choice(list("abcdefgh"), 14)) for _ in range(40)] + ["abab" * 60, "abc" * 75]
    items = []
    for u in units:
        for n in (0, 2, 3, 4, 5):
            chars = list(u)
            for _ in range(n):
                at = int(rng.integers(0, len(chars)))
                chars[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("abcxyz"), int(rng.integers(0, 2))))
            items.append("".join(chars) + "q" * (n == 0))
    items = sorted(set(items))

    def best(i):
        near = [(1, 0.0, u) for u in units if i in u or u in i] or [(2, -r, u) for u in units if (r := difflib.SequenceMatcher(None, i, u).ratio()) >= 0.7]
        return (min(near)[2], 0 if min(near)[2] == i else min(near)[0]) if near else (None, None)

    frame = lambda rows: spark.createDataFrame([("s", r) for r in rows], "state string, name string")
    got = {r.item: (r.unit, r.tier) for r in matching.match_names(frame(items), frame(units), "name", "name", ["state"]).collect()}
    want = {i: (i, 0) if i in units else best(i) for i in items}
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {} and {v[1] for v in want.values()} >= {1, 2}


def test_nearest_centre_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = [(f"u{i}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((30, 2)), 50 + rng.random((5, 2))]))] + [("far", 400.0, -300.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((40, 2)) * 3, rng.random((20, 2)) * 90 - 20, [[-900.0, 40.0]]]))]
    c = spark.createDataFrame(centres, "unit_key string, cx double, cy double")
    p = spark.createDataFrame([*points, (999, None, 1.0)], "id long, x double, y double")
    got = {r.id: r.unit_key for r in spatial.nearest(p, c, "id", size=0.25).collect()}
    assert got == {i: min(centres, key=lambda u: ((u[1] - x) ** 2 + (u[2] - y) ** 2, u[0]))[0] for i, x, y in points}
    assert spatial.nearest(p, c.where("1 = 0"), "id").count() == 0


def test_representative_points_are_inside(spark):
    ring = "[[0,0],[10,0],[10,10],[9,10],[9,1],[1,1],[1,10],[0,10],[0,0]]"
    e = spatial.explode_geojson(spark.createDataFrame([("cup", f'{{"type":"Polygon","coordinates":[{ring}]}}')], "unit_key string, geometry string"))
    p = spatial.representative_points(e)
    assert spatial.containing(p.withColumnRenamed("unit_key", "id"), e, "id").count() == 1


def test_feature_collections(spark):
    f = spark.createDataFrame([("s", "b", '{"type":"Point"}', None), ("s", "a", '{"type":"Point"}', 2.0), ("t", "c", None, 1.0)], "state string, unit string, geometry string, value double").withColumn("geometry", F.from_json("geometry", "type string"))
    got = {r.state: json.loads(r.geojson) for r in io.feature_collections(f, "state", "geometry", ["unit", "value"], "unit").collect()}
    assert [x["id"] for x in got["s"]["features"]] == ["a", "b"] and got["s"]["features"][1]["properties"] == {"unit": "b", "value": None}
    assert got["t"]["type"] == "FeatureCollection" and got["t"]["features"][0]["geometry"] is None


def test_portfolio_states(spark):
    rows = spark.createDataFrame([("All", 0), ("goa", 2), ("Goa", 1), ("Kerala", 5), (None, 3)], "state string, place int")
    assert {tuple(r) for r in matching.portfolio_states(rows, "state", "place", "Goa").collect()} == {("goa", "Goa"), ("kerala", "Kerala")}
    assert [tuple(r) for r in matching.portfolio_states(rows.where("state = 'All'"), "state", "place", "Goa").collect()] == [("goa", "Goa")]


def test_csv_encodings_and_filters(spark, tmp_path):
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "a.csv").write_bytes("name,v\nGoiás,1\nx,no\n".encode("latin-1"))
    assert {tuple(r) for r in io.scan_csv_table(spark, str(tmp_path / "latin"), "name string, v int").collect()} == {("Goiás", 1), ("x", None)}
    spark.range(4).selectExpr("id", "id % 2 as k").write.partitionBy("k").parquet(str(tmp_path / "t"))
    assert io.scan_table_filtered(spark, str(tmp_path / "t"), ["id"], [("k", "==", 1)]).count() == 2
    with pytest.raises(ValueError):
        io.scan_table_filtered(spark, str(tmp_path / "t"), ["id"], [("k", ">", 1)])


def test_spliced_series(spark):
    month = lambda i: dt.date(2000 + i // 12, i % 12 + 1, 1)
    rows = [("u", "historical", month(i), float(i)) for i in range(2, 50)] + [("u", "ssp", month(i), 100.0) for i in range(60, 96)]
    rows += [("v", "historical", month(i), 1.0) for i in range(48) if i != 20] + [("w", "historical", month(i), 1.0) for i in range(24)]
    got = {(r.unit, r.scenario, r.month): r.acc for r in spi.spliced(spark.createDataFrame(rows, "unit string, scenario string, month date, total double"), ["unit"], 3).collect()}
    assert min(m for u, s, m in got if (u, s) == ("u", "historical")) == month(12) and max(m for u, s, m in got if (u, s) == ("u", "historical")) == month(47)
    assert got[("u", "historical", month(12))] is None and got[("u", "historical", month(14))] == 12 + 13 + 14
    assert got[("u", "ssp", month(60))] is None is got[("u", "ssp", month(61))] and got[("u", "ssp", month(62))] == 300.0
    assert all(v is None for (u, _, _), v in got.items() if u == "v"), "a series with a gap has no sums"
    assert all(v is None for (u, _, _), v in got.items() if u == "w"), "22 valid sums are too few"


def test_pearson_and_gamma_agree_with_integration(spark):
    """Both laws against densities summed over a fine grid."""
    rng = np.random.default_rng(3)
    rows = [("u", "historical", dt.date(1960 + i, 5, 1), float(v)) for i, v in enumerate(rng.gamma(4.0, 20.0, 60))]
    acc = spark.createDataFrame(rows, "unit string, scenario string, month date, acc double")
    grid = np.linspace(1e-9, 1200.0, 600_001)
    p = spi.thom_gamma(acc, ["unit"], (1960, 2019)).first()
    law = lambda x, k, s: np.trapezoid((d := grid[grid <= x]) ** (k - 1) * np.exp(-d / s), d) / (math.gamma(k) * s**k)
    inv = statistics.NormalDist().inv_cdf
    got = {r.month: r.spi for r in spi.transform(acc, spi.thom_gamma(acc, ["unit"], (1960, 2019)), ["unit"]).collect()}
    assert all(abs(got[m] - inv(min(max(law(v, p["shape"], p["scale"]), 1e-6), 1 - 1e-6))) < 1e-3 for _, _, m, v in rows)
    x = np.array([v for *_, v in rows])
    mean, std = x.mean(), x.std(ddof=1)
    skew = ((x - mean) ** 3).mean() / x.std() ** 3
    params = spark.createDataFrame([("u", 5, float(mean), float(std), float(skew))], "unit string, moy int, mean double, std double, skew double")
    k = 4 / skew**2
    got = {r.month: r.spi for r in spi.pearson3(acc, params, ["unit"]).collect()}
    for _, _, m, v in rows:
        t = (v - mean) / std * np.sqrt(k) + k
        assert abs(got[m] - inv(min(max(law(t * 20, k, 20.0), 1e-6), 1 - 1e-6))) < 1e-3


def test_intersection_shuffles_distinct_rows(spark):
    """200,000 rows of seven years: what goes to the join is some rows a task, nulls and all."""
    years = lambda first, n: spark.range(n).select(F.when(F.col("id") % 8 > 0, first + F.col("id") % 8).alias("year"))
    both = io.intersect_distinct(years(1994, 200_000), years(1996, 100_000))
    assert sorted((r.year is None, r.year or 0) for r in both.collect()) == [(False, y) for y in range(1997, 2002)] + [(True, 0)]
    written = []

    def shuffles(node):
        if "Exchange" in node.nodeName() and "shuffleRecordsWritten" in str(node.metrics()):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        for child in children:
            shuffles(child)

    shuffles(both._jdf.queryExecution().executedPlan())
    assert written and max(written) <= 8 * spark.sparkContext.defaultParallelism


def test_large_partitions_are_written_by_several_tasks(spark, tmp_path):
    """One partition of 400,000 rows and one of ten: the large one isn't one task's."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        rows = spark.range(400_010).select(F.when(F.col("id") < 10, "few").otherwise("many").alias("k"), F.rand(1).alias("v"))
        io.write_partitioned(rows, str(tmp_path / "t"), "k")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "t" / "k=many").glob("*.parquet"))) > 2 and len(list((tmp_path / "t" / "k=few").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_010
