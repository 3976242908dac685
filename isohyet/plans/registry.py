"""The registry of yearly metrics, and the plan that builds any of them from one daily panel.

A metric names a builder: a function (days, unit columns, metric) -> DataFrame of
unit, scenario, year, value. Metrics that are plain aggregates of a year share
one grouped pass; a new metric is a new row, a new kind a new builder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import indices, spi
from isohyet.sources.adapter import KELVIN

BASELINE = (1981, 2010)


@dataclass(frozen=True)
class Metric:
    slug: str
    var: str
    kind: str
    params: dict = field(default_factory=dict)
    higher_is_worse: bool = True


# Slugs, variables and parameters of the active metrics, in their order.
METRICS = [
    Metric("txx_annual_max", "tasmax", "max"),
    Metric("tnx_annual_max", "tasmin", "max"),
    Metric("tnn_annual_min", "tasmin", "min"),
    Metric("tx90p_hot_days_pct", "tasmax", "doy_exceedance", {"q": 0.9}),
    Metric("tn90p_warm_nights_pct", "tasmin", "doy_exceedance", {"q": 0.9}),
    Metric("tx10p_cool_days_pct", "tasmax", "doy_exceedance", {"q": 0.1, "above": False}),
    Metric("tn10p_cool_nights_pct", "tasmin", "doy_exceedance", {"q": 0.1, "above": False}),
    Metric("twb_annual_mean", "tas", "wet_bulb", {"column": "wb_mean"}),
    Metric("twb_annual_max", "tas", "wet_bulb", {"column": "wb_max"}),
    Metric("twb_days_ge_30", "tas", "wet_bulb", {"column": "wb_days_ge", "hot": 30.0}),
    Metric("wbd_le_3", "tas", "wet_bulb", {"column": "depression_days_le", "near": 3.0}),
    Metric("wbd_le_6", "tas", "wet_bulb", {"column": "depression_days_le", "near": 6.0}),
    Metric("txge30_hot_days", "tasmax", "count_ge", {"limit": 30.0 + KELVIN}),
    Metric("txge35_extreme_heat_days", "tasmax", "count_ge", {"limit": 35.0 + KELVIN}),
    Metric("tasmin_tropical_nights_gt20", "tasmin", "count_gt", {"limit": 20.0 + KELVIN}),
    Metric("wsdi_warm_spell_days", "tasmax", "spells", {"q": 0.9, "least": 6, "column": "days_in_runs"}),
    Metric("hwfi_tmean_90p", "tas", "spells", {"q": 0.9, "least": 5, "column": "days_in_runs"}),
    Metric("hwfi_events_tmean_90p", "tasmax", "spells", {"q": 0.9, "least": 5, "column": "events"}),
    Metric("hwa_heatwave_amplitude", "tasmax", "heatwave_peak", {"q": 0.9, "least": 5, "column": "amplitude"}),
    Metric("tasmax_summer_mean", "tasmax", "seasonal_mean", {"months": (3, 4, 5)}),
    Metric("tas_annual_mean", "tas", "mean"),
    Metric("tas_summer_mean", "tas", "seasonal_mean", {"months": (3, 4, 5)}),
    Metric("tas_winter_mean", "tas", "seasonal_mean", {"months": (12, 1, 2)}),
    Metric("tasmin_winter_mean", "tasmin", "seasonal_mean", {"months": (12, 1, 2)}),
    Metric("dtr_daily_temp_range", "tasmax", "range", {"column": "daily_range"}),
    Metric("etr_extreme_temp_range", "tasmax", "range", {"column": "extreme_range"}),
    Metric("fd_frost_days", "tasmin", "count_lt", {"limit": 0.0 + KELVIN}),
    Metric("tnlt2_cold_nights", "tasmin", "count_lt", {"limit": 2.0 + KELVIN}),
    Metric("csdi_cold_spell_days", "tasmin", "spells", {"q": 0.1, "least": 6, "above": False, "column": "days_in_runs"}),
    Metric("gsl_growing_season", "tas", "growing_season", {"limit": 5.0 + KELVIN, "least": 6}, False),
    Metric("pr_max_1day_precip", "pr", "rain_max"),
    Metric("pr_max_5day_precip", "pr", "rx5day"),
    Metric("rain_gt_2p5mm", "pr", "count_gt", {"limit": 2.5}),
    Metric("r20mm_very_heavy_precip_days", "pr", "count_gt", {"limit": 20.0}),
    Metric("r95p_very_wet_precip", "pr", "r95p", {"q": 0.95, "wet": 1.0, "column": "r95p_total"}),
    Metric("r95ptot_contribution_pct", "pr", "r95p", {"q": 0.95, "wet": 1.0, "column": "r95p_contribution"}),
    Metric("pr_simple_daily_intensity", "pr", "intensity", {"wet": 1.0}),
    Metric("prcptot_annual_total", "pr", "wet_total", {"wet": 1.0}),
    Metric("cwd_consecutive_wet_days", "pr", "rain_runs", {"wet": 1.0, "column": "cwd"}),
    Metric("pr_consecutive_dry_days_lt1mm", "pr", "rain_runs", {"wet": 1.0, "column": "cdd"}),
    Metric("spi3_drought_index", "pr", "spi", {"scale": 3, "column": "spi_mean"}, False),
    Metric("spi6_drought_index", "pr", "spi", {"scale": 6, "column": "spi_mean"}, False),
    Metric("spi12_drought_index", "pr", "spi", {"scale": 12, "column": "spi_mean"}, False),
    Metric("spi3_count_months_lt_minus1", "pr", "spi", {"scale": 3, "column": "below_1"}),
    Metric("spi3_count_months_lt_minus2", "pr", "spi", {"scale": 3, "column": "below_2"}),
    Metric("spi3_count_months_gt_plus1", "pr", "spi", {"scale": 3, "column": "above_1"}),
    Metric("spi3_count_months_gt_plus2", "pr", "spi", {"scale": 3, "column": "above_2"}),
    Metric("spi6_count_months_lt_minus1", "pr", "spi", {"scale": 6, "column": "below_1"}),
    Metric("spi6_count_months_lt_minus2", "pr", "spi", {"scale": 6, "column": "below_2"}),
    Metric("spi6_count_months_gt_plus1", "pr", "spi", {"scale": 6, "column": "above_1"}),
    Metric("spi6_count_months_gt_plus2", "pr", "spi", {"scale": 6, "column": "above_2"}),
    Metric("spi12_count_months_lt_minus1", "pr", "spi", {"scale": 12, "column": "below_1"}),
    Metric("spi12_count_months_lt_minus2", "pr", "spi", {"scale": 12, "column": "below_2"}),
    Metric("spi12_count_months_gt_plus1", "pr", "spi", {"scale": 12, "column": "above_1"}),
    Metric("spi12_count_months_gt_plus2", "pr", "spi", {"scale": 12, "column": "above_2"}),
]

# Themes and their metrics, in their order.
BUNDLES = {
    "Heat Risk": [
        "tas_annual_mean",
        "txx_annual_max",
        "txge30_hot_days",
        "txge35_extreme_heat_days",
        "tasmin_tropical_nights_gt20",
        "tx90p_hot_days_pct",
        "tn90p_warm_nights_pct",
        "wsdi_warm_spell_days",
        "hwfi_tmean_90p",
        "hwfi_events_tmean_90p",
        "hwa_heatwave_amplitude",
        "tnx_annual_max",
        "tasmax_summer_mean",
        "tas_summer_mean",
    ],
    "Heat Stress": [
        "twb_annual_mean",
        "twb_annual_max",
        "twb_days_ge_30",
        "wbd_le_3",
        "wbd_le_6",
    ],
    "Cold Risk": [
        "tas_winter_mean",
        "tasmin_winter_mean",
        "fd_frost_days",
        "tnlt2_cold_nights",
        "tx10p_cool_days_pct",
        "tn10p_cool_nights_pct",
        "csdi_cold_spell_days",
        "tnn_annual_min",
    ],
    "Agriculture & Growing Conditions": [
        "gsl_growing_season",
        "tasmax_summer_mean",
        "tasmin_winter_mean",
        "dtr_daily_temp_range",
    ],
    "Flood & Extreme Rainfall Risk": [
        "pr_max_1day_precip",
        "pr_max_5day_precip",
        "r20mm_very_heavy_precip_days",
        "r95p_very_wet_precip",
        "r95ptot_contribution_pct",
        "cwd_consecutive_wet_days",
    ],
    "Rainfall Totals & Typical Wetness": [
        "prcptot_annual_total",
        "pr_simple_daily_intensity",
        "rain_gt_2p5mm",
    ],
    "Drought Risk": [
        "pr_consecutive_dry_days_lt1mm",
        "spi6_drought_index",
        "spi6_count_months_lt_minus1",
    ],
    "Drought Risk (Advanced)": [
        "spi3_drought_index",
        "spi3_count_months_lt_minus1",
        "spi3_count_months_lt_minus2",
        "spi6_drought_index",
        "spi6_count_months_lt_minus1",
        "spi6_count_months_lt_minus2",
        "spi12_drought_index",
        "spi12_count_months_lt_minus1",
        "spi12_count_months_lt_minus2",
    ],
    "Temperature Variability": [
        "dtr_daily_temp_range",
        "etr_extreme_temp_range",
    ],
}


def bundle_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i, s) for b, slugs in BUNDLES.items() for i, s in enumerate(slugs)], "bundle string, position int, slug string")


def metric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.slug, m.var, m.kind, m.higher_is_worse) for m in METRICS], "slug string, var string, kind string, higher_is_worse boolean")


def _wet(v: Column, wet: float) -> Column:
    return F.when(v >= wet, v)


#: Kinds that are one aggregate of a year.
PLAIN: dict[str, Callable[[Column, dict], Column]] = {
    "max": lambda v, p: F.max(v) - KELVIN,
    "min": lambda v, p: F.min(v) - KELVIN,
    "mean": lambda v, p: F.avg(v) - KELVIN,
    "count_ge": lambda v, p: indices.count_if(v >= p["limit"]),
    "count_gt": lambda v, p: indices.count_if(v > p["limit"]),
    "count_lt": lambda v, p: indices.count_if(v < p["limit"]),
    "rain_max": lambda v, p: F.max(v),
    "intensity": lambda v, p: F.coalesce(F.sum(v) / F.nullif(F.count_if(v >= p["wet"]), F.lit(0)), F.lit(0.0)),
    "wet_total": lambda v, p: F.coalesce(F.sum(_wet(v, p["wet"])), F.lit(0.0)),
}


def _spi(days: DataFrame, unit: list[str], m: Metric, baseline: tuple[int, int], least_months: int) -> DataFrame:
    keys = [*unit, "scenario"]
    monthly = days.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.sum(m.var).alias("total"))
    acc = spi.accumulate(monthly, keys, m.params["scale"])
    values = spi.transform(acc, spi.fit(acc, unit, baseline), unit)
    one = spi.annualize(values, keys, least_months).withColumnsRenamed({"months_below": "below_1", "months_above": "above_1"})
    two = spi.annualize(values, keys, least_months, below=-2.0, above=2.0).select(*keys, "year", F.col("months_below").alias("below_2"), F.col("months_above").alias("above_2"))
    return one.join(two, [*keys, "year"])


def _keys(u: list[str]) -> list[str]:
    return [*u, "scenario", "year"]


#: Kinds with a plan of their own: (days, unit, metric, baseline) -> unit, scenario, year and the columns that its metrics name.
BUILDERS: dict[str, Callable] = {
    "wet_bulb": lambda d, u, m, b: indices.wet_bulb_indices(d, _keys(u), m.params.get("hot", 30.0), m.params.get("near", 3.0)),
    "seasonal_mean": lambda d, u, m, b: indices.seasonal_mean(d, _keys(u), m.var, m.params["months"]).withColumnRenamed("seasonal_mean", "value"),
    "range": lambda d, u, m, b: indices.temperature_ranges(d, _keys(u)),
    "growing_season": lambda d, u, m, b: indices.growing_season_length(d, _keys(u), m.var, m.params["limit"], m.params["least"]).withColumnRenamed("gsl", "value"),
    "rx5day": lambda d, u, m, b: indices.rx5day(d, _keys(u), m.var).withColumnRenamed("rx5day", "value"),
    "r95p": lambda d, u, m, b: indices.r95p(d, u, b, m.var, m.params["wet"], m.params["q"]),
    "rain_runs": lambda d, u, m, b: indices.wet_and_dry_runs(d, _keys(u), m.var, m.params["wet"]),
    "spi": lambda d, u, m, b: _spi(d, u, m, b, 9),
}

#: Kinds against thresholds of the day of the year: all of them share one pass and one set of thresholds.
DOY = ("doy_exceedance", "spells", "heatwave_peak")


def _doy(days: DataFrame, unit: list[str], metrics: list[Metric], baseline: tuple[int, int]) -> DataFrame:
    """keys and a column for each metric of the DOY kinds."""
    of = lambda kind: [m for m in metrics if m.kind == kind]
    spell = lambda m: (m.var, m.params["q"], m.params.get("above", True), m.params["least"])
    peak = lambda m: (m.var, m.params["q"], m.params["least"])
    names = {x: f"c{i}__" for i, x in enumerate(dict.fromkeys([*map(spell, of("spells")), *map(peak, of("heatwave_peak"))]))}
    made = indices.against_thresholds(
        days, unit, baseline, {m.slug: (m.var, m.params["q"], m.params.get("above", True)) for m in of("doy_exceedance")},
        {names[x]: x for x in map(spell, of("spells"))}, {names[x]: x for x in map(peak, of("heatwave_peak"))},
    )
    column = lambda m: m.params.get("column", "value")
    of_peak = lambda m: F.col(names[peak(m)])["magnitude"] if column(m) == "magnitude" else F.col(names[peak(m)])["peak"] - KELVIN
    return made.select(
        *_keys(unit), *[m.slug for m in of("doy_exceedance")], *[F.col(names[spell(m)])[column(m)].cast("double").alias(m.slug) for m in of("spells")], *[of_peak(m).alias(m.slug) for m in of("heatwave_peak")],
    )


#: Metrics that users added, by slug.
ADDED: dict[str, Metric] = {}


def register(metric: Metric, aggregate: Callable | None = None, plan: Callable | None = None) -> Metric:
    """Add a metric under its slug, for build() to find by name.

    A new kind comes with its function: ``aggregate`` (value column, params) ->
    aggregate of a year, or ``plan`` (days, unit, metric, baseline) -> unit,
    scenario, year, value. A slug or kind that is there already is an error.
    """
    if metric.slug in ADDED or any(m.slug == metric.slug for m in METRICS):
        raise ValueError(f"the metric {metric.slug} is there already")
    if aggregate is not None or plan is not None:
        if metric.kind in PLAIN or metric.kind in BUILDERS or metric.kind in DOY:
            raise ValueError(f"the kind {metric.kind} is there already")
        if plan is not None:
            BUILDERS[metric.kind] = plan
        else:
            PLAIN[metric.kind] = aggregate
    if metric.kind not in PLAIN and metric.kind not in BUILDERS and metric.kind not in DOY:
        raise ValueError(f"the kind {metric.kind} has no function")
    ADDED[metric.slug] = metric
    return metric


def _run(m: Metric) -> tuple:
    """What metrics of one builder must have in common to come out of one run of it."""
    usual = {("hot", 30.0), ("near", 3.0)} if m.kind == "wet_bulb" else set()
    return m.kind, m.var, tuple(sorted((k, v) for k, v in m.params.items() if k != "column" and (k, v) not in usual))


def build(days: DataFrame, unit: list[str], slugs: list[str] | None = None, baseline: tuple[int, int] = BASELINE) -> DataFrame:
    """slug, unit, scenario, year, value of the metrics asked for, by slug, registered ones too (all of METRICS if none are named).

    unit holds the model; days should be a stored table if more than one builder
    runs. Plain metrics share one grouped pass, those against thresholds of the
    day of the year another; metrics that differ only in the column they take
    share one run of their builder. A year that a metric has no
    value for keeps its row with a null. An unknown slug is an error.
    """
    every = {m.slug: m for m in METRICS} | ADDED
    unknown = [s for s in slugs or () if s not in every]
    if unknown:
        raise ValueError(f"no such metrics: {', '.join(unknown)}")
    wanted = METRICS if slugs is None else [every[s] for s in slugs]
    keys = _keys(unit)
    parts = []
    plain = [m for m in wanted if m.kind in PLAIN]
    if plain:
        wide = days.groupBy(*keys).agg(*[PLAIN[m.kind](F.col(m.var), m.params).alias(m.slug) for m in plain])
        parts.append(wide.unpivot(keys, [m.slug for m in plain], "slug", "value"))
    by_doy = [m for m in wanted if m.kind in DOY]
    if by_doy:
        parts.append(_doy(days, unit, by_doy, baseline).unpivot(keys, [m.slug for m in by_doy], "slug", "value"))
    runs: dict[tuple, list[Metric]] = {}
    for m in wanted:
        if m.kind in BUILDERS:
            runs.setdefault(_run(m), []).append(m)
    for same in runs.values():
        made = BUILDERS[same[0].kind](days, unit, same[0], baseline)
        parts.append(made.select(*keys, *[F.col(m.params.get("column", "value")).cast("double").alias(m.slug) for m in same]).unpivot(keys, [m.slug for m in same], "slug", "value"))
    return reduce(DataFrame.unionByName, parts).select("slug", *keys, "value")
