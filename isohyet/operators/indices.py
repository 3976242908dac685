"""Yearly climate indices: one number per unit, model, scenario and year.

Inputs are daily panels with temperatures in K, hurs in per cent or as a
fraction, and pr in mm/day. Indices of one variable share one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.units import clip, not_feb29, wet_bulb_stull
from isohyet.operators import runs, thresholds

KELVIN = 273.15


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("double")


def threshold_counts(days: DataFrame, keys: list[str], value: str, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and one count for each name -> (op, limit), op one of gt, ge, lt; nulls count as no."""
    ops = {"gt": lambda v, t: v > t, "ge": lambda v, t: v >= t, "lt": lambda v, t: v < t}
    return days.groupBy(*keys).agg(*[count_if(ops[op](F.col(value), F.lit(t))).alias(name) for name, (op, t) in limits.items()])


def annual_stats(days: DataFrame, keys: list[str], value: str, offset: float = KELVIN) -> DataFrame:
    """Mean, maximum and minimum of a year, in °C for temperatures."""
    return days.groupBy(*keys).agg((F.avg(value) - offset).alias("annual_mean"), (F.max(value) - offset).alias("annual_max"), (F.min(value) - offset).alias("annual_min"))


def seasonal_mean(days: DataFrame, keys: list[str], value: str, months: tuple[int, ...], date: str = "date", offset: float = KELVIN) -> DataFrame:
    """Mean over the months. With December, January and February, December counts for the next year, Feb 29 is dropped, and a year without any day of the December before has no value."""
    month = F.month(date)
    inside = days.where(month.isin(*months))
    if set(months) != {12, 1, 2}:
        return inside.groupBy(*keys).agg((F.avg(value) - offset).alias("seasonal_mean"))
    rest = [k for k in keys if k != "year"]
    season = inside.where(not_feb29(F.col(date))).withColumn("year", F.year(date) + F.when(month == 12, 1).otherwise(0))
    return (
        season.groupBy(*rest, "year")
        .agg((F.avg(value) - offset).alias("v"), F.count_if(month == 12).alias("before"), F.count_if(month != 12).alias("own"))
        .where("own > 0").select(*rest, "year", F.when(F.col("before") > 0, F.col("v")).alias("seasonal_mean"))
    )


def percentile_days(days: DataFrame, keys: list[str], value: str, q: float, above: bool = True) -> DataFrame:
    """Per cent of days strictly beyond the year's own percentile (linear)."""
    cut = F.percentile(value, F.lit(q))
    limits = days.groupBy(*keys).agg(cut.alias("cut__"))
    beyond = F.col(value) > F.col("cut__") if above else F.col(value) < F.col("cut__")
    return days.join(limits, keys).groupBy(*keys).agg((F.avg(beyond.cast("int")) * 100).alias("pct_days"))


def baseline_of(days: DataFrame, unit: list[str], first: int, last: int) -> DataFrame:
    """Baseline days of a series: those of the same model's historical scenario, Feb 29 left out, without the scenario column."""
    return days.where((F.col("scenario") == "historical") & F.col("year").between(first, last) & not_feb29(F.col("date"))).drop("scenario")


def against_thresholds(
    days: DataFrame, unit: list[str], baseline: tuple[int, int], exceed: dict[str, tuple] | None = None, spells: dict[str, tuple] | None = None,
    peaks: dict[str, tuple] | None = None, ge: bool = True, window: int = 5,
) -> DataFrame:
    """unit, scenario, year, n_days, and a column for each index against the thresholds of the day of the year, all of them in one pass.

    exceed: name -> (value, q, above), per cent of days beyond; a day without a
    threshold isn't beyond but counts. spells: name -> (value, q, above, least), a
    struct of longest, days_in_runs and events; nulls without a baseline. peaks:
    name -> (value, q, least), a struct of magnitude and peak of the hottest
    spell; nulls without one. Thresholds of a value and quantile are made once
    for all of them, and a year's days are looked at in order where they lie.
    """
    exceed, spells, peaks = exceed or {}, spells or {}, peaks or {}
    asked = dict.fromkeys([*((v, q) for v, q, _ in exceed.values()), *((v, q) for v, q, *_ in spells.values()), *((v, q) for v, q, _ in peaks.values())])
    names = {(v, q): f"limit{i}__" for i, (v, q) in enumerate(asked)}
    arrays = thresholds.doy_arrays(baseline_of(days, unit, *baseline), unit, {n: vq for vq, n in names.items()}, window)
    met = thresholds.attach_arrays(days, arrays, unit, list(names.values()))
    keys = [*unit, "scenario", "year"]

    def beyond(v, t, above):
        return (v >= t if ge else v > t) if above else (v <= t if ge else v < t)

    share = lambda v, q, above: F.avg(F.coalesce(beyond(F.col(v), F.col(names[v, q]), above), F.lit(False)).cast("int")) * 100
    ordered = sorted({c for v, q, *_ in [*spells.values(), *peaks.values()] for c in (v, names[v, q])})
    grouped = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.max("known__").alias("known__"), *[share(*x).alias(name) for name, x in exceed.items()], *([runs.in_order("date", *ordered).alias("days__")] if ordered else []),
    )
    run = lambda v, q, above, least: runs.folded_runs(F.col("days__"), lambda d: beyond(d[v], d[names[v, q]], above), least)
    peak = lambda v, q, least: runs.folded_peak(F.col("days__"), lambda d: d[v], lambda d: d[names[v, q]], least)
    return grouped.select(
        *keys, "n_days", *exceed, *[F.when(F.col("known__"), run(*x)).alias(name) for name, x in spells.items()], *[peak(*x).alias(name) for name, x in peaks.items()],
    )


def doy_exceedance(days: DataFrame, unit: list[str], value: str, q: float, baseline: tuple[int, int], above: bool = True, ge: bool = True, window: int = 5) -> DataFrame:
    """TX90p and its relatives: per cent of days at or beyond the threshold of their day of the year. A day without a threshold isn't beyond but counts."""
    return against_thresholds(days, unit, baseline, exceed={"pct_days": (value, q, above)}, ge=ge, window=window).drop("n_days")


def spell_days(days: DataFrame, unit: list[str], value: str, q: float, baseline: tuple[int, int], above: bool = True, least: int = 6, window: int = 5) -> DataFrame:
    """keys, n_days, longest, days_in_runs, events against the threshold of the day of the year: WSDI, CSDI and heatwave measures. Models without a baseline have nulls."""
    out = against_thresholds(days, unit, baseline, spells={"s__": (value, q, above, least)}, window=window)
    return out.select(*unit, "scenario", "year", "n_days", *[F.col(f"s__.{c}").cast("double").alias(c) for c in ("longest", "days_in_runs", "events")])


def heatwave_peaks(days: DataFrame, unit: list[str], value: str, q: float, baseline: tuple[int, int], least: int = 5, window: int = 5) -> DataFrame:
    """keys, amplitude (peak of the hottest spell in °C), magnitude (its mean exceedance); null in years without a spell."""
    out = against_thresholds(days, unit, baseline, peaks={"p__": (value, q, least)}, window=window)
    return out.select(*unit, "scenario", "year", (F.col("p__.peak") - KELVIN).alias("amplitude"), F.col("p__.magnitude").alias("magnitude"))


def heatwave_delta(days: DataFrame, unit: list[str], value: str, baseline: tuple[int, int], plus: float = 5.0, floor: float = 313.15, least: int = 5) -> DataFrame:
    """keys, longest, days_in_runs, events of days at or above max(baseline mean of the day + plus, floor)."""
    limits = thresholds.doy_means(baseline_of(days, unit, *baseline), unit, value, plus=plus, least=floor)
    return runs.run_stats(thresholds.attach(days, limits, unit), [*unit, "scenario", "year"], F.col(value) >= F.col("threshold"), least)


def temperature_ranges(days: DataFrame, keys: list[str], high: str = "tasmax", low: str = "tasmin") -> DataFrame:
    """Mean daily range, and greatest high less lowest low, over days that have both."""
    both = days.where(F.col(high).isNotNull() & F.col(low).isNotNull())
    return both.groupBy(*keys).agg(F.avg(F.col(high) - F.col(low)).alias("daily_range"), (F.max(high) - F.min(low)).alias("extreme_range"))


def rescale_humidity(days: DataFrame, keys: list[str], value: str = "hurs") -> DataFrame:
    """Humidity of a unit-year whose greatest value is at most 1.5 is a fraction and becomes per cent."""
    w = Window.partitionBy(*keys)
    return days.withColumn(value, F.when(F.max(value).over(w) <= 1.5, F.col(value) * 100).otherwise(F.col(value)))


def wet_bulb_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days without Feb 29 with wb, the wet-bulb temperature in °C, and its depression below tas."""
    fit = rescale_humidity(days.where(not_feb29(F.col("date")) & F.col("tas").isNotNull() & F.col("hurs").isNotNull()), keys)
    c = F.col("tas") - KELVIN
    return fit.withColumn("wb", wet_bulb_stull(c, clip(F.col("hurs"), 0.0, 100.0))).withColumn("depression", c - F.col("wb"))


def wet_bulb_indices(days: DataFrame, keys: list[str], hot: float = 30.0, near: float = 3.0) -> DataFrame:
    return wet_bulb_days(days, keys).groupBy(*keys).agg(F.avg("wb").alias("wb_mean"), F.max("wb").alias("wb_max"), count_if(F.col("wb") >= hot).alias("wb_days_ge"), count_if(F.col("depression") <= near).alias("depression_days_le"))


def growing_season_length(days: DataFrame, keys: list[str], value: str = "tas", limit: float = KELVIN + 5, least: int = 6, half_month: int = 7) -> DataFrame:
    """Days from the first run of ``least`` days above the limit to the first such run below it from July on (the end of the year if there is none); 0 without a start."""
    fit = days.where(not_feb29(F.col("date")))
    w = Window.partitionBy(*keys).orderBy("date")
    fit = fit.withColumn("place", F.row_number().over(w) - 1).withColumn("late", F.month("date") >= half_month)
    all_keys = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    start = runs.run_lengths(fit, keys, F.col(value) > limit, "place").where(F.col("length") >= least).groupBy(*keys).agg(F.min("first").alias("start"))
    late = fit.where("late")
    end = runs.run_lengths(late, keys, F.col(value) < limit, "place").where(F.col("length") >= least).groupBy(*keys).agg(F.min("first").alias("end"))
    length = F.when(F.col("start").isNull(), 0).when(F.col("end").isNull(), F.col("n") - F.col("start")).otherwise(F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    return all_keys.join(start, keys, "left").join(end, keys, "left").select(*keys, length.cast("double").alias("gsl"))


def rain_indices(days: DataFrame, keys: list[str], value: str = "pr", wet: float = 1.0, rainy: tuple[float, ...] = (2.5, 20.0)) -> DataFrame:
    """Rainy days, Rx1day, SDII (total over all days by wet days) and PRCPTOT in one pass."""
    v = F.col(value)
    return days.groupBy(*keys).agg(
        *[count_if(v > t).alias(f"rainy_{str(t).replace('.', '_')}") for t in rainy],
        F.max(value).alias("rx1day"),
        F.coalesce(F.sum(v) / F.nullif(F.count_if(v >= wet), F.lit(0)), F.lit(0.0)).alias("sdii"),
        F.coalesce(F.sum(F.when(v >= wet, v)), F.lit(0.0)).alias("prcptot"),
    )


def rx5day(days: DataFrame, keys: list[str], value: str = "pr", limit: float = 50.0, least: int = 1, rows: int = 5) -> DataFrame:
    """Greatest sum of ``rows`` days, and the number of runs of such sums at or above the limit."""
    summed = runs.rolling_sum(days, keys, value, rows, "date", "sum5").where("sum5 is not null")
    year = summed.groupBy(*keys).agg(F.max("sum5").alias("rx5day"), runs.in_order("date", "sum5").alias("days__"))
    return year.select(*keys, "rx5day", runs.folded_runs(F.col("days__"), lambda d: d["sum5"] >= limit, least)["events"].cast("double").alias("rx5day_events"))


def wet_and_dry_runs(days: DataFrame, keys: list[str], value: str = "pr", wet: float = 1.0, dry_least: int = 6) -> DataFrame:
    """Longest wet run, longest dry run, and the number of dry runs of at least dry_least days."""
    year = days.groupBy(*keys).agg(runs.in_order("date", value).alias("days__"))
    run = lambda flag, least: runs.folded_runs(F.col("days__"), flag, least)
    is_wet, is_dry = (lambda d: d[value] >= wet), (lambda d: d[value] < wet)
    return year.select(*keys, run(is_wet, 1)["longest"].cast("double").alias("cwd"), run(is_dry, 1)["longest"].cast("double").alias("cdd"), run(is_dry, dry_least)["events"].cast("double").alias("dry_events"))


def r95p(days: DataFrame, unit: list[str], baseline: tuple[int, int], value: str = "pr", wet: float = 1.0, q: float = 0.95) -> DataFrame:
    """Rain on days at or above the nearest percentile of the baseline's wet days, and its share of all wet-day rain (0 without any); null without a baseline."""
    keys = [*unit, "scenario", "year"]
    limits = baseline_of(days, unit, *baseline).where(F.col(value) >= wet).groupBy(*unit).agg(thresholds.nearest_quantile(value, q).alias("cut__"))
    v = F.col(value)
    fit = days.where(not_feb29(F.col("date"))).join(limits, unit, "left")
    known = F.max("cut__").isNotNull()
    heavy = F.coalesce(F.sum(F.when((v >= wet) & (v >= F.col("cut__")), v)), F.lit(0.0))
    total = F.coalesce(F.sum(F.when(v >= wet, v)), F.lit(0.0))
    return fit.groupBy(*keys).agg(F.when(known, heavy).alias("r95p_total"), F.when(known, F.when(total > 0, heavy / total * 100).otherwise(0.0)).alias("r95p_contribution"))


def spi_simplified(days: DataFrame, unit: list[str], baseline: tuple[int, int], value: str = "pr") -> DataFrame:
    """(total - 365 mean) / (sqrt(365) std) of the baseline's days; 0 where the spread is 0."""
    base = days.where((F.col("scenario") == "historical") & F.col("year").between(*baseline)).groupBy(*unit).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    total = days.groupBy(*unit, "scenario", "year").agg(F.sum(value).alias("t"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("t") - 365 * F.col("m")) / (F.sqrt(F.lit(365.0)) * F.col("s")))
    return total.join(base, unit).select(*unit, "scenario", "year", z.alias("spi"))
