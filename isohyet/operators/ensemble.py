"""Period means, ensembles over models, and summaries by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "std", "median", "p05", "p95", "n_models", "values_per_model")


def ensemble_columns(value: str, prefix: str = "") -> list[Column]:
    """Count, mean, population deviation, median and linear 5th and 95th percentiles; nulls don't count."""
    return [
        F.count(value).alias("n_models"), F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}std"), F.median(value).alias(f"{prefix}median"),
        F.percentile(value, F.lit(0.05)).alias(f"{prefix}p05"), F.percentile(value, F.lit(0.95)).alias(f"{prefix}p95"),
    ]


def period_mean(yearly: DataFrame, periods: DataFrame, unit: list[str], min_years: int = 5, min_share: float = 0.6) -> DataFrame:
    """Mean of the yearly values of each period (scenario, period, first, last; few rows, periods may overlap).

    A period is given if enough of its years are there, counted over all units of
    a slug, model and scenario. years_used counts those of the unit.
    """
    inside = yearly.join(periods, "scenario").where(F.col("year").between(F.col("first"), F.col("last")))
    group = ["slug", "model", "scenario", "period"]
    asked = F.col("last") - F.col("first") + 1
    gate = inside.groupBy(*group).agg(F.count_distinct("year").alias("years"), F.first(asked).alias("asked")).where((F.col("years") >= min_years) & (F.col("years") >= min_share * F.col("asked"))).select(*group)
    return (
        inside.join(gate, group).groupBy(*unit, *group)
        .agg(F.avg("value").alias("value"), F.count("value").cast("int").alias("years_used_count"), F.first(asked).cast("int").alias("years_requested"))
    )


def yearly_ensemble(yearly: DataFrame, unit: list[str]) -> DataFrame:
    return yearly.groupBy("slug", *unit, "scenario", "year").agg(*ensemble_columns("value", "ensemble_"))


def ensemble_stats(periods: DataFrame, unit: list[str]) -> DataFrame:
    """Long master: statistics over models of period values, duplicates of a model averaged first; values_per_model as a map."""
    keys = ["slug", *unit, "scenario", "period"]
    single = periods.groupBy(*keys, "model").agg(F.avg("value").alias("value"))
    return single.groupBy(*keys).agg(
        *ensemble_columns("value"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("model", "value"))))).alias("values_per_model"),
    )


def wide_master(long: DataFrame, unit: list[str], columns: list[tuple[str, str, str]], stats: tuple[str, ...] = STATS, places: int = 6) -> DataFrame:
    """One row per unit with {slug}__{scenario}__{period}__{stat}, values_per_model as JSON rounded to some places.

    The columns are given, so no extra job looks for them; of rows that repeat a
    unit and column the greatest value stays.
    """
    out = []
    for slug, scenario, period in columns:
        hit = (F.col("slug") == slug) & (F.col("scenario") == scenario) & (F.col("period") == period)
        for s in stats:
            value = F.to_json(F.transform_values(s, lambda _, v: F.round(v, places))) if s == "values_per_model" else F.col(s)
            out.append(F.max(F.when(hit, value)).alias(f"{slug}__{scenario}__{period}__{s}"))
    return long.groupBy(*unit).agg(*out)


def unpivot_master(wide: DataFrame, unit: list[str]) -> DataFrame:
    """unit, slug, scenario, period, stat, value of a wide table; both m__scenario__y0-y1__stat and the older m_scenario_y0_y1__stat."""
    values = [c for c in wide.columns if c not in unit and "__" in c and not c.endswith("__values_per_model")]
    long = wide.unpivot(unit, [F.col(f"`{c}`").cast("double").alias(c) for c in values], "column", "value")
    new, old = r"^(.+?)__([^_]+)__(\d{4}-\d{4})__(\w+)$", r"^(.+)_([^_]+)_(\d{4})_(\d{4})__(\w+)$"
    c = F.col("column")
    canonical = c.rlike(new)
    pick = lambda a, b: F.when(canonical, F.regexp_extract(c, new, a)).otherwise(F.regexp_extract(c, old, b))
    period = F.when(canonical, F.regexp_extract(c, new, 3)).otherwise(F.concat_ws("-", F.regexp_extract(c, old, 3), F.regexp_extract(c, old, 4)))
    return long.select(*unit, pick(1, 1).alias("slug"), pick(2, 2).alias("scenario"), period.alias("period"), pick(4, 5).alias("stat"), "value").where("slug <> '' and stat in ('mean', 'std', 'median', 'p05', 'p95')")


def state_model_averages(rows: DataFrame, time: str, unit: list[str]) -> DataFrame:
    """Mean over a state's units by model, and how many units it has (also those without a value)."""
    return rows.groupBy("slug", "state", "scenario", time, "model").agg(F.avg("value").alias("value"), F.count_distinct(F.struct(*unit)).alias("n_units"))


def state_ensemble_stats(averages: DataFrame, time: str) -> DataFrame:
    return averages.groupBy("slug", "state", "scenario", time).agg(*ensemble_columns("value", "ensemble_"), F.max("n_units").alias("n_units"))


def area_weighted_mean(rows: DataFrame, keys: list[str], value: str = "value", area: str = "area") -> DataFrame:
    """Sum of value times area by sum of area, over rows that have both and a positive area."""
    both = rows.where(F.col(value).isNotNull() & (F.col(area) > 0))
    return both.groupBy(*keys).agg((F.sum(F.col(value) * F.col(area)) / F.sum(area)).alias("weighted_mean"))


def fill_missing_band(ensemble: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Bands of an ensemble table, missing ones filled from the table of models (mean of a model's duplicates first)."""
    single = models.groupBy(*keys, "model").agg(F.avg("value").alias("value"))
    own = single.groupBy(*keys).agg(*[c.alias(f"m_{n}") for n, c in zip(("mean", "median", "p05", "p95"), (F.avg("value"), F.median("value"), F.percentile("value", F.lit(0.05)), F.percentile("value", F.lit(0.95))))])
    return ensemble.join(own, keys, "left").select(*keys, *[F.coalesce(F.col(c), F.col(f"m_{c}")).alias(c) for c in ("mean", "median", "p05", "p95")])


def state_summaries(periods: DataFrame, yearly: DataFrame, unit: list[str]) -> dict[str, DataFrame]:
    """The four state tables: model averages and ensembles, of periods and of years. Years that are no numbers are left out."""
    years = yearly.withColumn("year", F.col("year").cast("string").try_cast("int")).where("year is not null")
    by_period, by_year = state_model_averages(periods, "period", unit), state_model_averages(years, "year", unit)
    return {
        "period_models": by_period, "period_ensemble": state_ensemble_stats(by_period, "period"),
        "yearly_models": by_year, "yearly_ensemble": state_ensemble_stats(by_year, "year"),
    }
