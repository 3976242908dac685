"""The yearly table kept up to date: what each partition depends on, and a build of the stale ones alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.plans import registry
from isohyet.sources import stale

KEYS = ["slug", "model", "scenario", "year"]
VARIABLES = ["tasmax", "tasmin", "tas", "hurs", "pr"]
#: Kinds whose years read a baseline of their model's historical scenario; kinds whose years read the year before.
BASED = ("doy_exceedance", "spells", "heatwave_peak", "r95p", "spi")
BEFORE = ("seasonal_mean", "spi")
#: Kinds that read their own variable alone, and the variables of those that read several; any other plan, of users too, counts as reading all there is.
ONE = (*registry.DOY, "seasonal_mean", "growing_season", "rx5day", "r95p", "rain_runs", "spi")
SEVERAL = {"range": ("tasmax", "tasmin"), "wet_bulb": ("tas", "hurs")}


def reads(m: registry.Metric) -> tuple[list[str], bool, bool]:
    """The variables of a metric, whether it reads a baseline, and whether it reads the year before."""
    if m.kind in registry.PLAIN or m.kind in ONE:
        return [m.var], m.kind in BASED, m.kind in BEFORE
    return (list(SEVERAL[m.kind]), False, False) if m.kind in SEVERAL else (VARIABLES, True, True)


def named(slugs: list[str]) -> list[registry.Metric]:
    every = {m.slug: m for m in registry.METRICS} | registry.ADDED
    return [every[s] for s in slugs]


def dependencies(days: DataFrame, unit: list[str], slugs: list[str], baseline: tuple[int, int]) -> DataFrame:
    """KEYS and the digest of all that a metric's year of a model and scenario is made from.

    That is the metric's definition and, by variable, the days of the year, of
    the year before where the metric reads it, and of the model's baseline. Only
    the digests are joined, never days.
    """
    rows = []
    for m in named(slugs):
        variables, based, before = reads(m)
        rows += [(m.slug, v, f"{m.kind} {m.var} {sorted(m.params.items())} {baseline if based else ''}", based, before) for v in variables]
    # a row for each metric and variable: some hundreds at most
    dim = F.broadcast(days.sparkSession.createDataFrame(rows, "slug string, variable string, definition string, based boolean, before boolean"))
    places = [c for c in unit if c != "model"]
    own = stale.written(stale.digests(days, ["model", "scenario", "year"], [*places, "date"], [v for v in VARIABLES if v in days.columns]), "day-digests")
    before = own.select("model", "scenario", (F.col("year") + 1).alias("year"), "variable", F.col("digest").alias("before__"))
    inside = own.where((F.col("scenario") == "historical") & F.col("year").between(*baseline))
    base = inside.groupBy("model", "variable").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col("year").cast("string"), "digest"))), ",").alias("base__"))
    met = own.join(before, ["model", "scenario", "year", "variable"], "left").join(base, ["model", "variable"], "left").join(dim, "variable")
    part = F.concat_ws("|", "variable", "digest", F.when(F.col("before"), F.coalesce("before__", F.lit("-"))), F.when(F.col("based"), F.coalesce("base__", F.lit("-"))))
    return met.groupBy(*KEYS).agg(F.sha2(F.concat_ws("|", F.first("definition"), F.array_join(F.array_sort(F.collect_list(part)), ";")), 256).alias("digest"))


def refresh_yearly(days: DataFrame, unit: list[str], root: str, slugs: list[str], baseline: tuple[int, int] = registry.BASELINE) -> DataFrame:
    """Bring the stored yearly table (slug, unit, scenario, year, value) up to date with days; (KEYS, change) of what was rebuilt or is gone.

    Metrics that are stale for the same reason are built together, from the days of
    their stale years, of the year before these and of the models' baselines.
    """

    def build(keys: DataFrame) -> DataFrame:
        wanted = sorted(r.slug for r in keys.select("slug").distinct().collect())
        years = keys.select("model", "scenario", "year").distinct()
        reach = years.unionByName(years.withColumn("year", (F.col("year") - 1).cast("int"))).distinct()
        based = F.broadcast(keys.select("model").distinct()) if any(reads(m)[1] for m in named(wanted)) else None
        near = days.join(reach, ["model", "scenario", "year"], "left_semi")
        if based is not None:
            inside = (F.col("scenario") == "historical") & F.col("year").between(*baseline)
            # baseline days that aren't there already
            rest = days.where(inside).join(based, "model", "left_semi").join(reach, ["model", "scenario", "year"], "left_anti")
            near = near.unionByName(rest)
        return registry.build(stale.written(near, "stale-days"), unit, wanted, baseline).join(keys, KEYS, "left_semi")

    return stale.refresh(dependencies(days, unit, slugs, baseline), build, root, KEYS)


def read_yearly(spark, root: str, schema) -> DataFrame:
    return stale.read(spark, root, schema, KEYS)
