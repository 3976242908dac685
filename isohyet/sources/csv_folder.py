"""A folder of CSV files of different headers, each read under its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that name a row and never hold its value. Fixed values.
NAMING = ("state", "district", "block", "model", "scenario", "year", "source_file")


def fields(line: Column) -> Column:
    """The fields of a CSV line, quotes taken off and doubled ones undone; a field holds no line break."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(found, lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) >= 2), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def scan_headed(spark: SparkSession, path: str) -> DataFrame:
    """file, header (array), fields (map by the file's own header) of every line below a header.

    A file's first line is its header; files are split into ranges as any text,
    and every line finds its header by the file it is from. Of columns of one name
    the first counts; empty fields and missing ones are null; empty lines and
    files without any line below the header give nothing.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("turn"))
    first = lines.where("begin = 0").groupBy("file").agg(F.min_by("value", "turn").alias("head"), F.min("turn").alias("head_turn"))
    header = first.select("file", "head_turn", F.transform(fields(F.regexp_replace("head", "^﻿", "")), lambda h: F.trim(h)).alias("header"))
    below = lines.where(F.trim("value") != "").join(header, "file").where((F.col("begin") > 0) | (F.col("turn") > F.col("head_turn")))
    below = below.select("file", "header", fields(F.col("value")).alias("given"))
    places = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_position("header", x["h"]) == x["i"] + 1)
    entry = lambda x: F.struct(x["h"].alias("key"), F.nullif(F.trim(F.get("given", x["i"])), F.lit("")).alias("value"))
    return below.select("file", "header", F.map_from_entries(F.transform(places, entry)).alias("fields"))


def with_value(rows: DataFrame, prefer: str = "value", naming: tuple[str, ...] = NAMING) -> DataFrame:
    """rows of scan_headed with value_column and value: the file's column of the preferred name if any of its fields is a number, else its first other column of which one is; files without such a column go."""
    number = lambda h: F.col("fields")[h].try_cast("double").isNotNull()
    usable = rows.select("file", "header", F.filter("header", number).alias("some")).groupBy("file", "header").agg(F.array_distinct(F.flatten(F.collect_set("some"))).alias("some"))
    others = F.filter("header", lambda h: F.array_contains("some", h) & ~h.isin(prefer, *naming))
    chosen = usable.select("file", F.when(F.array_contains("some", F.lit(prefer)), F.lit(prefer)).otherwise(F.get(others, 0)).alias("value_column"))
    met = rows.join(chosen.where("value_column is not null"), "file")
    return met.withColumn("value", F.col("fields")[F.col("value_column")].try_cast("double"))


def yearly_series(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """names (text, null where a file hasn't got the column), year, value of a folder's yearly series; rows without a year or a value go."""
    rows = with_value(scan_headed(spark, path))
    named = rows.select(*[F.col("fields")[n].alias(n) for n in names], F.col("fields")["year"].try_cast("double").cast("int").alias("year"), "value")
    return named.where("year is not null and value is not null and not isnan(value)")
