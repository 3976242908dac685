"""Names of places, periods and columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ", "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def fold_latin(name: Column) -> Column:
    """Latin letters without accents, in the JVM."""
    return F.translate(name, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def fold_full(names: pd.Series) -> pd.Series:
    """NFKD to ASCII, for names beyond Latin accents."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def normalize_name(name: Column, fold=fold_latin) -> Column:
    """ASCII, lower case; _ and - as spaces; other marks gone; single spaces."""
    spaced = F.regexp_replace(F.lower(fold(name)), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]", ""), " +", " "))


def normalize_compact(name: Column) -> Column:
    return F.replace(normalize_name(name), F.lit(" "), F.lit(""))


def alias_name(name: Column, aliases: dict[str, str]) -> Column:
    """The canonical spelling of a normalised name."""
    plain = normalize_name(name)
    if not aliases:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[plain], plain)


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold_latin(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_period(text: Column) -> Column:
    """YYYY, anything, YYYY as YYYY-YYYY; other texts as they are."""
    rx = r"^\s*(\d{4})\D+(\d{4})\s*$"
    return F.when(text.rlike(rx), F.concat_ws("-", F.regexp_extract(text, rx, 1), F.regexp_extract(text, rx, 2))).otherwise(text)


def split_unit_key(key: Column, unknown: str = "Unknown") -> tuple[Column, Column]:
    """(district, block) of district||block; a key without a separator is a block of an unknown district."""
    parts = F.split(key, r"\|\|")
    many = F.size(parts) > 1
    return F.when(many, parts[0]).otherwise(F.lit(unknown)), F.when(many, parts[1]).otherwise(key)


def unit_label(state: Column, district: Column, block: Column | None = None) -> Column:
    return F.concat_ws(", ", *([block] if block is not None else []), district, state)


def parse_coordinates(line: Column) -> list[Column]:
    """lat, lon and label of "lat, lon[, label]" or "lat lon"; null coordinates where the text or the bounds (6..38, 68..98) don't fit."""
    clean = F.trim(F.regexp_replace(line, "[\"']", ""))
    parts = F.when(clean.contains(","), F.transform(F.split(clean, ","), lambda x: F.trim(x))).otherwise(F.split(clean, r"\s+"))
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    good = lat.between(6, 38) & lon.between(68, 98)
    label = F.when(clean.contains(","), F.get(parts, F.lit(2)))
    return [F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"), F.when(good, F.nullif(label, F.lit(""))).alias("label")]
