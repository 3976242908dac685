"""FeatureCollection files read by byte ranges, one task for each, and their columns under canonical names."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)
WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a piece: all of a feature, its end, its beginning, neither

# Spellings of the columns of boundary files, in the order in which they are tried.
BLOCK_COLUMNS = {
    "block_name": ("block_name", "Sub_dist", "SUBDISTRICT", "BLOCK", "TEHSIL", "MANDAL", "TALUK"),
    "district_name": ("district_name", "District", "DISTRICT"),
    "state_name": ("state_name", "STATE_UT", "STATE_LGD"),
}
DISTRICT_COLUMNS = {"district_name": ("district_name", "DISTRICT"), "state_name": ("state_name", "STATE_UT", "STATE_LGD")}


def _outside(record: str, inside: bool) -> tuple[str, bool]:
    """(the record with blanks for all that stands in strings, whether its end is in a string)."""
    parts = ESCAPED.sub("..", record).split('"')
    kept = [part if (i % 2 == 1) == inside else " " * len(part) for i, part in enumerate(parts)]
    return " ".join(kept), inside ^ (len(parts) % 2 == 0)


def _net(record: str, inside: bool) -> int:
    text = _outside(record, inside)[0]
    return text.count("{") - text.count("}")


def pieces(records: Iterable[str], inside: bool, depth: int) -> Iterable[tuple[int, str]]:
    """(kind, text) of the features in one range: records end with their closing bracket, inside and depth say where the range begins.

    A feature is an object in the collection's object: its brackets open the
    second level. As a record has one closing bracket, its last character, a
    feature ends where a record ends.
    """
    held, kind = ([], HEAD) if depth >= 2 else (None, WHOLE)
    for record in records:
        text, inside = _outside(record, inside)
        opening = -1
        if held is None:
            opening = text.find("{")
            if depth == 0 and opening >= 0:
                opening = text.find("{", opening + 1)
        depth += text.count("{") - text.count("}")
        if held is not None:
            held.append(record)
        elif opening >= 0:
            held, kind = [record[opening:]], WHOLE
        if held is not None and depth == 1 and text.endswith("}"):
            yield kind, "".join(held)
            held = None
    if held is not None:
        yield (MIDDLE if kind == HEAD else TAIL), "".join(held)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """file, place (bytes range and number in it), id, geometry (text), properties (map) of every Feature in FeatureCollection files, in one line or many.

    Text is read in records that end with a closing bracket, so a range of a file
    (spark.sql.files.maxPartitionBytes) is a task and nothing holds a whole line.
    A first look counts quotes and brackets of each range, for both cases of what
    may be open at its beginning; running sums over a file's ranges, a row each,
    say which it is. Features then come out of each range by itself, and those
    that a range cuts are joined from their pieces. What isn't a Feature is left out.
    """
    lines = spark.read.text(path, lineSep="}").select(F.concat("value", F.lit("}")).alias("record"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))

    def by_range(batches, columns):
        """(file, begin, the other columns' first values, records) of each range in turn."""
        at, held, first = None, [], ()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "record", *columns))):
                if row[:2] != at:
                    if at is not None:
                        yield (*at, first, held)
                    at, held, first = row[:2], [], row[3:]
                held.append(row[2])
        if at is not None:
            yield (*at, first, held)

    def look(batches):
        for file, begin, _, records in by_range(batches, ()):
            odd, nets = False, [0, 0]
            for record in records:
                for inside in (False, True):
                    nets[inside] += _net(record, odd ^ inside)
                odd = _outside(record, odd)[1]
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin]), pa.array([int(odd)], pa.int32()), pa.array([nets[0]]), pa.array([nets[1]])], names=["file", "begin", "odd", "closed", "open"])

    ranges = lines.mapInArrow(look, "file string, begin long, odd int, closed long, open long")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False)))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("open")).otherwise(F.col("closed"))).over(before), F.lit(0)))
    # a row for each range of the files: sent to their tasks, which keeps records in their places
    known = lines.join(F.broadcast(ranges.select("file", "begin", "inside", "depth")), ["file", "begin"])

    def cut(batches):
        for file, begin, (inside, depth), records in by_range(batches, ("inside", "depth")):
            found = list(pieces(records, inside, depth))
            if found:
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([begin] * n), pa.array(range(n), pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found])], names=["file", "begin", "seq", "kind", "text"])

    made = known.mapInArrow(cut, "file string, begin long, seq int, kind int, text string")
    so_far = Window.partitionBy("file").orderBy("begin", "seq").rowsBetween(Window.unboundedPreceding, 0)
    broken = made.where(F.col("kind") != WHOLE).withColumn("owner", F.last(F.when(F.col("kind") == TAIL, F.struct("begin", "seq")), ignorenulls=True).over(so_far))
    joined = broken.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "seq", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = made.where(F.col("kind") == WHOLE).select("file", F.struct("begin", "seq").alias("place"), "text").unionByName(joined.select("file", F.col("owner").alias("place"), "text"))
    parsed = whole.withColumn("f", F.from_json("text", "type string, id string, geometry string, properties map<string,string>"))
    return parsed.where("f.type = 'Feature'").select("file", "place", "f.id", "f.geometry", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"))


def canonical_columns(features: DataFrame, names: dict[str, tuple[str, ...]], first_text: str, optional: dict[str, str] | None = None) -> DataFrame:
    """features with a column for each of names: the first of its spellings that the file has, without blanks around it, else 'Unknown'.

    ``first_text`` falls back to the file's first property of text (one that is no
    number), then to the feature's place. ``optional`` columns (name -> spelling)
    are null where the file doesn't have them. Which spelling a file has is asked
    of all its features.
    """
    number = lambda v: v.try_cast("double").isNotNull() | v.isin("true", "false")
    texts = F.map_keys(F.map_filter("properties", lambda _, v: v.isNotNull() & ~number(v)))
    files = features.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties")))).alias("held__"), F.min_by(F.get(texts, 0), F.when(F.size(texts) > 0, F.col("place"))).alias("text__"))
    spelt = lambda spellings: F.get(F.filter(F.array(*[F.lit(s) for s in spellings]), lambda s: F.array_contains("held__", s)), 0)
    value = lambda key: F.trim(F.element_at("properties", key))
    place = F.concat_ws("-", F.col("place.begin").cast("string"), F.col("place.seq").cast("string"))

    def column(name: str, spellings: tuple[str, ...]) -> Column:
        other = F.when(F.col("text__").isNotNull(), value(F.col("text__"))).otherwise(place) if name == first_text else F.lit("Unknown")
        return F.when(spelt(spellings).isNotNull(), value(spelt(spellings))).otherwise(other).alias(name)

    more = [F.when(F.array_contains("held__", F.lit(s)), value(F.lit(s))).alias(n) for n, s in (optional or {}).items()]
    return features.join(files, "file").select(*features.columns, *[column(n, s) for n, s in names.items()], *more)


def district_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return canonical_columns(scan_features(spark, path), DISTRICT_COLUMNS, "district_name")


def block_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return canonical_columns(scan_features(spark, path), BLOCK_COLUMNS, "block_name", {"block_type": "Subdis_Typ", "block_lgd_code": "Subdis_LGD"})
