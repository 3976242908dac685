"""Yearly grid files as a data source that plans files: root/scenario/var/model/<year>.parquet.

Each file is a partition. Equalities and lists on scenario, var, model and year
are answered by the listing, so files outside of them are never opened. A file
that can't be read gives no values but one row with its reason.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

KEYS = "scenario string, var string, model string, year int, file string, bytes long, reason string"
VALUES = "time date, lat double, lon double, value double"
ARROW = pa.schema([
    ("scenario", pa.string()), ("var", pa.string()), ("model", pa.string()), ("year", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("reason", pa.string()),
    ("time", pa.date32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64()),
])
BY_LISTING = ("scenario", "var", "model", "year")
ROWS_AT_ONCE = 65_536  # of a part that is copied


class YearlyFile(InputPartition):
    """One file and what its path says of it."""

    def __init__(self, place: tuple, size: int):
        self.place, self.size = place, size


class GridReader(DataSourceReader):
    """Lists the files that the filters leave and reads each in its own task, a row group at a time."""

    def __init__(self, path: str, values: bool):
        self.path, self.values, self.asked = path, values, {}

    def pushFilters(self, filters):
        """Keep what the listing can answer; hand back the rest."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in BY_LISTING:
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.asked[name] = self.asked.get(name, wanted) & wanted
            else:
                yield f

    def _wanted(self, name: str, value) -> bool:
        return name not in self.asked or value in self.asked[name]

    def partitions(self):
        system, root = fs.FileSystem.from_uri(self.path)
        folders = lambda base: sorted(x.base_name for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory)
        found = []
        for scenario in [x for x in folders(root) if self._wanted("scenario", x)]:
            for var in [x for x in folders(f"{root}/{scenario}") if self._wanted("var", x)]:
                for model in [x for x in folders(f"{root}/{scenario}/{var}") if self._wanted("model", x)]:
                    for x in system.get_file_info(fs.FileSelector(f"{root}/{scenario}/{var}/{model}")):
                        year, _, kind = x.base_name.partition(".")
                        if kind == "parquet" and year.isdigit() and self._wanted("year", int(year)):
                            found.append(YearlyFile((scenario, var, model, int(year), x.path), x.size or 0))
        # no file at all is a table without rows
        return sorted(found, key=lambda p: p.place) or [YearlyFile((), 0)]

    def _batch(self, part: YearlyFile, n: int, reason: str | None, columns: list | None = None) -> pa.RecordBatch:
        fixed = [*part.place, part.size, reason]
        head = [pa.array([v] * n, t) for v, t in zip(fixed, ARROW.types)]
        if not self.values:
            return pa.record_batch(head, schema=pa.schema(list(ARROW)[: len(head)]))
        return pa.record_batch(head + (columns or [pa.nulls(n, t) for t in ARROW.types[len(head):]]), schema=ARROW)

    def read(self, part: YearlyFile):
        if not part.place:
            return
        if part.size == 0:
            yield self._batch(part, 1, "zero_size")
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        try:
            file = pq.ParquetFile(system.open_input_file(part.place[4]))
            spelt = canonical(file.schema_arrow.names)
        except (OSError, pa.ArrowException, KeyError) as why:
            yield self._batch(part, 1, "no_such_columns" if isinstance(why, KeyError) else "open_failed")
            return
        if not self.values:
            yield self._batch(part, 1, None)
            return
        for group in range(file.num_row_groups):
            try:
                rows = file.read_row_group(group, columns=list(spelt.values()))
                columns = [rows.column(spelt[c]).cast(t).combine_chunks() for c, t in zip(("time", "lat", "lon", "value"), ARROW.types[-4:])]
            except (OSError, pa.ArrowException):
                yield self._batch(part, 1, f"read_failed in row group {group}")
                continue
            yield self._batch(part, rows.num_rows, None, columns)


def canonical(names: list[str]) -> dict[str, str]:
    """The columns time, lat, lon and value under a file's own spellings."""
    spellings = {"time": ("time", "valid_time", "date"), "lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x"), "value": ("value",)}
    found = {c: next((s for s in tried if s in names), None) for c, tried in spellings.items()}
    missing = [c for c, s in found.items() if s is None]
    if missing:
        raise KeyError(missing[0])
    return found


class GridFiles(DataSource):
    """Format isohyet_grid: options path (a URI or an absolute path) and values (false: one row for each file, opened but not read)."""

    @classmethod
    def name(cls):
        return "isohyet_grid"

    def schema(self):
        return f"{KEYS}, {VALUES}" if self.options.get("values", "true") == "true" else KEYS

    def reader(self, schema):
        return GridReader(self.options["path"], self.options.get("values", "true") == "true")


def _load(spark: SparkSession, path: str, where: Column | None, values: bool) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridFiles)
    rows = spark.read.format("isohyet_grid").option("path", path).option("values", str(values).lower()).load()
    return rows if where is None else rows.where(where)


def scan_grid_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """scenario, var, model, year, file, time, lat, lon, value of all readable parts of the files; NaN becomes null.

    Empty, damaged and foreign files are left out; grid_file_report and
    unreadable tell which they are. A file with one damaged row group gives its
    others. An empty folder gives no rows. Turns on the session's push-down of
    filters into Python sources.
    """
    rows = _load(spark, path, where, True).where("reason IS NULL").drop("reason", "bytes")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def grid_file_report(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """One row for each file: scenario, var, model, year, file, bytes, and the reason why it can't be opened (null where it can). No values are read."""
    return _load(spark, path, where, False)


def unreadable(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """A row for each file, or row group of a file, that a full read finds unreadable, with its reason."""
    return _load(spark, path, where, True).where("reason IS NOT NULL").select(*[f.split()[0] for f in KEYS.split(", ")])


def usable_years(report: DataFrame, variables: list[str]) -> DataFrame:
    """(scenario, model, year) for which every variable has a file that opens."""
    good = report.where(F.col("reason").isNull() & F.col("var").isin(variables))
    return good.groupBy("scenario", "model", "year").agg(F.count_distinct("var").alias("n")).where(F.col("n") == len(variables)).drop("n")


def write_grid_files(rows: DataFrame, path: str, tasks: int | None = None) -> None:
    """scenario, var, model, year, time, lat, lon, value as one file a year, in order of time, lat, lon. Rows of one year are meant to be a file's.

    Months are sorted and written as parts, by as many ``tasks`` as asked for (else
    Spark's number); then each file's parts are copied into it one after the other,
    some thousand rows at a time, so no task holds a year.
    """
    keys, columns = list(BY_LISTING), ["time", "lat", "lon", "value"]
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"

    def write(batches):
        system, root = fs.FileSystem.from_uri(parts)
        held, sink = None, None
        for batch in batches:
            table = pa.table(batch)
            if not len(table):
                continue
            whole = [table.column(k) for k in [*keys, "part"]]
            plain = [c.fill_null("\0" if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else -1) for c in whole]
            changes = reduce(pc.or_, [pc.not_equal(c[1:], c[:-1]) for c in plain])
            starts = [0, *(i + 1 for i in pc.indices_nonzero(changes).to_pylist())]
            for i, j in zip(starts, [*starts[1:], len(table)]):
                if (place := tuple(c[i].as_py() for c in whole)) != held:
                    if sink is not None:
                        sink.close()
                    held = place
                    folder = "/".join([root, *map(str, held[:4])])
                    system.create_dir(folder, recursive=True)
                    sink = pq.ParquetWriter(system.open_output_stream(f"{folder}/{held[4]:02}.parquet"), table.select(columns).schema)
                    yield pa.record_batch([pa.array([v], t) for v, t in zip(held, ARROW.types[:3] + [pa.int32()])], names=keys)
                sink.write_table(table.select(columns).slice(i, j - i))
        if sink is not None:
            sink.close()

    def join(batches):
        system, root = fs.FileSystem.from_uri(path)
        _, source = fs.FileSystem.from_uri(parts)
        done = set()  # a file's parts name it in one task
        for batch in batches:
            for place in zip(*[batch.column(k).to_pylist() for k in keys]):
                if place in done:
                    continue
                done.add(place)
                scenario, var, model, year = place
                folder = f"{root}/{scenario}/{var}/{model}"
                system.create_dir(folder, recursive=True)
                names = sorted(x.path for x in system.get_file_info(fs.FileSelector(f"{source}/{scenario}/{var}/{model}/{year}")))
                with system.open_output_stream(f"{folder}/{year}.parquet") as out, pq.ParquetWriter(out, pq.read_schema(system.open_input_file(names[0]))) as sink:
                    for name in names:
                        for rows_ in pq.ParquetFile(system.open_input_file(name)).iter_batches(ROWS_AT_ONCE):
                            sink.write_batch(rows_)
                yield pa.record_batch([pa.array([1], pa.int64())], names=["n"])

    spark = rows.sparkSession
    monthly = rows.select(*keys, F.coalesce(F.month("time"), F.lit(0)).alias("part"), *columns)
    dealt = monthly.repartition(tasks, *keys, "part") if tasks else monthly.repartition(*keys, "part")
    files = dealt.sortWithinPartitions(*keys, "part", "time", "lat", "lon").mapInArrow(write, "scenario string, var string, model string, year int")
    # few rows, but each is a file to copy: a number of tasks that isn't made smaller
    files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).mapInArrow(join, "n long").agg(F.sum("n")).collect()
    system, root = fs.FileSystem.from_uri(parts)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
