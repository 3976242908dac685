"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.sources.io import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share; see isohyet.sources.io.scratch, whose remove_scratch deletes them all."""
    return scratch(spark, what)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: later uses don't run its plan again, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, as one document may be very long. The settings stay: they are read when a plan runs, which is after its operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """schema with fields at its end; columns of the same names (in any case) are left out first."""
    names = {n.lower() for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in fields])


def without(df: DataFrame, *names: str) -> DataFrame:
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def spread(df: DataFrame) -> DataFrame:
    """A plain input for a join, so that adaptive execution may split a hot key of the other side."""
    return df.hint("rebalance")
