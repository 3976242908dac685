"""Tables that several writers add to: staged data, made visible by one entry of a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage(rows: DataFrame, root: str, keys: list[str]) -> str:
    """Write rows under a name of their own and return it; nobody sees them until publish()."""
    name = uuid.uuid4().hex
    rows.withColumn("commit", F.lit(name)).repartition(*keys).write.mode("append").partitionBy("commit", *keys).parquet(f"{root}/data")
    return name


def publish(spark: SparkSession, root: str, name: str, keys: list[str]) -> None:
    """The manifest entry of what was staged: its keys, in one file, so that it is there as a whole or not at all."""
    held = spark.read.parquet(f"{root}/data").where(F.col("commit") == name).select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    held.withColumn("commit", F.lit(name)).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def commit(rows: DataFrame, root: str, keys: list[str]) -> None:
    """Add rows for their keys. A writer that dies in between leaves nothing visible and can simply run again; of two that write the same key, one counts."""
    publish(rows.sparkSession, root, stage(rows, root, keys), keys)


def held_keys(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """(keys as text, commit): for each key the commit that counts, the first by name of those that have it. Keys are never null."""
    entries = spark.read.schema(", ".join(f"`{k}` string" for k in [*keys, "commit"])).parquet(f"{root}/manifest")
    return entries.groupBy(*keys).agg(F.min("commit").alias("commit"))


def read_committed(spark: SparkSession, root: str, schema, keys: list[str]) -> DataFrame:
    """The table: rows of the commits that count. Which those are prunes the partitions that are read."""
    kinds = {f.name: f.dataType for f in schema.fields}
    rows = spark.read.schema(schema.add("commit", "string") if "commit" not in kinds else schema).parquet(f"{root}/data")
    counted = held_keys(spark, root, keys).select("commit", *[F.col(k).cast(kinds[k]).alias(k) for k in keys])
    return rows.join(counted, ["commit", *keys]).select(*[f for f in kinds if f != "commit"])


def missing_keys(wanted: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Those of the wanted keys that no commit has yet; all of them where nothing was committed."""
    spark = wanted.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return wanted
    held = held_keys(spark, root, keys).select(*[F.col(k).cast(t).alias(k) for k, t in wanted.dtypes if k in keys])
    return wanted.join(held, keys, "left_anti")
