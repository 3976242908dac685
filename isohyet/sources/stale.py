"""Rebuilding of what is stale: a manifest of content digests, and only those partitions written whose inputs changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators.order_stats import written


def digests(rows: DataFrame, keys: list[str], ids: list[str], values: list[str]) -> DataFrame:
    """keys, variable, digest: for each of the values, of the rows of each key whatever their order; all in one pass.

    A digest is the number of rows and two sums of 64-bit hashes of ids and value,
    so partial sums are made before anything is shuffled. Rows should come
    from a stored table: values computed anew may differ in their last bits.
    """
    of = lambda seed, v: F.sum(F.xxhash64(F.lit(seed), *ids, F.col(v).isNull(), F.col(v)).cast("decimal(38,0)"))
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"), *[F.concat_ws(":", of(1, v), of(2, v)).alias(v) for v in values])
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.concat_ws(":", F.col("n__").cast("string"), v).alias("digest")) for v in values]))
    return made.select(*keys, each)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The manifests that are there as a whole, oldest first."""
    folder, system = _folder(spark, f"{root}/manifest")
    if not system.exists(folder):
        return []
    named = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in named if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, root: str, schema) -> DataFrame:
    """keys, digest and the version whose rows count, for every key of the table; no rows where there is no table yet."""
    held = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/manifest/version={held[-1]}") if held else spark.createDataFrame([], schema)


def changes(now: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: new, changed or gone. Keys that stand as they are aren't there."""
    met = now.withColumnRenamed("digest", "now__").join(held.select(*keys, F.col("digest").alias("held__")), keys, "full")
    change = F.when(F.col("held__").isNull(), "new").when(F.col("now__").isNull(), "gone").when(F.col("now__") != F.col("held__"), "changed")
    return met.select(*keys, change.alias("change")).where("change IS NOT NULL")


def refresh(now: DataFrame, build: Callable[[DataFrame], DataFrame], root: str, keys: list[str]) -> DataFrame:
    """Bring the table under root up to date; (keys, change) of what was new, changed or gone.

    ``now`` has the digest of what each key depends on (keys are never null);
    build(stale) makes the rows of the stale keys, given as a table of keys. They
    are written as partitions of a new version, and the manifest that names the
    version of each key comes last. A run that dies before that has changed
    nothing that anyone reads, and the next one writes over what it left. A key
    whose new rows are none has none. One writer at a time (commits.py is for several).
    """
    spark = now.sparkSession
    now = written(now.select(*keys, "digest"), "digests")
    schema = now.withColumn("version", F.lit(0)).schema
    held = manifest(spark, root, schema)
    found = written(changes(now, held, keys), "stale")
    if found.isEmpty():
        return found
    version = (versions(spark, root) or [0])[-1] + 1
    stale = found.where("change <> 'gone'").drop("change")
    if not stale.isEmpty():
        build(stale).withColumn("version", F.lit(version)).repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(f"{root}/data/version={version}")
    old = held.join(found.select(*keys), keys, "left_anti").select(*keys, "digest", "version")
    new = now.join(stale, keys, "left_semi").withColumn("version", F.lit(version))
    old.unionByName(new).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return found


def read(spark: SparkSession, root: str, schema, keys: list[str]) -> DataFrame:
    """The table under its schema: of each key the rows of the version in the manifest. That prunes the partitions that are read."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    columns = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    counted = manifest(spark, root, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", digest string, version int")
    if not versions(spark, root):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{columns}, version int").parquet(f"{root}/data")
    return rows.join(counted.drop("digest"), [*keys, "version"], "left_semi").select(*kinds)


def remove_old(spark: SparkSession, root: str) -> int:
    """Delete versions that no key of the present manifest reads, and older manifests, once no reader has them open; how many folders there were."""
    held = versions(spark, root)
    if not held:
        return 0
    used = {r.version for r in spark.read.parquet(f"{root}/manifest/version={held[-1]}").select("version").distinct().collect()}
    n = 0
    for kind, keep in (("data", used), ("manifest", {held[-1]})):
        for v in held:
            folder, system = _folder(spark, f"{root}/{kind}/version={v}")
            n += v not in keep and system.exists(folder) and system.delete(folder, True)
    return n
