"""What the training-data operators share: row marks, ranks and components.

Nothing here brings rows of the input to the driver; loops over rounds bring one row of counts each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import ship
from quarry.lineage import checkpoint, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint that knows how its rows are dealt and sorted, so that joins and groups by the same keys move nothing.
    Adaptive plans hide that; this one query runs without."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return checkpoint(df)
    finally:
        conf.set(key, before)


def ready(spark: SparkSession) -> None:
    """Python workers get this package and, unless the session says otherwise, batches of 2,000 rows and at most 16 MB: rows hold
    whole texts, and Spark's own 10,000 of them take much memory."""
    ship(spark)
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2**24))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas, with the workers made ready."""
    ready(df.sparkSession)
    return df.mapInPandas(function, schema)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


#: Stands for a null id inside Python batches, where a null would turn longs into floats.
NO_ID = -(2**63)


def hide_null(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID).cast("long"))


def show_null(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rank_in(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's place from 0 among the rows of its ``key``, though one key may hold any number of rows.

    Rows are numbered within (key, partition) and shifted by the counts of earlier partitions, so no task gets more
    of a key than one partition held. ``df`` must be checkpointed (its partitions must not change between reads).
    """
    parted = df.withColumn("_part", F.spark_partition_id())
    counts = parted.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = parted.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return (
        placed.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
        .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_part", "_rn", "_key", "_p", "_start")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each end of ``edges`` (a long, b long) the smallest node that it reaches.

    Alternating stars: every node hands its larger neighbours to the smallest one it knows, then its smaller ones.
    Neighbourhoods meet only in partial minima and joins (which may be split where skewed), never as a list; each
    round is checkpointed. Rounds grow with the logarithm of the longest path.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        parts = seen[0] // 100_000 + 1  # few links need few tasks; each holds about so many
        now = now.coalesce(parts)
        both = now.union(now.select("b", "a")).toDF("u", "v").coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = checkpoint(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u"), F.col("m"))).filter("a <> b").coalesce(parts).distinct().coalesce(parts))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(roots)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
