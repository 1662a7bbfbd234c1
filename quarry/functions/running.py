"""Running totals of groups of any size, in two levels: within ranges of a group, then over the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import checkpoint


def running_total(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of the same ``by`` up to this one in ``order`` (which must tell
    rows apart, else those alike share ranges in any order), and the group's ``total``. Rows are dealt by ranges of (by,
    order), so that no task gets a whole group; only a sum for each range and group is brought together."""
    dealt = df.withColumn("_v", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt = checkpoint(dealt)
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_v").alias("_s"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), before.alias("_start"), F.sum("_s").over(group).alias("_total"))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = F.sum("_v").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_inside", inside).join(starts, same).withColumn(out, F.col("_start") + F.col("_inside"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_v", "_range", "_r", "_start", "_total", "_inside", *[f"_by{k}" for k in range(len(by))])
