"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The counts of rows that go from each partition to each shard are drawn first: rows of a partition are a simple random
sample without replacement of what the shards still take. Each partition then deals its rows, in random order, by its
row of the matrix; each shard puts what came in random order again. Every assignment of rows to slots is as likely.

Defined results: a null text has size 16 and the checksum of no bytes, a text of any length counts whole; repeated rows
go their own ways, and which of them comes first is open, as they are alike; an empty table gives no rows. All columns
of ``rows`` are carried along, but any named shard or slot give way to ours; the query passes id, size and checksum only,
never the texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

#: numpy draws hypergeometric counts of fewer rows than this; more are dealt in strata, each of exact equal shares.
STRATUM = 500_000_000


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """[partition, shard] counts; column sums differ by one at most, row sums are ``rows``."""
    draw = np.random.default_rng(seed)
    out, left, room = [], np.zeros(shards, dtype=np.int64), 0
    total, dealt = sum(rows), 0
    for n in rows:
        got = np.zeros(shards, dtype=np.int64)
        while n:
            if not room:  # a new stratum: shares go on where the last left off, so that totals stay even
                room = min(STRATUM, total - dealt)
                ends = dealt + room
                left = (ends + np.arange(shards)[::-1]) // shards - (dealt + np.arange(shards)[::-1]) // shards
            take = min(n, room)
            part = draw.multivariate_hypergeometric(left, take)
            got, left, room, n, dealt = got + part, left - part, room - take, n - take, dealt + take
        out.append(got)
    return np.array(out, dtype=np.int64).reshape(len(rows), shards)


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int, seed: int = 42, block: int = 100_000) -> DataFrame:
    """``rows`` (small columns only) with shard and slot. ``keys`` feed the random order; ``block``: rows a task orders."""
    base = checkpoint(rows.withColumn("_r", F.xxhash64(F.lit(seed), *keys))).withColumn("_part", F.spark_partition_id())
    counts = {r["_part"]: r["n"] for r in base.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    ends = rows.sparkSession.createDataFrame([(p, m.cumsum().tolist()) for p, m in zip(parts, matrix, strict=True)], "_p int, _ends array<long>")
    order = Window.partitionBy("_part").orderBy("_r", *keys)
    dealt = (
        base.withColumn("_k", F.row_number().over(order) - 1)
        .join(ends, F.col("_part") == F.col("_p"))
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_k"))))
        .drop("_part", "_k", "_p", "_ends")
    )
    buckets = max(1, sum(counts.values()) // (shards * block))
    second = F.xxhash64(F.lit(seed + 1), "_r", *keys)
    dealt = dealt.withColumn("_s", second).withColumn("_b", F.pmod("_s", F.lit(buckets)))
    sizes = dealt.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("_t"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_s", *keys)))
    return (
        placed.join(starts, (F.col("shard") == F.col("_t")) & (F.col("_b") == F.col("_c")))
        .withColumn("slot", (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_r", "_s", "_b", "_rn", "_t", "_c", "_start")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the law ``rows``; grown_shard is null under that law."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    out = shuffle_into_shards(docs, ["doc_id", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
