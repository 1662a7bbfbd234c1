"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import running_total


def retrieval_metrics(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, precision, recall, f1, hit, mrr) of run (case_id, id, rank) against truth (case_id, id)."""
    truth = truth.select("case_id", "id").distinct()
    sizes = run.groupBy("case_id").agg(F.countDistinct("id").alias("_found"))
    wanted = truth.groupBy("case_id").agg(F.count(F.lit(1)).alias("_wanted"))
    hits = run.join(truth, ["case_id", "id"]).groupBy("case_id").agg(F.countDistinct("id").alias("_hits"), F.min("rank").alias("_first"))
    every = wanted.join(sizes, "case_id", "left").join(hits, "case_id", "left").na.fill(0, ["_found", "_hits"])
    p = F.coalesce(F.col("_hits") / F.nullif("_found", F.lit(0)), F.lit(0.0))
    r = F.col("_hits") / F.col("_wanted")
    return every.select("case_id", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), F.when(F.col("_hits") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def summarize_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.agg(*[F.avg(m).alias(m) for m in metrics])


def ranking_metrics(run: DataFrame, qrels: DataFrame, k_ndcg: int = 10, k_map: int = 5, k_mrr: int = 10) -> DataFrame:
    """(qid, ndcg, map, mrr) of run (qid, docid, rank) and qrels (qid, docid, relevance); queries without hits go."""
    judged = run.join(qrels, ["qid", "docid"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    good = F.col("relevance") > 0
    seen = F.sum(F.when(good, 1).otherwise(0)).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("_seen", seen)
    wanted = qrels.filter("relevance > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("_all"))
    ideal = qrels.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "docid"))).filter(F.col("_r") <= k_ndcg).groupBy("qid").agg(F.sum(F.col("relevance") / F.log2(F.col("_r") + 1)).alias("_ideal"))
    got = judged.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k_ndcg, F.col("relevance") / F.log2(F.col("rank") + 1))).alias("_dcg"),
        F.sum(F.when(good & (F.col("rank") <= k_map), F.col("_seen") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.max(F.when(good & (F.col("rank") <= k_mrr), 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )
    out = got.join(wanted, "qid").join(ideal, "qid")
    return out.select("qid", F.coalesce(F.col("_dcg") / F.nullif("_ideal", F.lit(0.0)), F.lit(0.0)).alias("ndcg"), (F.col("_ap") / F.col("_all")).alias("map"), "mrr")


def answer_metrics(df: DataFrame, col: str) -> DataFrame:
    text = F.btrim(F.coalesce(F.col(col), F.lit("")))
    return df.withColumns({"answer_length": F.length(F.coalesce(F.col(col), F.lit(""))), "has_answer": F.when(text != "", 1).otherwise(0)})


def recommend(summary: DataFrame) -> DataFrame:
    """(issue): what a summary's means fall short of."""
    tests = [("low_precision", F.col("precision") < 0.7), ("low_recall", F.col("recall") < 0.7), ("slow", F.col("execution_time") > 5)]
    issues = F.filter(F.array(*[F.when(c, n) for n, c in tests]), lambda x: x.isNotNull())
    return summary.select(F.explode(issues).alias("issue"))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, minimum and nearest-rank percentiles of each group.

    Values are counted first, then placed by running totals over ranges, so that no task holds a whole group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, [by], [F.col(value)], F.col("_n"), "_to", "_all")
    at = lambda p: F.min(F.when(F.col("_to") >= F.ceil(F.lit(p) * F.col("_all")), F.col(value))).alias(f"p{int(p * 100)}")
    return placed.groupBy(by).agg(F.sum("_n").alias("count"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("avg"), F.min(value).alias("min"), at(0.5), at(0.9), at(0.95))
