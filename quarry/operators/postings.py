"""Bounded keyword search: a stored index of postings, and the best k documents of each query without scoring the rest.

An index is a folder of two tables: ``postings`` (term, field, doc_id, files sorted so) and ``terms`` (term, field, df, impact). A
field's impact for a term, boost times log-ratio of rarity, is the same for all its documents, so it is stored once, as
the most that the term can add to a score.

A search takes two passes. The first scores the documents of each query's rarest terms; the k-th best of them is a
score that the final k reach. The second leaves out terms that bring no document in: those whose impacts together stay below that
score, or, if fewer postings remain so, the commonest ones of which a match may not miss all, as it must hold a share of
the query's terms. Documents of the other terms are the candidates, and only they are scored: each pair looks its query's
terms up by (term, document), keys that no common word makes hot, so a pair costs the length of its query, however long
the document. Both bounds lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint
from .retrieval import top_n

#: Scores closer than this are told apart by nothing but the order of sums.
CLOSE = 1e-5

#: Files that a term's postings may be dealt to.
SPREAD = 16

#: Terms of all queries up to which they go to every task; beyond, pairs are dealt by query.
BROADCAST = 500_000


@dataclass(frozen=True)
class KeywordIndex:
    fields: dict[str, float]
    postings: DataFrame
    terms: DataFrame


def open_index(spark: SparkSession, folder: str, fields: dict[str, float]) -> KeywordIndex:
    return KeywordIndex(fields, spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"))


def write_index(docs: DataFrame, fields: dict[str, float], folder: str) -> KeywordIndex:
    """Index of ``docs`` (doc_id, an array of tokens for each of ``fields``, which have boosts) under ``folder``."""
    spark = docs.sparkSession
    n = F.lit(docs.count())
    every = F.concat(*[F.transform(F.array_distinct(F.coalesce(f, F.array())), _in_field(k)) for k, f in enumerate(fields)])
    postings = docs.select(F.explode(every).alias("t"), "doc_id").select("t.term", "t.field", "doc_id")
    # a term's postings lie in up to SPREAD files, so that no task gets all of a common one
    postings.repartition("term", F.pmod("doc_id", F.lit(SPREAD))).sortWithinPartitions("term", "field", "doc_id").write.parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    boost = F.element_at(F.array(*[F.lit(float(b)) for b in fields.values()]), F.col("field") + 1)
    rarity = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (n - 0.5) / F.lit(1.5))
    counts.withColumn("impact", boost * rarity).write.parquet(f"{folder}/terms")
    return open_index(spark, folder, fields)


def _in_field(k: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("term"), F.lit(k).alias("field"))


def _asked(index: KeywordIndex, queries: DataFrame, min_match: float) -> DataFrame:
    """Per query that may match: (query_id, minimum, terms: its terms in the index with df, greatest impact, impact by field)."""
    words = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    sizes = words.groupBy("query_id").agg(F.ceil(min_match * F.count(F.lit(1))).alias("minimum"))
    impacts = [F.coalesce(F.max(F.when(F.col("field") == k, F.col("impact"))), F.lit(0.0)) for k in range(len(index.fields))]
    found = words.join(index.terms, "term").groupBy("query_id", "term").agg(F.sum("df").alias("df"), F.max("impact").alias("top"), F.array(*impacts).alias("impacts"))
    rows = found.groupBy("query_id").agg(F.collect_list(F.struct("df", "top", "term", "impacts")).alias("terms"))  # a query's own length
    return rows.join(sizes, "query_id").filter(F.size("terms") >= F.col("minimum"))


def _prefix(terms: Column, value: str, most: Column) -> Column:
    """How many of ``terms`` hold together less than ``most`` of ``value``, from the first on."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(a: Column, t: Column) -> Column:
        total = a["s"] + t[value].cast("double")
        go = a["go"] & (total < most)
        return F.struct(total.alias("s"), (a["n"] + go.cast("int")).alias("n"), go.alias("go"))

    return F.aggregate(terms, start, step, lambda a: a["n"])


def _total(terms: Column, value: str) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t[value])


def _pairs(index: KeywordIndex, asked: DataFrame, terms: str) -> DataFrame:
    """(query_id, doc_id) of the documents of a query's ``terms``."""
    wanted = asked.select("query_id", F.explode(terms).alias("t")).select("query_id", F.col("t.term").alias("term"))
    return wanted.join(index.postings.select("term", "doc_id"), "term").select("query_id", "doc_id").distinct()


def score_pairs(index: KeywordIndex, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of pairs that hold the minimum of terms: the best field's sum of impacts."""
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    looked = pairs.join(F.broadcast(asked) if n_terms <= BROADCAST else asked, "query_id").select("query_id", "doc_id", "minimum", F.explode("terms").alias("t"))
    looked = looked.select("query_id", "doc_id", "minimum", F.col("t.term").alias("term"), F.col("t.impacts").alias("impacts"))
    held = looked.join(index.postings, ["term", "doc_id"])
    sums = [F.sum(F.when(F.col("field") == k, F.get("impacts", F.lit(k))).otherwise(0.0)) for k in range(len(index.fields))]
    found = F.count(F.lit(1)) if len(sums) == 1 else F.size(F.collect_set("term"))
    scored = held.groupBy("query_id", "doc_id", "minimum").agg(found.alias("found"), (F.greatest(*sums) if len(sums) > 1 else sums[0]).alias("score"))
    return scored.filter("found >= minimum").select("query_id", "doc_id", "score")


def candidates(index: KeywordIndex, queries: DataFrame, k: int, min_match: float = 0.3, seed: int = 64) -> tuple[DataFrame, DataFrame]:
    """(asked, pairs): all pairs that may be among the best ``k`` of a query. The first pass reads 4 k + ``seed`` postings of a
    query's rarest terms; the rarest one is read whole."""
    asked = checkpoint(_asked(index, queries, min_match))
    by_df = F.array_sort("terms")
    first = asked.withColumn("_t", by_df).withColumn("_t", F.slice("_t", 1, F.greatest(F.lit(1), _prefix(F.col("_t"), "df", F.lit(float(4 * k + seed))))))
    tried = score_pairs(index, asked, _pairs(index, first, "_t"))
    least = top_n(tried, ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k).select("query_id", (F.col("score") - CLOSE).alias("_least"))
    both = asked.join(least, "query_id", "left").select("*", by_df.alias("_rare"), F.array_sort(F.transform("terms", lambda t: F.struct(t["top"].alias("top"), t["df"].alias("df"), t["term"].alias("term")))).alias("_weak"))
    by_score = F.slice("_weak", 1 + _prefix(F.col("_weak"), "top", F.coalesce("_least", F.lit(0.0))), F.size("_weak"))
    by_count = F.slice("_rare", 1, F.greatest(F.lit(0), F.size("_rare") - F.col("minimum").cast("int") + 1))
    both = both.withColumn("_a", F.transform(by_score, lambda t: F.struct(t["df"].alias("df"), t["term"].alias("term")))).withColumn("_b", F.transform(by_count, lambda t: F.struct(t["df"].alias("df"), t["term"].alias("term"))))
    both = both.withColumn("_t", F.when(_total(F.col("_a"), "df") <= _total(F.col("_b"), "df"), F.col("_a")).otherwise(F.col("_b")))
    return asked, _pairs(index, both, "_t")


def search_top(index: KeywordIndex, queries: DataFrame, k: int, min_match: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents of each query (query_id, tokens), scores to six places, ties to the
    smaller id."""
    asked, pairs = candidates(index, queries, k, min_match)
    scored = score_pairs(index, asked, pairs).withColumn("score", F.round("score", 6))
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
