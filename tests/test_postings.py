"""The bounded keyword search against scores of all pairs."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import weights as W
from quarry.lineage import shared_folder
from quarry.operators import postings as P
from quarry.operators import retrieval as R


def index(spark, docs, fields):
    return P.write_index(docs, fields, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def everything(docs, queries, fields, k):
    scored = W.fulltext_search(docs, queries, fields, 0.3).withColumn("score", F.round("score", 6))
    return rows(R.top_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k))


@pytest.fixture(scope="module")
def texts(spark):
    """Two words are in nearly all documents; one document in ten repeats a query's."""
    random.seed(5)
    rare = [f"w{k}" for k in range(400)]
    asked = [(q, ["the", "of", *random.sample(rare, 6)]) for q in range(20)]
    docs = [(d, [w for w in ("the", "of") if random.random() < 0.9] + (asked[d % 20][1] if d % 10 == 0 else random.sample(rare, 5)), random.sample(rare, 1)) for d in range(600)]
    docs += [(900, None, None), (901, [], []), (902, ["the"], ["the"])]
    queries = [*asked, (50, ["absent", "missing"]), (51, []), (52, ["the"]), (53, ["the", "of", "absent", "gone", "lost", "w1", "w2"])]
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>, title array<string>"), spark.createDataFrame(queries, "query_id long, tokens array<string>")


@pytest.mark.parametrize("fields", [{"tokens": 2.0}, {"title": 10.0, "tokens": 2.0}])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_of_all(spark, texts, fields, k):
    docs, queries = texts
    docs = docs.select("doc_id", *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in fields])
    assert rows(P.search_top(index(spark, docs, fields), queries, k)) == everything(docs, queries, fields, k)


def test_common_words_bring_no_candidates(spark, texts):
    docs, queries = texts
    asked, pairs = P.candidates(index(spark, docs, {"tokens": 2.0}), queries.filter("query_id < 20"), 3)
    met = docs.select("doc_id", F.explode("tokens").alias("w")).join(queries.filter("query_id < 20").select("query_id", F.explode("tokens").alias("w")), "w").select("doc_id", "query_id").distinct().count()
    assert pairs.count() * 4 < met  # nearly all documents share "the" with all queries
    assert not [r for r in pairs.join(docs, "doc_id").join(queries.withColumnRenamed("tokens", "q"), "query_id").select(F.array_intersect("tokens", "q").alias("w")).collect() if set(r.w) <= {"the", "of"}]


def test_nothing_to_find(spark, texts):
    docs, queries = texts
    assert P.search_top(index(spark, docs.limit(0), {"tokens": 2.0}), queries, 3).count() == 0
    assert P.search_top(index(spark, docs, {"tokens": 2.0}), queries.limit(0), 3).count() == 0
