"""Hand-made cases and invariants for what SQL doesn't check."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import aggregates as A
from quarry.operators import chunking as C
from quarry.operators import communities as M
from quarry.operators import graph as G
from quarry.operators import records as P
from quarry.operators import retrieval as R
from quarry.operators import sync as I
from quarry.sources import documents as S


@pytest.mark.parametrize(("mode", "n"), [("token_size", 1), ("delimiter", 2), ("one", 1)])
def test_token_chunk(spark, mode, n):
    df = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    assert C.token_chunk(df, mode, 100).count() == n


def test_text_functions(spark):
    row = spark.range(1).select(
        X.highlight(F.lit("First one. Second has keyword here. No."), ["keyword"]).alias("h"), X.remove_redundant_spaces(F.lit("( a , b !)")).alias("s"), X.is_garbled(F.lit("ok (cid:1)")).alias("g"),
        F.concat_ws("|", X.strip_question_words(F.lit("什么")), X.strip_question_words(F.lit("What IS love")), X.strip_question_words(F.lit("请问谁在家吗"))).alias("q"), X.clean_str(F.lit('&lt;a&gt; "b"\u0001')).alias("c"), X.parse_tag_features(F.lit("not a dict")).alias("t"),
    ).first()
    assert row.h == "Second has <em>keyword</em> here" and row.s == "(a , b!)" and row.g and row.q == "什么| love|在家" and row.c == "<a> b" and row.t == {}


def test_spaces_between_scripts(spark):
    texts = ["2024年", "ABC123中文", "中文ABC", "A中B中2", "第3章", "x1中y"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "n int, x string").orderBy("n").select(X.space_latin_cjk(F.col("x"))).collect()]
    assert got == ["2024年", "ABC123 中文", "中文 ABC", "A 中 B 中2", "第3章", "x1 中 y"]


def test_meta_filter_reseeds(spark):
    meta = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, key string, value string")
    rules = [("a", "=", "none"), ("b", "is", "y")]
    assert A.meta_filter(meta, rules).count() == 0
    assert [r.doc_id for r in A.meta_filter(meta, rules, reseed_empty=True).collect()] == [2]
    assert A.normalize_conditions([("k", "!=", "1")]) == [("k", "≠", "1")]


def test_rank_features(spark):
    df = spark.createDataFrame([(1, {"apple": 2.0}, 0.0), (2, {}, 3.0)], "id long, tags map<string,double>, pr double").withColumn("q", F.create_map(F.lit("apple"), F.lit(1.0)))
    assert [r.s for r in df.select("id", R.rank_feature_scores(df, "tags", "q", "pr").alias("s")).orderBy("id").collect()] == [10.0, 3.0]
    assert R.normalize_weights({"a": 0, "b": 0}) == {"a": 0.5, "b": 0.5} and R.candidate_window(10) == 70


def test_feedback(spark):
    chunks = spark.createDataFrame([("a", 99.5), ("b", 0.5), ("c", None)], "chunk_id string, weight double")
    rows = [(k, k, True, "a", 0.9) for k in range(3)] + [(k, k, True, "b", 0.1) for k in range(3)] + [(9, 9, False, "b", None), (10, 10, False, "b", None), (11, 11, True, "b", None)]
    events = spark.createDataFrame(rows, "event_id long, n long, positive boolean, chunk_id string, score double").withColumn("at", F.timestamp_seconds(F.col("n") * 3000))
    got = {r.chunk_id: r.weight for r in I.apply_feedback(chunks, events).collect()}
    assert got == {"a": 100.0, "b": 1.0, "c": 0.0}


def test_pagerank_and_paths(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    got = {r.name: r.pagerank for r in G.pagerank(nodes, edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and got["b"] > got["a"] == got["c"] > got["d"]
    assert {tuple(r.names) for r in G.n_hop_paths(edges).collect()} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "b", "c"), ("c", "b", "a")}


def test_components_of_a_path(spark):
    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {(r.name, r.component) for r in G.components(edges).collect()} == {(k, 0) for k in range(61)}


def test_communities_cover_and_scale(spark):
    rows = [(f"a{i}", f"a{j}", 2.0) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 2.0) for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = M.communities(edges, G.degrees(edges)).filter("level = 0").collect()
    assert {r.name for r in got} == {f"{c}{i}" for c in "ab" for i in range(5)} and max(r.weight for r in got) == 1.0
    assert len({r.community for r in got if r.name[0] == "a"}) == 1


def test_empty_and_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.merge_by_tokens(none).count() == 0 and C.heading_family(none).count() == 0
    with pytest.raises(ValueError):
        S.read_delimited(none.select(F.col("text").alias("value")), "a;a", ";")
    df = spark.createDataFrame([("x", 4.0)], "a string, b double")
    row = P.assign(df, [("b", "/=", F.lit(0))]).first()
    assert row.b == 4.0 and row._error == "division by zero: b"


def test_write_and_sql(spark, tmp_path):
    S.write_table(spark.range(3).toDF("x"), str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 3
    out = S.run_sql(spark, {"v": spark.range(5)}, "select id, cast(id as decimal(5,1)) d, double('nan') n from v; select 1 one", 3)
    assert [d.count() for d in out] == [3, 1] and dict(out[0].dtypes)["d"] == "double" and out[0].first().n is None
