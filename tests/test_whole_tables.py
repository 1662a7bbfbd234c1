"""Queries that take whole tables, on small tables of their own against brute force."""

from collections import defaultdict
from hashlib import md5

from quarry.jobs import QUERIES


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def reachable(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(near):
        if start in found:
            continue
        todo = [start]
        while todo:
            if (x := todo.pop()) not in found:
                found[x] = start
                todo += near[x]
    return found


def test_components_of_all_orders(spark, tmp_path):
    orders = [(o, o) for o in range(1, 300)]
    lines = [(o, 1 + o // 2) for o in range(1, 300)]
    put(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long")
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long")
    got = {r["name"]: r["component"] for r in QUERIES["g13_components"](spark, str(tmp_path)).collect()}
    assert len(got) == 449 and got == reachable((f"C{o}", f"P{p}") for o, p in lines)


def test_edges_of_weight_one_count(spark, tmp_path):
    lines = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 8), (3, 9)]
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long")
    put(spark, tmp_path, "part", [(k, "b", f"n{k}", "t") for _, k in lines], "p_partkey long, p_brand string, p_name string, p_type string")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["name"] for r in run("g13_largest_component")} == {"P1", "P2", "P3"}
    assert {r["name"] for r in run("g14_communities")} == {"P1", "P2", "P3", "P8", "P9"}
    want = {"P1-P2", "P2-P1", "P2-P3", "P3-P2", "P8-P9", "P9-P8", "P1-P2-P3", "P3-P2-P1"}
    assert sorted(r["path"] for r in run("g19_n_hop_paths_all")) == sorted(want)


def test_lists_of_all_orders(spark, tmp_path):
    lines = [(o, k, 100 * o + k, float(-k), 0.1 * k) for o in (1, 2, 3) for k in (1, 2, 3)]
    put(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_tax double")
    got = sorted((r["doc_id"], r["rank"], r["id"]) for r in QUERIES["r13_chunk_lists"](spark, str(tmp_path)).collect())
    assert got == [(o, rank, 4 - rank) for o in (1, 2, 3) for rank in (1, 2, 3)]


def test_texts_of_every_script(spark, tmp_path):
    put(spark, tmp_path, "benchmark", [(1, "größe"), (2, "中国"), (3, "plain"), (4, "人,the x")], "item_id long, text string")
    put(spark, tmp_path, "conversations", [("a", 0, "1 < 2"), ("a", 1, "x")], "conv_id string, turn int, text string")
    assert {r["item_id"]: r["q"] for r in QUERIES["t5_strip_question_words"](spark, str(tmp_path)).collect()} == {1: " ", 2: " 中国 ", 3: "plain", 4: "人,the x"}
    assert {r["turn"]: r["text"] for r in QUERIES["t17_chat_markup"](spark, str(tmp_path)).collect()} == {0: "@bob in #general see docs @here @U2 1 < 2", 1: "@bob in #general see docs @here @U2 x"}


def test_citations_of_all_turns(spark):
    from quarry.operators.retrieval import repair_citations

    answers = spark.createDataFrame([(1, "a (ID: 2) b 【ID:9】 ref 1, [ID:2]"), (2, "none"), (3, None)], "answer_id long, text string")
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (2, 1, 10)], "answer_id long, index int, doc_id long")
    out, facets = repair_citations(answers, hits, hits.drop("index").withColumn("count", hits.doc_id))
    got = {r.answer_id: (r.text, r.cited) for r in out.collect()}
    assert got[1] == ("a [ID:2] b 【ID:9】 [ID:1], [ID:2]", [2, 1]) and got[2] == ("none", [])
    assert sorted((r.answer_id, r.doc_id) for r in facets.collect()) == [(1, 10), (1, 20)]


def test_running_totals_of_one_large_group(spark):
    from pyspark.sql import functions as F

    from quarry.functions.running import running_total

    df = spark.range(2000).select(F.when(F.col("id") % 5 < 4, "hot").when(F.col("id") % 10 == 4, "b").alias("g"), "id", (F.col("id") % 7).alias("v"))
    rows = running_total(df, ["g"], [F.col("id").desc()], F.col("v"), "upto", "all").collect()
    for g in ("hot", "b", None):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: -r.id)
        total = 0
        for r in mine:
            total += r.v
            assert r.upto == total
        assert {r["all"] for r in mine} == {total}
    assert len(rows) == 2000


def test_highlight_of_every_script(spark, tmp_path):
    from quarry.functions import text as X

    rows = ["First one. Second has a KEY here, key key. Keyed no.", "我爱中国人。他在中国; 没有 KEY", "no match\nhere", "größenschlüssel über Schlüssel äöüß", "", None, "c++ is it. no"]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, text string")
    got = [r[0] for r in df.orderBy("n").select(X.highlight_any(df.text, ["key", "中国", "中国人", "schlüssel", "c++"])).collect()]
    assert got == ["Second has a <em>KEY</em> here, <em>key</em> key", "我爱<em><em>中国</em>人</em>。他在<em>中国</em>...没有 <em>key</em>", "no match here", "größen<em>schlüssel</em> über <em>schlüssel</em> äöüß", "", "", "<em>c++</em> is it"]
    put(spark, tmp_path, "documents", [(1, "中国的TION人"), (2, "Straße")], "doc_id long, text string")
    assert {r["doc_id"]: r["h"] for r in QUERIES["t13_highlight"](spark, str(tmp_path)).collect()} == {1: md5("中国的<em>tion</em>人".encode()).hexdigest(), 2: md5("Straße".encode()).hexdigest()}


def test_every_vector_asks_for_messages(spark, tmp_path):
    """Conversation 2 begins at turn 1 and 3 has no turn at all, yet their vectors ask."""
    put(spark, tmp_path, "conversations", [(1, 0, "user", "alpha beta"), (2, 1, "user", "gamma"), (4, 0, "user", "delta")], "conv_id long, turn long, role string, text string")
    put(spark, tmp_path, "embeddings", [(k, [1.0, 0.1 * k]) for k in range(1, 5)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.id) for r in QUERIES["m3_search_messages"](spark, str(tmp_path)).collect()}
    assert got == {(q * 1000, d) for q in range(1, 5) for d in (1000, 4000)}


def similar_texts(spark, folder):
    """More documents than any window share a word with the query, most of them one word in four."""
    words = ["quartz", "amber", "cobalt", "indigo"]
    docs = [(d, words[d % 4] + " other" if d % 5 else " ".join(words)) for d in range(1, 101)] + [(200, "nothing here"), (201, None)]
    put(spark, folder, "documents", docs, "doc_id long, text string")
    put(spark, folder, "benchmark", [(2, "quartz amber cobalt indigo"), (3, "absent")], "item_id long, text string")
    put(spark, folder, "embeddings", [(k, [1.0, 0.5]) for k in (2, 3, 7)], "vec_id long, embedding array<float>")
    return {(2, d): len(words) if d % 5 == 0 else 1 for d in range(1, 101)}


def test_token_similarity_of_all_pairs(spark, tmp_path):
    want = similar_texts(spark, tmp_path)
    got = {(r.query_id, r.doc_id): r.tksim for r in QUERIES["w3_token_similarity"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all((got[k] > 0.99) == (n == 4) for k, n in want.items())


def test_hybrid_similarity_of_all_pairs(spark, tmp_path):
    want = similar_texts(spark, tmp_path)
    got = {(r.query_id, r.doc_id): r.sim for r in QUERIES["w5_hybrid_similarity"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and got[2, 7] > 0.7 and got[2, 9] < 0.1 and abs(got[2, 10] - 0.3) < 1e-3
