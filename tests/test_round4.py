"""Findings of the fourth round, each on small tables of its own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.jobs import ORACLES, QUERIES


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def same_as_sql(spark, folder, name):
    """Rows of the query, which are those of its SQL."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    rows = QUERIES[name](spark, str(folder)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in rows) == want
    return rows


def test_initials_of_every_letter(spark, tmp_path):
    """letters whose upper case Python writes as two."""
    letters = [*"aßñŉǆΐᾳﬁ中1", "", None, "𐐨x", "ßa"]
    put(spark, tmp_path, "documents", list(enumerate(letters)), "doc_id long, text string")
    got = {r.doc_id: r.initial for r in same_as_sql(spark, tmp_path, "u4_extract_field")}
    assert got[1] == "ẞ" and got[0] == "A" and got[11] is None


def test_context_of_a_large_community(spark, tmp_path):
    """F8: more relations than ten thousand inside one community."""
    put(spark, tmp_path, "part", [(k, "b" if k < 151 else "c", f"n{k}", "t") for k in range(153)], "p_partkey long, p_brand string, p_name string, p_type string")
    put(spark, tmp_path, "lineitem", [(1, k) for k in range(153)], "l_orderkey long, l_partkey long")
    rows = same_as_sql(spark, tmp_path, "g15_community_context")
    assert sum(r.kind == "relation" for r in rows) == 151 * 150 // 2 + 1


def test_pagerank_of_groups(spark):
    """as the graph of pairs has it, with repeated members, groups of one and members that are no nodes."""
    from quarry.operators import graph as G

    rows = [(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "c"), (2, "d"), (3, "e"), (4, "a"), (4, "x"), (5, None), (None, "a"), (6, "f"), (6, "f")]
    members = spark.createDataFrame(rows, "group long, name string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "name string")
    pairs = [(p, q, 1.0) for i, (g, p) in enumerate(rows) for h, q in rows[:i] if g == h and g and p and q and p != q]
    edges = spark.createDataFrame([(min(p, q), max(p, q), w) for p, q, w in pairs], "src string, dst string, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    for how in ({"tolerance": 0.0, "rounds": 4}, {}):
        want = {r.name: r.pagerank for r in G.pagerank(nodes, edges, **how).collect()}
        assert {r.name: r.pagerank for r in G.group_pagerank(nodes, members, **how).collect()} == pytest.approx(want)
    assert G.group_pagerank(nodes.limit(0), members).count() == 0


def test_rounds_leave_one_table(spark):
    """shuffle files go with their statement, and a loop keeps its last table alone."""
    import os

    from quarry import CLEAN
    from quarry.lineage import Rounds, shared_folder

    assert spark.conf.get(CLEAN) == "true"
    folder = shared_folder(spark).removeprefix("file:")
    before, last = set(os.listdir(folder)), Rounds()
    now = last.put(spark.range(10))
    for _ in range(3):
        now = last.put(now.select(F.col("id") + 1))
        now = now.toDF("id")
    assert len(set(os.listdir(folder)) - before) == 1 and now.agg(F.min("id")).first()[0] == 3


def test_largest_component_on_ties(spark, tmp_path):
    """F16: links to the group's smallest part; of two as large the first by name, P10 before P2."""
    from quarry.operators import graph as G

    put(spark, tmp_path, "part", [(k, "b", f"n{k}", "t") for k in (2, 3, 10, 11, 50)], "p_partkey long, p_brand string, p_name string, p_type string")
    put(spark, tmp_path, "lineitem", [(1, 2), (1, 3), (2, 10), (2, 11), (3, 50)], "l_orderkey long, l_partkey long")
    assert {r.name for r in same_as_sql(spark, tmp_path, "g13_largest_component")} == {"P10", "P11"}
    clique = spark.createDataFrame([(1, k) for k in range(50)], "group long, name long")
    assert G.group_links(clique).count() == 49


def test_many_queries_hold_few_vectors(spark):
    """no vector is copied for each query; equal vectors go by id though their sums differ by rounding."""
    import numpy as np

    from quarry.operators.retrieval import vector_topk

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    made = [(k, (base[k % 40] * (1 + k)).tolist()) for k in range(600)]
    frame = spark.createDataFrame(made, "id long, vec array<double>")
    got = vector_topk(frame, frame.withColumnRenamed("id", "query_id"), 7, 0.1, block=64, pivots=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    best = {}
    for r in got.collect():
        best.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert all(list(dict(sorted(best[q].items())).values()) == [q % 40 + 40 * i for i in range(7)] for q in range(600))


def test_sums_of_blocks(spark, monkeypatch):
    """pairs are summed where documents lie, over several blocks of queries, and no pair is dealt out by key."""
    import random

    from quarry.functions import scores

    monkeypatch.setattr(scores, "QUERIES", 7)
    rng = random.Random(4)
    docs = {d: [set(rng.sample(range(60), rng.randint(0, 9))) for _ in range(2)] for d in range(80)} | {None: [{1, 2}, {2}]}
    asked = {q: {k: [rng.random(), rng.random()] for k in rng.sample(range(60), rng.randint(1, 8))} for q in range(30)}
    rows = [(d, [*a, *b], [1] * len(a) + [2] * len(b), [float(d or 0), 1.0] if d != 3 else None) for d, (a, b) in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, keys array<long>, in_fields array<int>, vec array<double>")
    weights = spark.createDataFrame([(q, k, *w) for q, ks in asked.items() for k, w in ks.items()], "query_id long, key long, w0 double, w1 double")
    sizes = spark.createDataFrame([(q, 1 + q % 2, [1.0, 0.0]) for q in asked], "query_id long, least long, vec array<double>")
    out = scores.shared_sums(frame, weights, sizes, 2)
    got = {(r.query_id, r.doc_id): r for r in out.collect()}
    want = {(q, d): ks.keys() & (a | b) for q, ks in asked.items() for d, (a, b) in docs.items() if len(ks.keys() & (a | b)) >= 1 + q % 2}
    assert got.keys() == want.keys() and len(got) > 300
    for (q, d), keys in want.items():
        r = got[q, d]
        assert r.found == len(keys) and r.cosine == pytest.approx(0.0 if d == 3 else (d or 0) / ((d or 0) ** 2 + 1) ** 0.5)
        for k, s in enumerate((r.s0, r.s1)):
            held = [asked[q][x][k] for x in keys & docs[d][k]]
            assert s == pytest.approx(sum(held)) if held else s is None or s != s
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan


def test_records_are_parsed_once(spark, tmp_path):
    """types, descriptions and sources come from one reading; brackets as before."""
    from quarry.operators import graph as G

    part = [(1, "b1", "n", "t1"), (2, "b2", "n", "t2")]
    put(spark, tmp_path, "part", part, "p_partkey long, p_brand string, p_name string, p_type string")
    put(spark, tmp_path, "lineitem", [(o, 1 + o % 2, o % 3, "AN"[o % 2]) for o in range(20)], "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")
    assert len(same_as_sql(spark, tmp_path, "g2_merge_entities")) == 2
    texts = ['("entity"<|>"a (b)"<|>"t"<|>"d")##x("Entity"<|>c<|>t<|>)e)y##)no(##("entity"<|>z<|>t)', None, "none", '("entity"<|>A (B)<|>u<|>d)##("entity"<|>A (B)<|>u<|>e)']
    found, _ = G.parse_extractions(spark.createDataFrame(list(enumerate(texts)), "chunk_key int, text string"))
    assert sorted((r.name, r.type, r.description) for r in found.collect()) == [("A (B)", "T", "d"), ("A (B)", "U", "d"), ("A (B)", "U", "e"), ("C", "T", ")e")]
    merged = G.merge_entities(found)
    assert {r.name: (r.type, r.description, r.source_id) for r in merged.collect()} == {"A (B)": ("U", "d<SEP>e", [0, 3]), "C": ("T", ")e", [0])}
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(split") == 1


def test_best_relations_of_queries(spark):
    """direct and path relations by hand, the same relation twice, and edges dealt once."""
    from quarry.operators import graph as G

    entities = spark.createDataFrame([(1, "a", "T", 2.0, 1.0), (1, "b", "U", 1.0, 1.0), (2, "a", "U", 4.0, 1.0)], "query_id long, name string, type string, sim double, pagerank double")
    types = spark.createDataFrame([(1, "T")], "query_id long, type string")
    relations = spark.createDataFrame([(1, "a", "b", 0.5), (1, "a", "b", 0.25), (1, "x", "y", None), (2, "m", "n", 1.0)], "query_id long, src string, dst string, sim double")
    paths = spark.createDataFrame([(1, "a", ["a", "b", "c"]), (2, "a", ["b", "a"]), (2, "z", ["z", "y"])], "query_id long, name string, names array<string>")
    got = G.graph_retrieve(entities, types, relations, paths)[1]
    rows = sorted((r.query_id, r["rank"], r.src, r.dst, round(r.score, 9)) for r in got.collect())
    # a counts twice as much, 4 / 2 on its first step and 4 / 3 on the next; it is an end of a wanted type
    assert rows == [(1, 1, "a", "b", 0.5 * 4), (1, 2, "b", "c", round(4 / 3, 9)), (1, 3, "a", "b", 0.25 * 4), (1, 4, "x", "y", 0.0), (2, 1, "a", "b", 2.0), (2, 2, "m", "n", 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 0 and plan.count("rank(") + plan.count("Exchange hashpartitioning(query_id") <= 6


def test_changes_leave_no_steps(spark, tmp_path):
    """what a batch writes between its steps goes with it, and the chunks are the same."""
    import os

    from quarry.lineage import shared_folder
    from quarry.streaming import jobs as L

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    index = L.DocumentIndex(spark, str(tmp_path))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, title string, version int, deleted boolean")
    index.apply(docs([(k, f"text {k}", "t", 1, False) for k in range(9)]), ("a", 0))
    index.apply(docs([(1, None, "t", 2, False), (2, "new", "t", 2, False), (3, "", "t", 2, True), (4, "text 4", "t", 2, False)]), ("a", 1))
    assert {r.doc_id: r.text.strip() for r in index.chunks.read().collect() if r.text.strip()} == {k: f"text {k}" for k in (0, 4, 5, 6, 7, 8)} | {2: "new"}
    assert {x for x in os.listdir(folder) if x not in before} <= {x for x in os.listdir(folder) if x.startswith("rdd-")}


def test_candidates_in_blocks(spark):
    """small blocks give the pairs of one block and of all pairs by hand; a pair of two types comes once."""
    import random

    from quarry.operators import graph as G

    rng = random.Random(2)
    names = {"".join(rng.choice("abc1é") for _ in range(rng.randint(1, 6))) for _ in range(120)} | {"abc", "abd"}
    nodes = [(x, t) for x in names for t in ("s", "t") if rng.random() < 0.7 or x in ("abc", "abd")]
    new = {x for x in names if rng.random() < 0.3} | {"abc"}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        pieces = lambda w: {w[i : i + 2] for i in range(max(len(w) - 1, 1))}
        if any("1" in g for g in pieces(a) ^ pieces(b)):
            return False
        if (a + b).isascii():
            return edits(a, b) <= min(len(a), len(b)) // 2
        shared, most = len(set(a) & set(b)), max(len(set(a)), len(set(b)))
        return shared > 1 if most < 4 else shared / most >= 0.8

    want = sorted({(a, b) for a, t in nodes for b, u in nodes if t == u and a < b and (a in new or b in new) and alike(a, b)})
    frame = spark.createDataFrame(nodes, "name string, type string")
    for block in (5, 2048):
        got = G.entity_candidates(frame, spark.createDataFrame([(x,) for x in new], "name string"), block)
        assert sorted((r.a, r.b) for r in got.collect()) == want and ("abc", "abd") in want


def test_paths_share_an_exchange(spark):
    """both edges of a path meet at their common end, from one deal of the edges; three edges by hand."""
    from quarry.operators import graph as G

    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]
    frame = spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    walks = {1: [(x, y) for a, b in edges for x, y in ((a, b), (b, a))]}
    for n in (2, 3):
        walks[n] = [(*w, z) for w in walks[n - 1] for y, z in walks[1] if y == w[-1] and {y, z} not in [{w[i], w[i + 1]} for i in range(n - 1)]]
    for n in (1, 2, 3):
        got = sorted(tuple(r.names) for r in G.n_hop_paths(frame, n).collect())
        assert got == sorted(w for k in range(1, n + 1) for w in walks[k])
    # each join has the edges themselves on both sides, with nothing made before it
    plan = G.n_hop_paths(frame, 2)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :]
    assert "array(" not in below
