"""Queries over facets, metadata and tags (A rows and the metadata filter P16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import Tables, query


def meta(t: Tables) -> DataFrame:
    """Languages, sources and sizes of documents as metadata."""
    d = t.documents.select("doc_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("size"), F.col("n_chars").cast("string"))).alias("key", "value"))
    return d.withColumn("is_list", F.col("key") == "source")


_META = """WITH meta AS (SELECT doc_id, 'lang' AS key, lang AS value, false AS is_list FROM documents UNION ALL SELECT doc_id, 'source', source, true FROM documents UNION ALL SELECT doc_id, 'size', CAST(n_chars AS VARCHAR), false FROM documents)"""


@query("a1_terms_agg", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def terms_agg(t: Tables) -> DataFrame:
    return A.terms_agg(t.events.withColumn("event_type", F.array(F.concat(F.lit(" "), "event_type"), F.lit(" "))), "event_type")


@query("a2_usage_stats", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS pv, count(DISTINCT user_id) AS uv, round(sum(value), 4) AS tokens, round(avg(value), 6) AS round, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS thumbs
FROM events JOIN (SELECT c_custkey AS user_id FROM customer WHERE c_nationkey < 20) USING (user_id) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1""")
def usage_stats(t: Tables) -> DataFrame:
    usage = t.events.select("ts", "user_id", F.col("value").alias("tokens"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("thumb_up"), F.lit(None).cast("string").alias("source"))
    return A.usage_stats(usage, t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("user_id")), "2024-01-05", "2024-01-20", None)


@query("a3_status_pivot", "SELECT c_nationkey, sum((o_orderstatus = 'F')::INT) AS F, sum((o_orderstatus = 'O')::INT) AS O, sum((o_orderstatus = 'P')::INT) AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def status_pivot(t: Tables) -> DataFrame:
    return A.status_pivot(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey", "o_orderstatus", ["F", "O", "P"])


@query("a4_conditional_counts", """
SELECT o_orderpriority, sum((o_orderstatus = 'F')::INT) AS finished, sum((o_orderstatus = 'O')::INT) AS processing, sum((o_totalprice > 200000)::INT) AS large FROM orders GROUP BY 1""")
def conditional_counts(t: Tables) -> DataFrame:
    return A.conditional_counts(t.orders, "o_orderpriority", {"finished": F.col("o_orderstatus") == "F", "processing": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 200000})


@query("a5_doc_facets", _META + """, m AS (SELECT * FROM meta WHERE doc_id % 3 <> 0)
SELECT 'suffix' AS facet, '' AS key, lang AS value, count(*) AS count FROM documents GROUP BY lang UNION ALL SELECT 'run', '', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'metadata', key, value, count(*) FROM m GROUP BY key, value UNION ALL SELECT 'empty_metadata', '', '', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)""")
def doc_facets(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("lang").alias("suffix"), F.col("source").alias("run"))
    return A.doc_facets(docs, meta(t).filter("doc_id % 3 <> 0"))


@query("a6_doc_counts", "SELECT source AS kb_id, count(*) AS docs, coalesce(sum(n_chars), 0) AS size FROM documents GROUP BY 1")
def doc_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("kb_id")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"))


@query("a7_metadata_summary", _META + " SELECT key, value, count(*) AS count, CASE key WHEN 'size' THEN 'number' WHEN 'source' THEN 'list' ELSE 'string' END AS type FROM meta GROUP BY 1, 2")
def metadata_summary(t: Tables) -> DataFrame:
    return A.metadata_summary(meta(t))


@query("a8_invert_metadata", _META + " SELECT DISTINCT key, value, doc_id FROM meta")
def invert_metadata(t: Tables) -> DataFrame:
    return A.invert_metadata(meta(t))


@query("a9_infer_types", """
SELECT c_custkey AS custkey, round(try_cast(c_acctbal AS DOUBLE), 2) AS balance, CASE WHEN c_nationkey % 2 = 0 THEN true ELSE false END AS even, c_name AS name FROM customer""")
def infer_types(t: Tables) -> DataFrame:
    df = t.customer.select(F.col("c_custkey").cast("string").alias("custkey"), F.format_string("%.2f", "c_acctbal").alias("balance"), F.when(F.col("c_nationkey") % 2 == 0, "yes").otherwise("no").alias("even"), F.col("c_name").alias("name"))
    return A.convert_types(df, A.infer_types(df, df.columns))


_TAGS = """WITH s AS (SELECT l_orderkey, l_linenumber, unnest([l_returnflag, l_linestatus, 'q' || CAST(l_quantity AS INT) % 7]) AS tag FROM lineitem),
c AS (SELECT tag, count(*) AS count FROM s GROUP BY 1), p AS (SELECT tag, count, (count + 1) / ((SELECT sum(count) FROM c) + 1000) AS share FROM c)"""


def tag_samples(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", F.array("l_returnflag", "l_linestatus", F.concat(F.lit("q"), (F.col("l_quantity").cast("int") % 7).cast("string"))).alias("tags"))


@query("a10_tag_portions", _TAGS + " SELECT tag, count, round(share, 9) AS share FROM p")
def tag_portions(t: Tables) -> DataFrame:
    return A.tag_portions(tag_samples(t)).withColumn("share", F.round("share", 9))


_TAG_SCORES = _TAGS + """,
m AS (SELECT l_orderkey AS k, tag, count(*) AS c FROM s GROUP BY 1, 2), h AS (SELECT k, sum(c) AS cnt FROM m GROUP BY 1),
r AS (SELECT k, tag, round_even(0.1 * (c + 1) / (cnt + 1000) / greatest(1e-6, {share}), 0)::BIGINT AS score FROM m JOIN h USING (k) JOIN p USING (tag)),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, tag) <= 3)"""
#: Shares of tags in a far larger set of samples, so that scores are above 0.
RARE = 5000


def rare_portions(t: Tables) -> DataFrame:
    return A.tag_portions(tag_samples(t)).withColumn("share", F.col("share") / RARE)


@query("a11_tag_chunks", _TAG_SCORES.format(share=f"share / {RARE}") + " SELECT k AS chunk_id, tag, score FROM b WHERE score > 0")
def tag_chunks(t: Tables) -> DataFrame:
    return A.tag_chunks(tag_samples(t).withColumnRenamed("l_orderkey", "chunk_id"), rare_portions(t))


@query("a11_tag_queries", _TAG_SCORES.format(share="share") + " SELECT k AS query_id, tag, greatest(score, 1) AS score FROM b")
def tag_queries(t: Tables) -> DataFrame:
    return A.tag_queries(tag_samples(t).withColumnRenamed("l_orderkey", "query_id"), A.tag_portions(tag_samples(t)))


@query("a12_merge_metadata", """
SELECT l_orderkey AS doc_id, 'flags' AS key, array_to_string(list(l_returnflag ORDER BY n, l_returnflag), ',') AS values FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT l_orderkey, 'last', arg_max(l_shipmode, (l_linenumber, l_shipmode)) FROM (SELECT l_orderkey, l_linenumber, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def merge_metadata(t: Tables) -> DataFrame:
    base = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_no"), "l_returnflag", "l_linestatus")
    m = base.select("doc_id", "chunk_no", F.lit("flags").alias("key"), F.col("l_returnflag").alias("value"), F.lit(True).alias("is_list")).union(base.select("doc_id", "chunk_no", F.lit("last"), "l_linestatus", F.lit(False)))
    return A.merge_metadata(m).select("doc_id", "key", F.array_join("values", ",").alias("values"))


@query("a13_update_metadata", """
SELECT doc_id, 'lang' AS key, CASE WHEN doc_id % 2 = 0 AND lang = 'en' THEN 'english' ELSE lang END AS values FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, 'size', CAST(n_chars AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ',big' ELSE '' END FROM documents UNION ALL SELECT doc_id, 'new', 'x' FROM documents WHERE doc_id % 2 = 0""")
def update_metadata(t: Tables) -> DataFrame:
    m = meta(t).select("doc_id", "key", F.array("value").alias("values"))
    out = A.update_metadata(m, t.documents.filter("doc_id % 2 = 0"), {"new": "x"}, {"size": "big"}, [("lang", "en", "english")], ["source"], [("lang", "nothing")])
    return out.select("doc_id", "key", F.array_join("values", ",").alias("values"))


@query("a14_graph_preview", """
WITH n AS (SELECT p_partkey AS name, p_retailprice AS pagerank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 256),
e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)
SELECT src, dst, weight FROM e WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n) ORDER BY weight DESC, src, dst LIMIT 128""")
def graph_preview(t: Tables) -> DataFrame:
    a, b = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("src")), t.lineitem.select("l_orderkey", F.col("l_partkey").alias("dst"))
    edges = a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return A.graph_preview(t.part.select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("pagerank")), edges).select("src", "dst", "weight")


@query("a15_list_documents", """
SELECT o_orderkey AS id, o_orderpriority AS name, c_name AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE contains(lower(o_orderpriority), 'h') AND o_orderstatus IN ('F', 'O') AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 20""")
def list_documents(t: Tables) -> DataFrame:
    docs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("owner_id"))
    return A.list_documents(docs, t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner")), "H", ["F", "O"], "1993-01-01", "1996-01-01", 20, 40).select("id", "name", "owner")


@query("a16_rename_remove_tags", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'eng' WHEN lang = 'fr' THEN '' ELSE lang END AS tags FROM documents")
def rename_remove_tags(t: Tables) -> DataFrame:
    df = A.remove_tags(A.rename_tag(t.documents.select("doc_id", F.array("lang", F.lit("old")).alias("tags")), "tags", "en", "eng"), "tags", ["old", "fr"])
    return df.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("p16_meta_filter_and", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500 AND NOT contains(source, '9')")
def meta_filter_and(t: Tables) -> DataFrame:
    return A.meta_filter(meta(t), [("lang", "in", "EN, de"), ("size", ">", "500"), ("source", "not contains", "9")])


@query("p17_normalize_conditions", "SELECT doc_id FROM documents WHERE lang <> 'fr' AND n_chars >= 500 AND n_chars <= 5000 AND source <> 'src1'")
def normalize_conditions(t: Tables) -> DataFrame:
    return A.meta_filter(meta(t), A.normalize_conditions([("lang", "not is", "FR"), ("size", ">=", "500"), ("size", " <= ", "5000"), ("source", "!=", "src1")]))


@query("p16_meta_filter_or", "SELECT doc_id FROM documents WHERE lang = 'fr' OR n_chars <= 300 OR starts_with(source, 'src1')")
def meta_filter_or(t: Tables) -> DataFrame:
    return A.meta_filter(meta(t), [("lang", "is", "FR"), ("size", "<=", "300"), ("source", "start with", "src1")], "or")
