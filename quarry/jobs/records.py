"""Queries over sources and record transforms (S and P rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..operators import records as R
from ..registry import Tables, query
from ..sources import documents as S
from ..sources.keyed import KeyedTable


@query("s1_rows_to_documents", """
SELECT 'db:shop:' || c_custkey AS id, replace(coalesce(c_name, ''), chr(10), ' ')[1:100] AS semantic_identifier,
  concat_ws(chr(10) || chr(10), '【c_name】:' || chr(10) || c_name, '【c_mktsegment】:' || chr(10) || c_mktsegment) AS text, CAST(c_nationkey AS VARCHAR) AS nation
FROM customer""")
def rows_to_documents(t: Tables) -> DataFrame:
    out = S.rows_to_documents(t.customer, ["c_name", "c_mktsegment"], ["c_nationkey"], "c_custkey", None, "db", "shop")
    return out.select("id", "semantic_identifier", "text", F.col("metadata")["c_nationkey"].alias("nation"))


@query("s2_files_to_documents", """
WITH f AS (SELECT url AS path, length(html) AS size, split_part(url, '/', -1) AS base FROM pages WHERE NOT ends_with(url, '/') AND length(html) <= 3000)
SELECT path AS id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN replace(CASE WHEN starts_with(path, 'https://') THEN path[9:] ELSE path END, '/', ' / ') ELSE base END AS name, size FROM f""")
def files_to_documents(t: Tables) -> DataFrame:
    return S.files_to_documents(t.pages.select(F.col("url").alias("path"), F.length("html").cast("long").alias("size")), "https://", 3000)


@query("s3_feed_entries", """
SELECT md5(coalesce(nullif(url, ''), 'x')) AS id, 'Page ' || page_id AS semantic_identifier,
  'Page ' || page_id || chr(10) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'one' || chr(10) || chr(10) || 'two' ELSE 'short' END AS text FROM pages""")
def feed_entries(t: Tables) -> DataFrame:
    even = F.col("page_id") % 2 == 0
    entries = t.pages.select(
        F.lit("").alias("id"), F.col("url").alias("link"), F.concat(F.lit("Page "), "page_id").alias("title"), F.when(even, F.array(F.lit("one"), F.lit("two"))).alias("content"),
        F.lit("short").alias("summary"), F.lit("").alias("author"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("updated"),
    )
    return S.feed_entries_to_documents(entries).select("id", "semantic_identifier", "text")


_LINES = "CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey || ';bad' ELSE o_orderkey || ';' || o_custkey || ';' || o_orderstatus END"


@query("s4_read_delimited", "SELECT CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0")
def read_delimited(t: Tables) -> DataFrame:
    return S.read_delimited(t.orders.select(F.expr(_LINES).alias("value")), "id;cust;status", ";")[0]


@query("s4_rejects", "SELECT o_orderkey || ';bad' AS value FROM orders WHERE o_orderkey % 10 = 0")
def rejects(t: Tables) -> DataFrame:
    return S.read_delimited(t.orders.select(F.expr(_LINES).alias("value")), "id;cust;status", ";")[1]


@query("s5_rows_to_chunks", "SELECT s_suppkey, concat_ws(chr(10), '- s_name: ' || s_name, '- s_nationkey: ' || s_nationkey) AS chunk FROM supplier")
def rows_to_chunks(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", S.rows_to_chunks(t.supplier, ["s_name", "s_nationkey"]).alias("chunk"))


@query("s6_explode_passages", """
SELECT o_orderkey AS query, l_comment AS passage, rel FROM (
  SELECT o_orderkey, unnest(['p' || o_custkey, 's' || o_orderstatus]) AS l_comment, unnest([1, 0]) AS rel FROM orders)""")
def explode_passages(t: Tables) -> DataFrame:
    df = t.orders.select(F.col("o_orderkey").alias("query"), F.array(F.lit(1), F.lit(0)).alias("flags"), F.array(F.concat(F.lit("p"), "o_custkey"), F.concat(F.lit("s"), "o_orderstatus")).alias("texts"))
    return S.explode_passages(df, "query", "flags", "texts")


@query("s7_join_qrels", """
SELECT b.item_id AS qid, b.text AS query, d.doc_id AS docid, length(d.text) AS n, l.quality AS relevance
FROM labels l JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = l.doc_id % 40""")
def join_qrels(t: Tables) -> DataFrame:
    qrels = t.labels.select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("docid"), F.col("quality").alias("relevance"))
    out = S.join_qrels(qrels, t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), t.documents.select(F.col("doc_id").alias("docid"), "text"))
    return out.select("qid", "query", "docid", F.length("text").alias("n"), "relevance")


@query("s8_concat_tables", "SELECT n_name AS name, n_regionkey AS region, NULL AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def concat_tables(t: Tables) -> DataFrame:
    return S.concat_tables([t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("s9_join_tables", """
SELECT coalesce(a.k, b.k) AS k, a.customers, b.suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_tables(t: Tables) -> DataFrame:
    return S.join_tables([t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")), t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))], "k")


@query("s10_run_sql", "SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 1024")
def run_sql(t: Tables) -> DataFrame:
    return S.run_sql(t.spark, {"lineitem_v": t.lineitem}, "SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem_v GROUP BY 1 ORDER BY 1")[0]


@query("s11_upsert", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang || '!' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM documents""")
def upsert(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", "lang", F.lit(1).alias("version"))
    new = t.documents.filter("doc_id % 7 = 0").select("doc_id", F.concat("lang", F.lit("!")).alias("lang"), F.lit(2).alias("version"))
    return S.upsert(old, new, "doc_id", "version")


@query("s11_keyed_table", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang || '!' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 11 <> 0""")
def keyed_table(t: Tables) -> DataFrame:
    """Rows written to a keyed table, a seventh replaced and an eleventh deleted in its buckets."""
    table = KeyedTable(t.spark, f"{shared_folder(t.spark)}/keyed-{uuid.uuid4().hex}", "doc_id", "doc_id long, lang string, version int", 32)
    table.change(t.documents.select("doc_id", "lang", F.lit(1).alias("version")))
    new = t.documents.filter("doc_id % 7 = 0 AND doc_id % 11 <> 0").select("doc_id", F.concat("lang", F.lit("!")).alias("lang"), F.lit(2).alias("version"))
    table.change(new, deleted=t.documents.filter("doc_id % 11 = 0").select("doc_id"))
    return table.read()


@query("s12_write_table", "SELECT 'csv' AS format, doc_id, lang, n_chars FROM documents UNION ALL SELECT 'json', doc_id, lang, n_chars FROM documents UNION ALL SELECT 'parquet', doc_id, lang, n_chars FROM documents")
def write_table(t: Tables) -> DataFrame:
    """The table written in each format and read again."""
    rows, at = t.documents.select("doc_id", "lang", "n_chars"), f"{shared_folder(t.spark)}/export-{uuid.uuid4().hex}"
    found = []
    for kind in ("csv", "json", "parquet"):
        S.write_table(rows, f"{at}/{kind}", kind)
        reader = t.spark.read.schema(rows.schema).options(**({"header": "true"} if kind == "csv" else {}))
        found.append(reader.format(kind).load(f"{at}/{kind}").select(F.lit(kind).alias("format"), *rows.columns))
    return found[0].union(found[1]).union(found[2])


@query("p1_select_keys", "SELECT n_nationkey, n_name FROM nation")
def select_keys(t: Tables) -> DataFrame:
    return R.select_keys(t.nation, ["n_nationkey", "n_name", "absent"])


@query("p2_remove_keys", "SELECT n_nationkey, n_regionkey FROM nation")
def remove_keys(t: Tables) -> DataFrame:
    return R.remove_keys(t.nation, ["n_name", "absent"])


@query("p3_rename_keys", "SELECT s_suppkey AS s_nationkey, s_name AS name, s_acctbal FROM supplier")
def rename_keys(t: Tables) -> DataFrame:
    return R.rename_keys(t.supplier, [("s_suppkey", "s_nationkey"), ("s_name", "name"), ("", "x"), ("absent", "y")])


@query("p4_append_or_update", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, 'world' AS planet FROM nation")
def append_or_update(t: Tables) -> DataFrame:
    return R.append_or_update(t.nation, {"n_name": F.upper("n_name"), "planet": F.lit("world")})


@query("p5_filter_values", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%' AND c_mktsegment <> 'X' AND contains(c_name, '1')")
def filter_values(t: Tables) -> DataFrame:
    return R.filter_values(t.customer, [("c_mktsegment", "start with", "B"), ("c_mktsegment", "≠", "X"), ("c_name", "contains", "1")]).select("c_custkey", "c_mktsegment")


@query("p6_combine", """
SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def combine(t: Tables) -> DataFrame:
    out = R.combine(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], ["l_partkey", "l_returnflag"])
    return out.select("l_orderkey", F.array_join(F.col("l_partkey").cast("array<string>"), ",").alias("parts"), F.array_join("l_returnflag", ",").alias("flags"))


@query("p7_literal_eval", r"""
WITH x AS (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '12.5' WHEN 2 THEN 'True' ELSE 'word' END AS v FROM events)
SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'text' ELSE CASE WHEN props IS NULL THEN 'text' WHEN regexp_matches(trim(props), '^\{.*\}$') THEN 'object' ELSE 'text' END END AS kind,
  CASE event_id % 4 WHEN 1 THEN 12.5 END AS number FROM x""")
def literal_eval(t: Tables) -> DataFrame:
    v = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '12.5' WHEN 2 THEN 'True' ELSE 'word' END")
    out = t.events.select("event_id", R.literal_eval(v).alias("x"))
    return out.select("event_id", F.col("x.kind").alias("kind"), F.col("x.number").alias("number"))


_RANKED = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {}, o_orderkey {})"


@query("p8_list_top", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY {_RANKED.format('', '')} <= 2")
def list_top(t: Tables) -> DataFrame:
    return R.list_top(t.orders, 2, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("p8_list_head", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY {_RANKED.format('', '')} = 3")
def list_head(t: Tables) -> DataFrame:
    return R.list_head(t.orders, 3, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("p8_list_tail", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY {_RANKED.format('DESC', 'DESC')} = 2")
def list_tail(t: Tables) -> DataFrame:
    return R.list_tail(t.orders, 2, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("p9_list_filter", "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 't')")
def list_filter(t: Tables) -> DataFrame:
    return R.list_filter(t.part, "p_name", "end with", "t").select("p_partkey", "p_name")


@query("p10_list_sort", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_name DESC, n_nationkey DESC, n_regionkey DESC")
def list_sort(t: Tables) -> DataFrame:
    return R.list_sort(t.nation, descending=True)


@query("p11_drop_duplicates", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def drop_duplicates(t: Tables) -> DataFrame:
    return R.drop_duplicates(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


@query("p12_route", """
SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '1-urg%' AND o_totalprice > 1000 THEN 'fast' WHEN o_orderstatus = 'F' OR contains(lower(o_orderpriority), 'low') THEN 'slow' ELSE 'usual' END AS route FROM orders""")
def route(t: Tables) -> DataFrame:
    cases = [("fast", "and", [("o_orderpriority", "start with", "1-URG"), ("o_totalprice", ">", "1000")]), ("slow", "or", [("o_orderstatus", "=", "F"), ("o_orderpriority", "contains", "LOW")])]
    return R.route(t.orders, cases, "usual").select("o_orderkey", "route")


@query("p13_first_available", "SELECT conv_id, turn, coalesce(nullif(text, ''), role) AS value FROM conversations")
def first_available(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", R.first_available({"v": [F.col("text"), F.col("role")]})["v"].alias("value"))


@query("p14_assign", """
SELECT p_partkey, p_size + 5 AS p_size, CASE WHEN p_size % 10 <> 0 THEN round(p_retailprice / (p_size % 10), 6) ELSE round(p_retailprice, 6) END AS price,
  CASE WHEN p_size % 10 = 0 THEN 'division by zero: price' END AS _error FROM part""")
def assign(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("price"), (F.col("p_size") % 10).alias("d"))
    out = R.assign(df, [("price", "/=", F.col("d")), ("p_size", "+=", F.lit(5))])
    return out.select("p_partkey", "p_size", F.round("price", 6).alias("price"), "_error")


@query("p15_filter_chunks", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND NOT coalesce((CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END) < 1, false)")
def filter_chunks(t: Tables) -> DataFrame:
    df = t.documents.withColumn("available_int", F.expr("CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END"))
    return R.filter_chunks(df, {"lang": ["en", "fr"], "available_int": 1, "source": ""}).select("doc_id")


@query("p18_update_where", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'eng' ELSE lang END AS lang, CASE WHEN lang = 'en' THEN source || ',new' ELSE source END AS tags FROM documents")
def update_where(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "lang", F.array("source").alias("tags"))
    out = R.update_where(df, F.col("lang") == "en", {"lang": F.lit("eng")}, adds={"tags": "new"})
    return out.select("doc_id", "lang", F.array_join("tags", ",").alias("tags"))


@query("p19_delete_where", "SELECT doc_id FROM documents WHERE NOT coalesce(lang IN ('en') AND source IS NOT NULL, false)")
def delete_where(t: Tables) -> DataFrame:
    return R.delete_where(t.documents, {"lang": ["en"], "doc_id": []}, exists=["source"]).select("doc_id")


@query("p20_to_fixed_schema", "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS kb_id, 1 AS available_int FROM documents")
def to_fixed_schema(t: Tables) -> DataFrame:
    df = t.documents.select(F.col("doc_id").alias("id"), F.array("source").alias("kb_id"), F.array(F.col("n_chars")).alias("sizes"))
    return R.to_fixed_schema(df, {"id": ("string", ""), "kb_id": ("string", ""), "available_int": ("int", 1)}).drop("extra")
