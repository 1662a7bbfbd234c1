"""Queries over evaluation, sync, memory and enrichment (E, I, M and U rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrich as U
from ..operators import evaluate as E
from ..operators import memory as M
from ..operators import sync as I
from ..registry import Tables, query
from .text import TOKENS_SQL

# a run: a customer's orders by price; the truth: those of status F


def run(t: Tables) -> DataFrame:
    from ..operators.retrieval import top_n

    return top_n(t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), "o_totalprice"), ["case_id"], [F.desc("o_totalprice"), F.asc("id")], 6).select("case_id", "id", "rank")


def truth(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"))


_RUN = """WITH run AS (SELECT o_custkey AS case_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 6),
truth AS (SELECT o_custkey AS case_id, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT w.case_id, w.wanted, coalesce(f.found, 0) AS found, coalesce(h.hits, 0) AS hits, h.first FROM (SELECT case_id, count(*) AS wanted FROM truth GROUP BY 1) w LEFT JOIN (SELECT case_id, count(*) AS found FROM run GROUP BY 1) f USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS hits, min(rank) AS first FROM run JOIN truth USING (case_id, id) GROUP BY 1) h USING (case_id)),
m AS (SELECT case_id, coalesce(hits / nullif(found, 0), 0) AS precision, hits / wanted AS recall, coalesce(1 / first, 0) AS mrr, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit FROM x)"""


@query("e1_retrieval_metrics", _RUN + " SELECT case_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, hit::DOUBLE AS hit, round(mrr, 6) AS mrr FROM m")
def retrieval_metrics(t: Tables) -> DataFrame:
    m = E.retrieval_metrics(run(t), truth(t))
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "hit", "mrr")])


@query("e2_summarize_metrics", _RUN + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM m")
def summarize_metrics(t: Tables) -> DataFrame:
    s = E.summarize_metrics(E.retrieval_metrics(run(t), truth(t)), ["precision", "recall", "mrr"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("e3_ranking_metrics", _RUN.split("truth AS")[0].rstrip().rstrip(",") + """,
q AS (SELECT o_custkey AS case_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS rel FROM orders),
j AS (SELECT case_id, id, rank, rel, sum((rel > 0)::INT) OVER (PARTITION BY case_id ORDER BY rank) AS seen FROM run JOIN q USING (case_id, id)),
a AS (SELECT case_id, count(*) AS n FROM q WHERE rel > 0 GROUP BY 1),
i AS (SELECT case_id, sum(rel / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rel DESC, id) AS r FROM q) WHERE r <= 10 GROUP BY 1),
g AS (SELECT case_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END) AS dcg, sum(CASE WHEN rel > 0 AND rank <= 5 THEN seen / rank ELSE 0 END) AS ap, max(CASE WHEN rel > 0 AND rank <= 10 THEN 1 / rank ELSE 0 END) AS mrr FROM j GROUP BY 1)
SELECT case_id AS qid, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg, round(ap / n, 6) AS map, round(mrr, 6) AS mrr FROM g JOIN a USING (case_id) JOIN i USING (case_id)""")
def ranking_metrics(t: Tables) -> DataFrame:
    qrels = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docid"), F.expr("CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END").alias("relevance"))
    m = E.ranking_metrics(run(t).toDF("qid", "docid", "rank"), qrels)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("ndcg", "map", "mrr")])


@query("e4_answer_metrics", "SELECT conv_id, turn, length(text) AS answer_length, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS has_answer FROM conversations WHERE role = 'assistant'")
def answer_metrics(t: Tables) -> DataFrame:
    return E.answer_metrics(t.conversations.filter("role = 'assistant'"), "text").select("conv_id", "turn", "answer_length", "has_answer")


@query("e5_recommend", _RUN + " SELECT unnest(list_filter([CASE WHEN avg(precision) < 0.7 THEN 'low_precision' END, CASE WHEN avg(recall) < 0.7 THEN 'low_recall' END], lambda x: x IS NOT NULL)) AS issue FROM m")
def recommend(t: Tables) -> DataFrame:
    m = E.retrieval_metrics(run(t), truth(t)).withColumn("execution_time", F.lit(1.0))
    return E.recommend(E.summarize_metrics(m, ["precision", "recall", "execution_time"]))


@query("e6_latency_summary", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS count, round(avg(value), 6) AS avg, min(value) AS min, min(value) FILTER (WHERE r >= ceil(0.5 * n)) AS p50, min(value) FILTER (WHERE r >= ceil(0.9 * n)) AS p90, min(value) FILTER (WHERE r >= ceil(0.95 * n)) AS p95 FROM r GROUP BY 1""")
def latency_summary(t: Tables) -> DataFrame:
    return E.latency_summary(t.events, "event_type", "value").withColumn("avg", F.round("avg", 6))


@query("i1_pull_window", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09'")
def pull_window(t: Tables) -> DataFrame:
    return I.pull_window(t.events, "ts", "2024-01-05", "2024-01-09").select("event_id")


def existing(t: Tables) -> DataFrame:
    return t.documents.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise("kb").alias("kb_id"))


def incoming(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return t.documents.select(F.col("doc_id").alias("id"), F.md5(text).alias("content_hash"))


_CHANGES = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'add' WHEN doc_id % 13 = 0 THEN 'reject' WHEN doc_id % 7 = 0 THEN 'update' ELSE 'skip' END AS action FROM documents"


@query("i2_detect_changes", _CHANGES)
def detect_changes(t: Tables) -> DataFrame:
    return I.detect_changes(existing(t), incoming(t), "kb")


def stale(t: Tables) -> DataFrame:
    return I.stale_documents(existing(t), t.documents.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("id")))


@query("i3_stale_documents", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 = 0")
def stale_documents(t: Tables) -> DataFrame:
    return stale(t)


@query("i4_advance_watermark", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS mark FROM events GROUP BY 1")
def advance_watermark(t: Tables) -> DataFrame:
    log = t.events.groupBy("event_type").agg(F.min("ts").alias("mark"))
    return I.advance_watermark(log, t.events, "event_type", "mark", "ts").select("event_type", F.date_format("mark", "yyyy-MM-dd HH:mm:ss").alias("mark"))


@query("i5_sync_summary", f"SELECT action, count(*) AS count FROM ({_CHANGES} UNION ALL SELECT doc_id, 'delete' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 = 0) GROUP BY 1")
def sync_summary(t: Tables) -> DataFrame:
    return I.sync_summary(I.detect_changes(existing(t), incoming(t), "kb"), stale(t))


@query("i6_disambiguate_names", """
WITH e AS (SELECT 'f' || doc_id % 50 || '.txt' AS name, 1 AS held FROM documents WHERE doc_id < 60 GROUP BY 1), i AS (SELECT doc_id AS id, 'f' || doc_id % 50 || '.txt' AS name, 'f' || doc_id % 50 AS base FROM documents WHERE doc_id >= 60),
n AS (SELECT id, i.name, base, row_number() OVER (PARTITION BY i.name ORDER BY id) - 1 + coalesce(held, 0) AS n FROM i LEFT JOIN e ON e.name = i.name) SELECT id, CASE WHEN n > 0 THEN base || '(' || n || ').txt' ELSE name END AS name FROM n""")
def disambiguate_names(t: Tables) -> DataFrame:
    named = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("name"))
    return I.disambiguate_names(named.filter("id < 60"), named.filter("id >= 60"))


@query("i7_plan_work", """
SELECT doc_id AS task_id, md5('cfg|' || doc_id || '|' || n_chars) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id END AS chunk_ids FROM documents""")
def plan_work(t: Tables) -> DataFrame:
    digest = I.work_digest(F.lit("cfg"), F.col("doc_id"), F.col("n_chars"))
    done = t.documents.filter("doc_id % 3 = 0").select(digest.alias("digest"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_ids"), F.lit(1).alias("finished_at"))
    return I.plan_work(t.documents.select(F.col("doc_id").alias("task_id"), digest.alias("digest")), done)


@query("i8_apply_feedback", """
WITH RECURSIVE e AS (SELECT user_id AS chunk_id, CASE WHEN event_type = 'click' THEN 1.0 ELSE -1.0 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w(chunk_id, i, weight) AS (SELECT DISTINCT chunk_id, 0, 1.0::DOUBLE FROM e UNION ALL SELECT w.chunk_id, e.i, least(100.0, greatest(0.0, w.weight + e.d)) FROM w JOIN e ON e.chunk_id = w.chunk_id AND e.i = w.i + 1)
SELECT chunk_id, arg_max(weight, i) AS weight FROM w GROUP BY 1""")
def apply_feedback(t: Tables) -> DataFrame:
    """Clicks raise and other events lower a user's weight, in time order."""
    events = t.events.select("event_id", F.col("ts").alias("at"), (F.col("event_type") == "click").alias("positive"), F.col("user_id").alias("chunk_id"), F.col("value").alias("score"))
    chunks = t.events.select(F.col("user_id").alias("chunk_id")).distinct().withColumn("weight", F.lit(1.0))
    return I.apply_feedback(chunks, events)


@query("i9_verify_copy", """
WITH x AS (SELECT count(*) AS n, sum((c_custkey % 30 <> 0)::INT) AS same FROM customer WHERE c_custkey % 400 <> 0)
SELECT 'rows' AS field, (SELECT count(*) FROM customer) AS compared, n AS matches, CASE WHEN n / (SELECT count(*) FROM customer) >= 0.99 THEN 'pass' ELSE 'fail' END AS status FROM x
UNION ALL SELECT 'c_name', n, n, 'pass' FROM x UNION ALL SELECT 'c_mktsegment', n, same, CASE WHEN same / n >= 0.99 THEN 'pass' WHEN same / n >= 0.95 THEN 'warn' ELSE 'fail' END FROM x""")
def verify_copy(t: Tables) -> DataFrame:
    copy = t.customer.filter("c_custkey % 400 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 30 == 0, "?").otherwise(F.col("c_mktsegment")))
    return I.verify_copy(t.customer, copy, "c_custkey", ["c_name", "c_mktsegment"])


@query("i10_prune_logs", "SELECT event_id FROM (SELECT event_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events WINDOW w AS (PARTITION BY user_id % 50)) WHERE n <= 100 OR r > 70")
def prune_logs(t: Tables) -> DataFrame:
    return I.prune_logs(t.events.withColumn("connector", F.col("user_id") % 50), ["connector"], "event_id").select("event_id")


# messages: each turn of a conversation; every ninth conversation forgets its turns


def messages(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), (F.col("conv_id") % 10).alias("agent_id"), F.col("turn").alias("valid_at"), F.when(F.col("conv_id") % 9 == 0, F.col("turn")).alias("forget_at"), F.lit(1).alias("status"), F.col("text").alias("content"))


_MSG = "WITH m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, conv_id % 10 AS agent_id, turn AS valid_at, CASE WHEN conv_id % 9 = 0 THEN turn END AS forget_at, text AS content, octet_length(encode(text)) AS size FROM conversations)"


@query("m1_list_messages", _MSG + """,
p AS (SELECT * FROM m WHERE contains(CAST(session_id AS VARCHAR), '1') ORDER BY valid_at DESC, message_id LIMIT 20 OFFSET 5)
SELECT message_id, 2 AS n FROM p""")
def list_messages(t: Tables) -> DataFrame:
    m = messages(t).withColumn("session_id", F.col("session_id").cast("string"))
    made = m.select((F.col("message_id") * 10 + 1).alias("message_id"), F.col("message_id").alias("source_id"), "content")
    made = made.union(made.select(F.col("message_id") + 1, "source_id", "content"))
    return M.list_messages(m, made, "1", 5, 20).select("message_id", F.size("extracted").alias("n"))


@query("m2_recent_messages", _MSG + " SELECT message_id FROM m WHERE forget_at IS NULL QUALIFY row_number() OVER (PARTITION BY agent_id, session_id ORDER BY valid_at DESC, message_id DESC) <= 2")
def recent_messages(t: Tables) -> DataFrame:
    return M.recent_messages(messages(t), 2).select("message_id")


@query("m3_search_messages", _MSG + f""",
dt AS (SELECT DISTINCT message_id, unnest({TOKENS_SQL.replace("text", "content")}) AS term FROM m), qt AS (SELECT DISTINCT conv_id * 1000 AS query_id, unnest({TOKENS_SQL}) AS term FROM conversations WHERE turn = 0),
f AS (SELECT term, count(*) AS df FROM dt GROUP BY 1), nn AS (SELECT count(*) AS n FROM m),
h AS (SELECT query_id, message_id AS id, sum(2.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS raw, count(*) AS found FROM qt JOIN dt USING (term) JOIN f USING (term), nn GROUP BY 1, 2),
tx AS (SELECT query_id, id, raw AS text_score FROM h JOIN (SELECT query_id, count(*) AS size FROM qt GROUP BY 1) USING (query_id) WHERE found >= ceil(0.3 * size)),
ve AS (SELECT q.vec_id * 1000 AS query_id, e.vec_id * 1000 AS id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0) AS sim FROM embeddings q, embeddings e),
vx AS (SELECT query_id, id, sim FROM ve WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) <= 10),
live AS (SELECT message_id AS id FROM m WHERE forget_at IS NULL),
fu AS (SELECT query_id, id, coalesce(text_score, 0) * (1 - 0.7::DOUBLE) + coalesce(sim, 0) * 0.7::DOUBLE AS score FROM (SELECT * FROM tx WHERE id IN (FROM live)) FULL JOIN (SELECT * FROM vx WHERE id IN (FROM live)) USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fu QUALIFY rank <= 5""")
def search_messages(t: Tables) -> DataFrame:
    """The first turn of each conversation asks by words and every embedding by cosine, also where no such turn is; turns answer
    by words, embeddings of the same number by cosine."""
    from ..functions.weights import fulltext_search
    from ..operators.retrieval import vector_topk

    m = messages(t)
    asked = t.conversations.filter("turn = 0").select((F.col("conv_id") * 1000).alias("query_id"), X.tokenize(F.col("text")).alias("tokens"))
    text = fulltext_search(m.select(F.col("message_id").alias("doc_id"), X.tokenize(F.col("content")).alias("tokens")), asked, {"tokens": 2.0}).select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("text_score"))
    vec = t.embeddings.select((F.col("vec_id") * 1000).alias("id"), F.col("embedding").alias("vec"))
    sims = vector_topk(vec, vec.withColumnRenamed("id", "query_id"), 10, 0.1).select("query_id", "id", "sim")
    out = M.search_messages(text, sims, m)
    return out.withColumn("score", F.round("score", 6))


@query("m4_memory_size", _MSG + " SELECT agent_id, sum(size) AS bytes FROM m GROUP BY 1")
def memory_size(t: Tables) -> DataFrame:
    return M.memory_size(messages(t), "agent_id", M.message_size("content"))


@query("m5_build_messages", """
SELECT conv_id, turn, 'User Input: ' || text || chr(10) || 'Agent Response: ' || coalesce(CASE WHEN r = 'assistant' THEN x END, '') AS content FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def build_messages(t: Tables) -> DataFrame:
    return M.build_messages(t.conversations)


@query("m6_pick_evictions", _MSG + """,
x AS (SELECT *, sum(size) OVER (PARTITION BY agent_id) - 4000 AS excess, coalesce(sum(size) OVER (PARTITION BY agent_id ORDER BY forget_at IS NULL, coalesce(forget_at, valid_at), message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT agent_id, message_id FROM x WHERE excess > 0 AND before < excess""")
def pick_evictions(t: Tables) -> DataFrame:
    return M.pick_evictions(messages(t).withColumn("size", M.message_size("content")), "agent_id", 4000).select("agent_id", "message_id")


@query("m7_forget", _MSG + " SELECT message_id FROM m WHERE forget_at IS NULL AND message_id NOT IN (1001, 2001)")
def forget(t: Tables) -> DataFrame:
    return M.missing_field(M.forget(messages(t), [1001, 2001], F.lit(99).cast("long")), "forget_at").select("message_id")


@query("m7_max_message_id", _MSG + " SELECT coalesce(max(message_id), 1) AS max_id FROM m")
def max_message_id(t: Tables) -> DataFrame:
    return M.max_message_id(messages(t))


_COUNTED = "[" + ", ".join(f"(0.1 * (length(source) - length(replace(source, '{c}', ''))) + 0.9 * (length(body) - length(replace(body, '{c}', ''))))" for c in "aeiou") + "]"


@query("u1_embed_chunks", f"""WITH x AS (SELECT doc_id, source, CASE WHEN trim(text) = '' THEN 'None' ELSE text END AS body FROM (SELECT doc_id, source, regexp_replace(text, '{X.TABLE_TAGS}', ' ', 'g') AS text FROM documents))
SELECT doc_id AS id, {" , ".join(f"round({_COUNTED}[{k}]::DOUBLE, 4) AS v{k}" for k in range(1, 6))} FROM x""")
def embed_chunks(t: Tables) -> DataFrame:
    """With counts of letters as the embedding."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(x.count(c)) for c in "aeiou"] for x in texts]

    df = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit("").alias("questions"))
    return U.embed_chunks(df, encode).select("id", *[F.round(F.col("vec")[k - 1], 4).alias(f"v{k}") for k in range(1, 6)])


@query("u2_with_cache", "SELECT c_mktsegment, CASE WHEN c_mktsegment < 'C' THEN 'kept' ELSE upper(c_mktsegment) END AS value FROM customer GROUP BY 1")
def with_cache(t: Tables) -> DataFrame:
    cache = t.customer.filter("c_mktsegment < 'C'").select("c_mktsegment").distinct().withColumn("value", F.lit("kept"))
    return U.with_cache(t.customer, lambda missing: missing.withColumn("value", F.upper("c_mktsegment")), cache, "c_mktsegment")


@query("u3_add_keywords", "SELECT o_orderkey, lower(o_orderstatus) || '|' || o_custkey AS tks FROM orders")
def add_keywords(t: Tables) -> DataFrame:
    df = t.orders.withColumn("k", F.concat("o_orderstatus", F.lit(", "), F.col("o_custkey").cast("string"), F.lit(" ,")))
    return U.add_keywords(df, "k").select("o_orderkey", F.array_join("important_tks", "|").alias("tks"))


@query("u3_add_questions", f"""WITH x AS (SELECT item_id, list_filter(list_transform(string_split('What is ' || text || '?' || chr(10) || ' ' || chr(10) || ' Why so? ', chr(10)), lambda w: trim(w)), lambda w: w <> '') AS q FROM benchmark)
SELECT item_id, len(q) AS n, array_to_string({TOKENS_SQL.replace("text", "array_to_string(q, chr(10))")}, '|') AS tks FROM x""")
def add_questions(t: Tables) -> DataFrame:
    df = t.benchmark.withColumn("q", F.concat(F.lit("What is "), "text", F.lit("?\n \n Why so? ")))
    return U.add_questions(df, "q").select("item_id", F.size("question_kwd").alias("n"), F.array_join("question_tks", "|").alias("tks"))


def upper_letter(c: str) -> str:
    """One letter for one, as SQL's ``upper``: Python's would make two of some."""
    return next((u for u in ("ẞ" if c == "ß" else c.upper(), c.title()) if len(u) == 1), c)


@query("u4_extract_field", "SELECT doc_id, upper(substr(text, 1, 1)) AS initial FROM documents")
def extract_field(t: Tables) -> DataFrame:
    return U.extract_field(t.documents, "initial", lambda s: upper_letter(s[:1])).select("doc_id", "initial")


@query("u5_section_ranges", """
WITH c AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_partkey AS id FROM lineitem),
t AS (SELECT doc_id, n AS start, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS nxt, max(m) OVER (PARTITION BY doc_id) AS last FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM c) WHERE n % 3 = 1)
SELECT t.doc_id, 's' || start AS section, c.id FROM t JOIN c ON c.doc_id = t.doc_id AND c.n BETWEEN start AND coalesce(nxt, last)""")
def section_ranges(t: Tables) -> DataFrame:
    from ..sources.documents import row_number

    c = row_number(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"], "chunk_order").select(F.col("l_orderkey").alias("doc_id"), "chunk_order", F.col("l_partkey").alias("id"))
    toc = c.filter("chunk_order % 3 = 1").select("doc_id", F.concat(F.lit("s"), F.col("chunk_order").cast("string")).alias("section"), F.col("chunk_order").alias("start"))
    return U.section_ranges(toc, c)


@query("u6_ids", "SELECT md5(text || doc_id) AS chunk, md5(CAST(doc_id AS VARCHAR)) AS doc FROM documents")
def ids(t: Tables) -> DataFrame:
    return t.documents.select(U.chunk_id(F.col("text"), F.col("doc_id")).alias("chunk"), U.doc_key(F.col("doc_id")).alias("doc"))


@query("u7_index_chunks", f"SELECT md5(text || doc_id) AS id, doc_id, md5(array_to_string({TOKENS_SQL}, ' ')) AS tks, source AS docnm_kwd FROM documents")
def index_chunks(t: Tables) -> DataFrame:
    out = U.index_chunks(t.documents.select("doc_id", F.lit(0).alias("chunk_order"), "text"), t.documents.select("doc_id", F.col("source").alias("title")))
    return out.select("id", "doc_id", F.md5(F.array_join("content_ltks", " ")).alias("tks"), "docnm_kwd")
