"""Queries over weights, similarities and retrieval (W and R rows): the benchmark's texts ask, the documents answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import weights as W
from ..functions.scores import shared_sums
from ..operators import postings as P
from ..operators import retrieval as R
from ..lineage import checkpoint, shared_folder, written
from ..registry import Tables, query
from .text import COUNT_SQL, TOKENS_SQL


def doc_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.tokenize(F.col("text")).alias("tokens"))


def query_tokens(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), X.tokenize(F.col("text")).alias("tokens"))


_BASE = f"""
WITH d AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents), q AS (SELECT item_id AS query_id, {TOKENS_SQL} AS tokens FROM benchmark),
dt AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM d), qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
f AS (SELECT term, count(*) AS df FROM dt GROUP BY 1), nn AS (SELECT count(*) AS n FROM documents)"""

_WEIGHTS = """,
qp AS (SELECT query_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM q),
qr AS (SELECT query_id, pos, term, log10(10 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * CASE WHEN regexp_full_match(term, '[0-9.,]{2,}') THEN 2.0 WHEN regexp_full_match(term, '[a-z]{1,2}') THEN 0.01 ELSE 1.0 END AS w
  FROM qp LEFT JOIN f USING (term), nn),
qw AS (SELECT query_id, pos, term, w / sum(w) OVER (PARTITION BY query_id) AS weight FROM qr)"""


def query_weights(t: Tables) -> DataFrame:
    terms = query_tokens(t).select(F.explode("tokens").alias("term")).distinct()
    df = W.document_frequency(doc_tokens(t), "doc_id", "tokens", terms)
    return W.term_weights(query_tokens(t), checkpoint(df), F.lit(t.documents.count()), "query_id", "tokens")


@query("w1_term_weights", _BASE + _WEIGHTS + " SELECT query_id, pos, term, round(weight, 6) AS weight FROM qw")
def term_weights(t: Tables) -> DataFrame:
    return query_weights(t).withColumn("weight", F.round("weight", 6))


@query("w2_document_frequency", _BASE + " SELECT term, df FROM f")
def document_frequency(t: Tables) -> DataFrame:
    return W.document_frequency(doc_tokens(t), "doc_id", "tokens")


_FULLTEXT = """,
h AS (SELECT query_id, doc_id, sum(2 * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score, count(*) AS found FROM qt JOIN dt USING (term) JOIN f USING (term), nn GROUP BY 1, 2),
m AS (SELECT query_id, doc_id, score FROM h JOIN (SELECT query_id, count(*) AS size FROM qt GROUP BY 1) USING (query_id) WHERE found >= ceil(0.3 * size))"""

#: Documents of a query that pages of token scores are worked out for: the best by text.
WINDOW = 64
_CANDIDATES = _FULLTEXT + f""",
cand AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM m) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {WINDOW})"""


def keyword_index(t: Tables) -> P.KeywordIndex:
    return P.write_index(doc_tokens(t), {"tokens": 2.0}, f"{shared_folder(t.spark)}/keywords-{uuid.uuid4().hex}")


def text_top(t: Tables, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` by text."""
    return P.search_top(keyword_index(t), query_tokens(t), k)


_KEYS = """,
qk AS (SELECT query_id, key, sum(w) AS w FROM (SELECT query_id, term AS key, 0.4 * weight AS w FROM qw UNION ALL
  SELECT query_id, term || ' ' || t2, 0.6 * greatest(weight, w2) FROM (SELECT *, lead(term) OVER x AS t2, lead(weight) OVER x AS w2 FROM qw WINDOW x AS (PARTITION BY query_id ORDER BY pos)) WHERE t2 IS NOT NULL) GROUP BY 1, 2),
dk AS (SELECT DISTINCT doc_id, term AS key FROM dt UNION SELECT DISTINCT doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(tokens[1:len(tokens)-1]) AS a, unnest(tokens[2:len(tokens)]) AS b FROM d)),
tk AS (SELECT query_id, doc_id, (1e-9 + sum(w)) / (1e-9 + any_value(total)) AS tksim FROM cand JOIN qk USING (query_id) JOIN dk USING (doc_id, key) JOIN (SELECT query_id, sum(w) AS total FROM qk GROUP BY 1) USING (query_id) GROUP BY 1, 2)"""


#: The same for all documents that share a key with a query.
_ALL_KEYS = _KEYS.replace("FROM cand JOIN qk USING (query_id) JOIN dk USING (doc_id, key)", "FROM qk JOIN dk USING (key)")


def doc_keys(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, key): terms and neighbouring pairs of documents, of those that ``keys`` holds."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws(" ", F.element_at("tokens", i), F.element_at("tokens", i + 1)))
    own = tokens.select("doc_id", F.explode(F.array_distinct(F.when(F.size("tokens") > 1, F.concat("tokens", pairs)).otherwise(F.col("tokens")))).alias("key"))
    return own.join(keys.select("key").distinct(), "key")


def all_token_pairs(t: Tables, asked: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, tksim, vtsim): all queries and documents that share a key, with the cosine of vectors that ``asked``
    (query_id, vec) and ``answers`` (doc_id, vec) have for them."""
    keys = written(W.weighted_keys(query_weights(t), "query_id"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws(" ", F.element_at("tokens", i), F.element_at("tokens", i + 1)))
    own = F.array_distinct(F.when(F.size("tokens") > 1, F.concat("tokens", pairs)).otherwise(F.col("tokens")))
    docs = doc_tokens(t).select("doc_id", F.transform(own, lambda x: F.xxhash64(x)).alias("keys"))
    docs = docs.withColumn("in_fields", F.array_repeat(F.lit(1), F.size("keys")))
    sizes = keys.groupBy("query_id").agg(F.lit(1).alias("least"), F.sum("w").alias("_total"))
    if asked is not None:
        docs, sizes = docs.join(answers, "doc_id", "left"), sizes.join(asked, "query_id", "left")
    hits = shared_sums(docs, keys.select("query_id", F.xxhash64("key").alias("key"), F.col("w").alias("w0")), sizes, 1)
    share = (F.lit(1e-9) + F.col("s0")) / (F.lit(1e-9) + F.col("_total"))
    # a row for each query
    return hits.join(F.broadcast(sizes.select("query_id", "_total")), "query_id").select("query_id", "doc_id", share.alias("tksim"), F.col("cosine").alias("vtsim"))


def token_pairs(t: Tables) -> DataFrame:
    """Similarities of each query and its window of documents. Of the documents, only those of windows are cut into keys, and
    only keys of queries are kept."""
    cands = checkpoint(text_top(t, WINDOW).select("query_id", "doc_id"))
    keys = checkpoint(W.weighted_keys(query_weights(t), "query_id"))
    tokens = doc_tokens(t).join(cands.select("doc_id").distinct(), "doc_id", "left_semi")
    return W.token_similarity(keys, doc_keys(tokens, keys), "query_id", "doc_id", cands)


@query("w3_token_similarity", _BASE + _WEIGHTS + _ALL_KEYS + " SELECT query_id, doc_id, round(tksim, 6) AS tksim FROM tk")
def token_similarity(t: Tables) -> DataFrame:
    return all_token_pairs(t).select("query_id", "doc_id", F.round("tksim", 6).alias("tksim"))


@query("w4_cosine", """
SELECT a.vec_id AS a, b.vec_id AS b, round(coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 0), 6) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(t: Tables) -> DataFrame:
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(W.cosine("va", "vb"), 6).alias("sim"))


_VECTORS = """,
vt AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0) AS vtsim
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings e)"""


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("w5_hybrid_similarity", _BASE + _WEIGHTS + _ALL_KEYS + _VECTORS + """,
p AS (SELECT tk.query_id, tk.doc_id, tksim, CASE WHEN tk.query_id % 2 = 0 THEN coalesce(vtsim, 0) ELSE 0 END AS vtsim FROM tk LEFT JOIN vt ON tk.query_id = vt.query_id AND tk.doc_id = vt.doc_id)
SELECT query_id, doc_id, round(CASE WHEN bool_or(vtsim <> 0) OVER (PARTITION BY query_id) THEN 0.3 * tksim + 0.7 * vtsim ELSE tksim END, 6) AS sim FROM p""")
def hybrid_similarity(t: Tables) -> DataFrame:
    """Texts and vectors of the same id; every other query has no vector."""
    asked = vector_queries(t).filter("query_id % 2 = 0")
    scored = written(all_token_pairs(t, asked, vectors(t).withColumnRenamed("id", "doc_id")))
    seen = scored.groupBy("query_id").agg(F.max(F.col("vtsim") != 0).alias("any_vector"))  # a row for each query
    sim = F.when(F.col("any_vector"), 0.3 * F.col("tksim") + 0.7 * F.col("vtsim")).otherwise(F.col("tksim"))
    return scored.join(F.broadcast(seen), "query_id").select("query_id", "doc_id", F.round(sim, 6).alias("sim"))


def fulltext(t: Tables) -> DataFrame:
    return W.fulltext_search(doc_tokens(t), query_tokens(t), {"tokens": 2.0}, 0.3)


@query("w6_fulltext_search", _BASE + _FULLTEXT + " SELECT query_id, doc_id, round(score, 6) AS score FROM m")
def fulltext_search(t: Tables) -> DataFrame:
    return fulltext(t).withColumn("score", F.round("score", 6))


@query("w6_fulltext_top", _BASE + _FULLTEXT + """
SELECT query_id, m.doc_id, source, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, m.doc_id) AS rank FROM m JOIN documents USING (doc_id) QUALIFY rank <= 5""")
def fulltext_top(t: Tables) -> DataFrame:
    """No document outside a query's candidates is scored."""
    return text_top(t, 5).join(t.documents.select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "source", "score", "rank")


#: Fields with boosts: the first line stands for a title, the longest word for what is important.
FIELDS = {"title": 10.0, "important": 30.0, "tokens": 2.0}
_LINE1 = "text[1:strpos(text || chr(10), chr(10)) - 1]"


def fielded(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", X.tokenize(F.substring_index("text", "\n", 1)).alias("title"), X.tokenize(F.col("text")).alias("tokens"))
    return d.withColumn("important", F.array_compact(F.array(F.array_max(F.transform("tokens", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])))


_MANY = f""",
fd AS (SELECT doc_id, {TOKENS_SQL.replace("coalesce(text, '')", "coalesce(" + _LINE1 + ", '')")} AS title, tokens FROM documents JOIN d USING (doc_id)),
ft AS (SELECT DISTINCT doc_id, 0 AS field, unnest(title) AS term FROM fd UNION ALL SELECT DISTINCT doc_id, 1, w FROM (SELECT doc_id, w FROM (SELECT doc_id, unnest(tokens) AS w FROM fd) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w DESC) = 1) UNION ALL SELECT doc_id, 2, term FROM dt),
ff AS (SELECT field, term, count(*) AS df FROM ft GROUP BY 1, 2),
fs AS (SELECT query_id, doc_id, field, sum([10.0, 30.0, 2.0][field + 1] * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score FROM qt JOIN ft USING (term) JOIN ff USING (field, term), nn GROUP BY 1, 2, 3),
fx AS (SELECT query_id, doc_id, count(DISTINCT term) AS found FROM qt JOIN ft USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, round(max(score), 6) AS score FROM fs JOIN fx USING (query_id, doc_id) JOIN (SELECT query_id, count(*) AS size FROM qt GROUP BY 1) USING (query_id) WHERE found >= ceil(0.3 * size) GROUP BY 1, 2"""


@query("w6_fulltext_fields", _BASE + _MANY)
def fulltext_fields(t: Tables) -> DataFrame:
    return W.fulltext_search(fielded(t), query_tokens(t), FIELDS, 0.3).withColumn("score", F.round("score", 6))


@query("r4_normalize_weights", _BASE + _MANY.replace("[10.0, 30.0, 2.0][field + 1]", "[10.0 / 42, 30.0 / 42, 2.0 / 42][field + 1]"))
def normalize_weights(t: Tables) -> DataFrame:
    """The fields' boosts as shares of one."""
    return W.fulltext_search(fielded(t), query_tokens(t), R.normalize_weights(FIELDS), 0.3).withColumn("score", F.round("score", 6))


@query("w7_expand_query", _BASE + _WEIGHTS + """,
p AS (SELECT query_id, pos, term, weight FROM qw UNION ALL SELECT query_id, pos, term || ' ' || t2, 2 * greatest(weight, w2) FROM (SELECT *, lead(term) OVER x AS t2, lead(weight) OVER x AS w2 FROM qw WINDOW x AS (PARTITION BY query_id ORDER BY pos)) WHERE t2 IS NOT NULL
  UNION ALL SELECT query_id, pos, 'syn' || term, weight / 4 FROM qw WHERE length(term) = 3)
SELECT query_id, term, round(weight, 6) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term, pos) <= 256""")
def expand_query(t: Tables) -> DataFrame:
    w = query_weights(t)
    synonyms = w.filter(F.length("term") == 3).select("term", F.concat(F.lit("syn"), "term").alias("synonym")).distinct()
    return W.expand_query(w, synonyms, "query_id").select("query_id", "term", F.round("weight", 6).alias("weight"))


@query("w8_paragraph_query", _BASE + _WEIGHTS + """,
s AS (SELECT query_id, term, round(sum(weight), 9) AS weight FROM qw GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS n FROM s QUALIFY n <= 30)
SELECT query_id, string_agg(term, ' ' ORDER BY n) AS terms, least(3, round(count(*) / 10.0))::INT AS minimum FROM r GROUP BY 1""")
def paragraph_query(t: Tables) -> DataFrame:
    w = query_weights(t).groupBy("query_id", "term").agg(F.round(F.sum("weight"), 9).alias("weight"))
    out = W.paragraph_query(w, "query_id")
    return out.select("query_id", F.array_join("terms", " ").alias("terms"), "minimum")


@query("r1_vector_topk", "WITH z AS (SELECT 1)" + _VECTORS + """
SELECT query_id, doc_id AS id, round(vtsim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(vtsim, 9) DESC, doc_id) AS rank FROM vt WHERE vtsim >= 0.1 QUALIFY rank <= 20""")
def vector_topk(t: Tables) -> DataFrame:
    return R.vector_topk(vectors(t), vector_queries(t), 20, 0.1).withColumn("sim", F.round("sim", 6))


def text_list(t: Tables) -> DataFrame:
    return fulltext(t).select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("text_score"))


_SIDES = _FULLTEXT + _VECTORS + """,
tl AS (SELECT query_id, doc_id AS id, score AS text_score FROM m),
vl AS (SELECT query_id, doc_id AS id, vtsim AS sim FROM vt WHERE vtsim >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vtsim, 9) DESC, doc_id) <= 20)"""


@query("r2_fuse", _BASE + _SIDES + """
SELECT query_id, id, round(coalesce(text_score, 0) * (1 - 0.95::DOUBLE) + coalesce(sim, 0) * 0.95::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(text_score, 0) * (1 - 0.95::DOUBLE) + coalesce(sim, 0) * 0.95::DOUBLE, 9) DESC, id) AS rank
FROM tl FULL JOIN vl USING (query_id, id) QUALIFY rank <= 10""")
def fuse(t: Tables) -> DataFrame:
    v = R.vector_topk(vectors(t), vector_queries(t), 20, 0.1).select("query_id", "id", "sim")
    return R.fuse(text_list(t), v).withColumn("score", F.round("score", 6))


@query("r3_fuse_text_first", _BASE + _SIDES + """,
f3 AS (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 6) DESC, id) <= 15)
SELECT query_id, id, round(text_score * 0.05 + vtsim * 0.95, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(text_score * (1 - 0.95) + vtsim * 0.95, 9) DESC, id) AS rank
FROM f3 JOIN vt ON vt.query_id = f3.query_id AND vt.doc_id = f3.id WHERE vtsim >= 0.0 QUALIFY rank <= 5""".replace("SELECT query_id, id", "SELECT f3.query_id, id").replace("PARTITION BY query_id ORDER BY round(text_score *", "PARTITION BY f3.query_id ORDER BY round(text_score *"))
def fuse_text_first(t: Tables) -> DataFrame:
    q = vector_queries(t).withColumnRenamed("vec", "qvec")
    text = checkpoint(text_list(t))
    first = R.top_n(text, ["query_id"], [F.round("text_score", 6).desc(), F.asc("id")], 15).drop("rank")
    sims = first.join(q, "query_id").join(vectors(t), "id").select("query_id", "id", W.cosine("qvec", "vec").alias("sim"))
    return R.fuse_text_first(text, sims, 15, 0.95, 0.0, 5).withColumn("score", F.round("score", 6))


@query("r5_scatter_gather", """
SELECT id, score, pagerank, score + pagerank AS total FROM (SELECT doc_id AS id, n_chars::DOUBLE AS score, (doc_id % 3)::DOUBLE AS pagerank FROM documents
UNION ALL SELECT page_id, length(html)::DOUBLE, 0.0 FROM pages) ORDER BY total DESC, id LIMIT 50""")
def scatter_gather(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 3).cast("double").alias("pagerank"))
    b = t.pages.select(F.col("page_id").alias("id"), F.length("html").cast("double").alias("score"), F.lit(0.0).alias("pagerank"))
    return R.scatter_gather([a, b], 50)


_RERANK = _BASE + _WEIGHTS + _CANDIDATES.replace("<= 64", "<= 10") + _KEYS + """,
bag AS (SELECT doc_id, key FROM dk UNION SELECT doc_id, lang FROM documents UNION SELECT doc_id, source FROM documents),
hold AS (SELECT query_id, doc_id, coalesce(sum(w) FILTER (WHERE b.key IS NOT NULL), 0) AS held, sum(w) AS total FROM cand JOIN qk USING (query_id) LEFT JOIN bag b USING (doc_id, key) GROUP BY 1, 2),
vec AS (SELECT c.query_id, c.doc_id, coalesce(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0), 0) AS vtsim
  FROM cand c JOIN embeddings q ON q.vec_id = c.query_id JOIN embeddings e ON e.vec_id = c.doc_id),
mixed AS (SELECT query_id, doc_id, (held + 1e-9) / (total + 1e-9) AS tksim, vtsim, bool_or(vtsim <> 0) OVER (PARTITION BY query_id) AS any_v FROM hold JOIN vec USING (query_id, doc_id))
SELECT query_id, doc_id AS id, round(CASE WHEN any_v THEN 0.3 * tksim + 0.7 * vtsim ELSE tksim END
  + 10 * (2.0 * CASE lang WHEN 'en' THEN 1 ELSE 0 END + 1.0 * (doc_id % 3)) / (sqrt(5.0) * sqrt(1.0 + (doc_id % 3) * (doc_id % 3))) + doc_id % 5, 6) AS sim, round(tksim, 6) AS tksim, round(vtsim, 6) AS vtsim
FROM mixed JOIN documents USING (doc_id)"""


@query("r6_rerank", _RERANK)
def rerank(t: Tables) -> DataFrame:
    """The ten best of each query by text, by tokens, vectors and rank features together."""
    first = text_top(t, 10)
    d = t.documents.select("doc_id", X.tokenize(F.col("text")).alias("content"), F.array("lang").alias("title"), F.array("source").alias("important"), F.array().cast("array<string>").alias("question"),
        F.create_map(F.lit("lang:"), F.lit(0.0), F.col("lang"), F.lit(1.0), F.lit("third"), (F.col("doc_id") % 3).cast("double")).alias("tags"), (F.col("doc_id") % 5).cast("double").alias("pr"))
    cands = first.join(d, "doc_id").join(vectors(t).withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    keys = W.weighted_keys(query_weights(t), "query_id").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "w"))).alias("keys"))
    asked = keys.join(vector_queries(t), "query_id").withColumn("tags", F.create_map(F.lit("en"), F.lit(2.0), F.lit("third"), F.lit(1.0)))
    out = R.rerank(cands, asked)
    return out.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("sim", "tksim", "vtsim")])


@query("r7_rank_features", """
SELECT p_partkey, round(coalesce(10 * (2.0 * p_size + 1.0 * (p_partkey % 3)) / (sqrt(5.0) * nullif(sqrt(p_size * p_size + (p_partkey % 3) * (p_partkey % 3)), 0)), 0) + p_partkey % 7, 6) AS score FROM part""")
def rank_features(t: Tables) -> DataFrame:
    tags = F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), (F.col("p_partkey") % 3).cast("double"))
    asked = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0), F.lit("pagerank_fea"), F.lit(9.0))
    df = t.part.select("p_partkey", tags.alias("tags"), asked.alias("asked"), (F.col("p_partkey") % 7).cast("double").alias("pr"))
    return df.select("p_partkey", F.round(R.rank_feature_scores(df, "tags", "asked", "pr"), 6).alias("score"))


@query("r8_retrieve_above", _BASE + _WEIGHTS + _CANDIDATES + _KEYS + """
SELECT query_id, doc_id AS id, round(round(tksim, 9), 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(tksim, 9) DESC, doc_id) AS rank FROM tk WHERE round(tksim, 9) >= 0.1 QUALIFY rank <= 5""")
def retrieve_above(t: Tables) -> DataFrame:
    scored = token_pairs(t).select("query_id", F.col("doc_id").alias("id"), F.round("tksim", 9).alias("sim"))
    return R.retrieve(scored, 1, 5, threshold=0.1).withColumn("sim", F.round("sim", 6))


@query("r8_retrieve", _BASE + _WEIGHTS + _CANDIDATES + _KEYS + """
SELECT query_id, doc_id AS id, round(round(tksim, 9), 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(tksim, 9) DESC, doc_id) AS rank FROM tk QUALIFY rank BETWEEN 4 AND 6""")
def retrieve(t: Tables) -> DataFrame:
    scored = token_pairs(t).select("query_id", F.col("doc_id").alias("id"), F.round("tksim", 9).alias("sim"))
    return R.retrieve(scored, 2, 3, vw=0.0).withColumn("sim", F.round("sim", 6))


@query("r9_doc_aggs", _BASE + _FULLTEXT + " SELECT query_id, source AS docnm_kwd, count(*) AS count, min(doc_id) AS doc_id FROM m JOIN documents USING (doc_id) GROUP BY 1, 2")
def doc_aggs(t: Tables) -> DataFrame:
    return R.doc_aggs(fulltext(t).join(t.documents.select("doc_id", F.col("source").alias("docnm_kwd")), "doc_id"))


@query("r10_relax", _BASE + _FULLTEXT.replace("0.3 * size", "0.9 * size") + _FULLTEXT.replace("h AS", "h2 AS").replace("m AS", "m2 AS").replace("FROM h ", "FROM h2 ").replace("0.3 * size", "0.1 * size") + """
SELECT query_id, doc_id, round(score, 6) AS score FROM m UNION ALL SELECT query_id, doc_id, round(score, 6) FROM m2 WHERE query_id NOT IN (SELECT query_id FROM m)""")
def relax(t: Tables) -> DataFrame:
    first, second = (W.fulltext_search(doc_tokens(t), query_tokens(t), {"tokens": 2.0}, x) for x in (0.9, 0.1))
    return R.relax(first, query_tokens(t), second).withColumn("score", F.round("score", 6))


@query("r11_lift_to_parent", """
WITH h AS (SELECT o_custkey AS query_id, l_orderkey AS mom, l_linenumber, l_discount AS sim, l_partkey, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT query_id, 'o' || mom AS id, round(avg(sim), 6) AS sim, count(*) AS n FROM h WHERE mom % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT query_id, 'c' || id, round(sim, 6), 1 FROM h WHERE mom % 2 = 1""")
def lift_to_parent(t: Tables) -> DataFrame:
    h = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    even = F.col("l_orderkey") % 2 == 0
    hits = h.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("c"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("id"), F.lit("x").alias("text"), F.col("l_discount").alias("sim"), F.when(even, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("mom_id"))
    parents = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("text"))
    return R.lift_to_parent(hits, parents).select("query_id", "id", F.round("sim", 6).alias("sim"), "n")


@query("r12_boost_sections", """
WITH h AS (SELECT o_custkey AS query_id, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS doc_id, min(l_quantity) AS sim FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY ALL),
b AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, sum(sim) AS s FROM h GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) = 1),
w AS (SELECT DISTINCT b.query_id, l_orderkey * 10 + l_linenumber AS id, b.doc_id FROM lineitem JOIN b ON l_orderkey = b.doc_id WHERE l_linenumber BETWEEN 2 AND 3),
o AS (SELECT query_id, id, doc_id, sim FROM h JOIN b USING (query_id, doc_id))
SELECT query_id, id, doc_id, coalesce(sim, 0) + CASE WHEN w.id IS NOT NULL THEN 100.0 ELSE 0 END AS sim, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sim, 0) + CASE WHEN w.id IS NOT NULL THEN 100.0 ELSE 0 END DESC, id) AS rank
FROM o FULL JOIN w USING (query_id, id, doc_id) QUALIFY rank <= 3""")
def boost_sections(t: Tables) -> DataFrame:
    h = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("sim"), "l_linenumber")
    chunks = h.select("id", "doc_id").distinct()
    hits = h.filter("l_linenumber <= 2").groupBy("query_id", "id", "doc_id").agg(F.min("sim").alias("sim"))
    sections = h.filter("l_linenumber BETWEEN 2 AND 3").select("query_id", "id").distinct()
    return R.boost_sections(hits, sections, chunks, 100.0, 3)


@query("r13_chunk_list", "SELECT l_linenumber AS id, l_partkey FROM lineitem WHERE l_orderkey = 1")
def chunk_list(t: Tables) -> DataFrame:
    return R.chunk_list(line_chunks(t), 1).select("id", "l_partkey")


@query("r13_chunk_lists")
def chunk_lists(t: Tables) -> DataFrame:
    """The lists of all orders."""
    return R.chunk_lists(line_chunks(t)).select("doc_id", "rank", "id", "l_partkey")


def line_chunks(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), "l_partkey", F.array(F.col("l_quantity"), F.lit(1.0)).alias("page_num_int"), F.array("l_tax").alias("top_int"))


@query("r14_list_chunks", "SELECT event_id AS id, user_id % 10 AS chunk_order_int FROM events ORDER BY user_id % 10, user_id, value, ts DESC, event_id LIMIT 30 OFFSET 10")
def list_chunks(t: Tables) -> DataFrame:
    c = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("chunk_order_int"), F.col("user_id").alias("page"), F.col("value").alias("top"), F.col("ts").alias("create_timestamp_flt"))
    return R.list_chunks(c, 10, 30).select("id", "chunk_order_int")


@query("r15_insert_citations", """
WITH e AS (SELECT vec_id // 10 AS answer_id, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.answer_id, a.vec_id AS s, b.vec_id AS c, 0.1 * (a.label IS NOT DISTINCT FROM b.label)::INT + 0.9 * coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) AS sim FROM e a JOIN e b USING (answer_id)),
w AS (SELECT *, max(sim) OVER (PARTITION BY answer_id) AS best, max(sim) OVER (PARTITION BY answer_id, s) AS top FROM p),
g AS (SELECT * FROM w WHERE sim >= CASE WHEN best >= 0.63 THEN 0.63 WHEN best >= 0.504 THEN 0.504 WHEN best >= 0.4032 THEN 0.4032 WHEN best >= 0.32256 THEN 0.32256 END AND sim > 0.99 * top),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY answer_id, c ORDER BY s) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY answer_id, s ORDER BY sim DESC, c) AS n FROM o QUALIFY n <= 4)
SELECT answer_id, s AS sentence_no, string_agg(c, ',' ORDER BY n) AS chunk_ids FROM f GROUP BY 1, 2""")
def insert_citations(t: Tables) -> DataFrame:
    """Neighbouring vectors as sentences and chunks of one answer (ten vectors each)."""
    e = t.embeddings.select((F.col("vec_id") / 10).cast("long").alias("answer_id"), F.col("vec_id"), F.array(F.col("label").cast("string")).alias("tokens"), F.col("embedding").alias("vec"))
    out = R.insert_citations(e.withColumnRenamed("vec_id", "sentence_no"), e.withColumnRenamed("vec_id", "chunk_id"))
    return out.select("answer_id", "sentence_no", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


@query("r16_fit_budget", f"""
WITH x AS (SELECT source AS q, doc_id, {COUNT_SQL} AS tokens FROM documents)
SELECT q, doc_id, tokens, sum(tokens) OVER (PARTITION BY q ORDER BY doc_id) AS running FROM x QUALIFY running <= 0.97 * 20000""")
def fit_budget(t: Tables) -> DataFrame:
    return R.fit_budget(t.documents.select(F.col("source").alias("q"), "doc_id", X.num_tokens(F.col("text")).alias("tokens")), "q", "doc_id", "tokens", 20_000)


@query("r17_fit_conversation", f"""
WITH x AS (SELECT conv_id, turn, {COUNT_SQL} AS tokens FROM conversations),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM x),
k AS (SELECT * FROM y WHERE total < 120 OR a = 1 OR b = 1)
SELECT conv_id, turn, tokens, CASE WHEN total >= 120 AND row_number() OVER (PARTITION BY conv_id ORDER BY tokens DESC, turn) = 1 THEN least(tokens, greatest(120 - (sum(tokens) OVER (PARTITION BY conv_id) - tokens), 0)) ELSE tokens END AS kept_tokens FROM k""")
def fit_conversation(t: Tables) -> DataFrame:
    return R.fit_conversation(t.conversations.select("conv_id", "turn", X.num_tokens(F.col("text")).alias("tokens")), 120)


@query("r18_format_chunks", """
SELECT o_orderkey AS query_id, 1 AS rank, 'ID: 1' || chr(10) || '├── Title: ' || o_orderstatus || chr(10) || '├── nation: ' || c_nationkey || chr(10) || '├── segment: ' || c_mktsegment || chr(10) || '└── Content:' || chr(10) || o_orderpriority AS prompt
FROM orders JOIN customer ON o_custkey = c_custkey""")
def format_chunks(t: Tables) -> DataFrame:
    hits = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("rank"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("text"))
    meta = t.customer.select(F.col("c_custkey").alias("doc_id"), F.explode(F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))).alias("key", "value"))
    return R.format_chunks(hits, meta)


#: A turn's hits are the numbers 0 to 8; it cites its own number, 7 twice and, in vain, 99.
_CITING = "text || ' (ID: ' || turn || ') 【ID:7】 ref8 [ID: 99] REF 7'"


def citing(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = F.concat("text", F.lit(" (ID: "), F.col("turn").cast("string"), F.lit(") 【ID:7】 ref8 [ID: 99] REF 7"))
    answers = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), text.alias("text")).distinct()
    hits = answers.select("answer_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("index")).withColumn("doc_id", F.col("index") * 10)
    return answers, hits, hits.select("answer_id", "doc_id")


@query("r19_repair_citations", f"""
WITH x AS (SELECT DISTINCT conv_id * 1000 + turn AS answer_id, turn, text FROM conversations)
SELECT answer_id, text || CASE WHEN turn <= 8 THEN ' [ID:' || turn || ']' ELSE ' (ID: ' || turn || ')' END || ' [ID:7] [ID:8] [ID: 99] [ID:7]' AS text,
  array_to_string(list_distinct_kept, ',') AS cited FROM (SELECT *, CASE WHEN turn > 8 OR turn = 7 THEN ['7', '8'] WHEN turn = 8 THEN ['8', '7'] ELSE [turn::VARCHAR, '7', '8'] END AS list_distinct_kept FROM x)""")
def repair_citations(t: Tables) -> DataFrame:
    out, _ = R.repair_citations(*citing(t))
    return out.select("answer_id", "text", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


@query("r19_cited_facets", """
WITH x AS (SELECT DISTINCT conv_id * 1000 + turn AS answer_id, turn, text FROM conversations)
SELECT DISTINCT answer_id, d * 10 AS doc_id FROM (SELECT answer_id, unnest(CASE WHEN turn <= 8 THEN [turn, 7, 8] ELSE [7, 8] END) AS d FROM x)""")
def cited_facets(t: Tables) -> DataFrame:
    return R.repair_citations(*citing(t))[1]
