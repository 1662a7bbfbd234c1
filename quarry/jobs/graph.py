"""Queries over entity graphs (G rows): parts of one order are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from ..operators import communities as M
from ..operators import graph as G
from ..registry import Tables, query

# extraction text of an order: its parts as entities, neighbouring lines as relations


def texts(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    entity = F.concat(F.lit('("entity"<|>"p'), F.col("l_partkey").cast("string"), F.lit('"<|>"'), "p_brand", F.lit('"<|>"'), "p_type", F.lit('")'))
    relation = F.concat(F.lit('("relationship"<|>"p'), F.col("l_partkey").cast("string"), F.lit('"<|>"p'), F.lit("1"), F.lit('"<|>"with '), "l_returnflag", F.lit('"<|>"k"<|>'), F.col("l_linenumber").cast("string"), F.lit(")"))
    rows = lines.select("l_orderkey", F.concat_ws("##", entity, relation).alias("x"))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("chunk_key")).agg(F.array_join(F.sort_array(F.collect_list("x")), "##").alias("text"))


_E = """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk_key, 'P' || l_partkey AS name, upper(p_brand) AS type, p_type AS description FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk_key, least('P' || l_partkey, 'P1') AS src, greatest('P' || l_partkey, 'P1') AS dst, 'with ' || l_returnflag AS description, 'k' AS keywords, l_linenumber::DOUBLE AS weight FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("g1_entities", _E + " SELECT * FROM e")
def entities(t: Tables) -> DataFrame:
    return G.parse_extractions(texts(t))[0]


@query("g1_relations", _E + " SELECT * FROM r")
def relations(t: Tables) -> DataFrame:
    return G.parse_extractions(texts(t))[1]


@query("g2_merge_entities", _E + """,
k AS (SELECT name, type FROM (SELECT name, type, count(*) AS n FROM e GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, type) = 1)
SELECT name, any_value(k.type) AS type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT chunk_key) AS sources FROM e JOIN k USING (name) GROUP BY 1""")
def merge_entities(t: Tables) -> DataFrame:
    return G.merge_entities(entities(t)).select("name", "type", "description", F.size("source_id").alias("sources"))


@query("g3_merge_relations", _E + " SELECT src, dst, sum(weight) AS weight, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, count(DISTINCT chunk_key) AS sources FROM r GROUP BY 1, 2")
def merge_relations(t: Tables) -> DataFrame:
    return G.merge_relations(relations(t)).select("src", "dst", "weight", "description", F.size("source_id").alias("sources"))


@query("g4_summarize_descriptions", _E + """, m AS (SELECT src, dst, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS d FROM r GROUP BY 1, 2)
SELECT src, dst, CASE WHEN length(d) - length(replace(d, '<SEP>', '')) >= 10 THEN d[1:20] ELSE d END AS description FROM m""")
def summarize_descriptions(t: Tables) -> DataFrame:
    out = G.summarize_descriptions(G.merge_relations(relations(t)), lambda x: x[:20], most_parts=2)
    return out.select("src", "dst", "description")


# the graph of parts that share an order


def part_edges(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"))
    b = a.withColumnRenamed("src", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))).alias("source_id"))


def members(t: Tables) -> DataFrame:
    """(group, name): the parts of each order, by number."""
    return t.lineitem.select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("name"))


def part_nodes(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("type"), F.col("p_name").alias("description"), F.array(F.col("p_type")).alias("source_id"))


_EDGES = """WITH l AS (SELECT l_orderkey, 'P' || l_partkey AS p FROM lineitem), e AS (SELECT a.p AS src, b.p AS dst, count(*)::DOUBLE AS weight FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY 1, 2)"""


@query("g5_drop_dangling", _EDGES + ", n AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_partkey % 3 <> 0) SELECT * FROM e WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def drop_dangling(t: Tables) -> DataFrame:
    nodes = t.part.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    return G.drop_dangling(part_edges(t), nodes).select("src", "dst", "weight")


@query("g6_tidy_graph", _EDGES + ", n AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_partkey % 10 <> 0) SELECT src, dst FROM e WHERE weight > 1 AND src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)")
def tidy_graph(t: Tables) -> DataFrame:
    nodes = part_nodes(t).withColumn("description", F.when(F.expr("CAST(substring(name, 2) AS INT) % 10 <> 0"), F.col("description")))
    edges = part_edges(t).withColumn("description", F.when(F.col("weight") > 1, "d")).withColumn("keywords", F.lit(None).cast("array<string>"))
    return G.tidy_graph(nodes, edges)[1].select("src", "dst")


@query("g7_merge_graphs", _EDGES + ", d AS (SELECT p AS name, count(*) AS rank FROM (SELECT src AS p FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT 'P' || p_partkey AS name, p_brand AS type, p_name || '<SEP>new' AS description, coalesce(rank, 0) AS rank FROM part LEFT JOIN d ON d.name = 'P' || p_partkey")
def merge_graphs(t: Tables) -> DataFrame:
    n, e = part_nodes(t), part_edges(t).withColumn("description", F.lit("e"))
    return G.merge_graphs([n, n.withColumn("description", F.lit("new"))], [e, e])[0].select("name", "type", "description", "rank")


@query("g8_rebuild", "WITH x AS (SELECT DISTINCT 'P' || l_partkey AS name, l_returnflag AS f FROM lineitem) SELECT name, count(*) AS n FROM x WHERE f <> 'R' GROUP BY 1")
def rebuild(t: Tables) -> DataFrame:
    nodes = t.lineitem.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")).agg(F.collect_set("l_returnflag").alias("source_id"))
    return G.rebuild(nodes, part_edges(t), ["R"])[0].select("name", F.size("source_id").alias("n"))


@query("g7_merge_edges", _EDGES + " SELECT src, dst, 2 * weight AS weight, 'e<SEP>f' AS description FROM e")
def merge_edges(t: Tables) -> DataFrame:
    n, e = part_nodes(t), part_edges(t).withColumn("description", F.lit("e"))
    return G.merge_graphs([n, n], [e, e.withColumn("description", F.lit("f"))])[1].select("src", "dst", "weight", "description")


@query("g8_rebuild_edges", """WITH x AS (SELECT DISTINCT 'P' || l_partkey AS name, l_returnflag AS f FROM lineitem), k AS (SELECT DISTINCT name FROM x WHERE f <> 'R'),
l AS (SELECT l_orderkey, 'P' || l_partkey AS p, l_returnflag AS f FROM lineitem), e AS (SELECT DISTINCT a.p AS src, b.p AS dst, a.f FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p < b.p)
SELECT src, dst, count(*) AS n FROM e WHERE f <> 'R' AND src IN (FROM k) AND dst IN (FROM k) GROUP BY 1, 2""")
def rebuild_edges(t: Tables) -> DataFrame:
    """Edges have the flag of the first of both lines as their source."""
    a = t.lineitem.select("l_orderkey", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"), "l_returnflag")
    edges = a.join(a.select("l_orderkey", F.col("src").alias("dst")), "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.collect_set("l_returnflag").alias("source_id"))
    nodes = a.groupBy(F.col("src").alias("name")).agg(F.collect_set("l_returnflag").alias("source_id"))
    return G.rebuild(nodes, edges, ["R"])[1].select("src", "dst", F.size("source_id").alias("n"))


@query("g6_tidy_nodes", "SELECT 'P' || p_partkey AS name FROM part WHERE p_partkey % 10 <> 0")
def tidy_nodes(t: Tables) -> DataFrame:
    nodes = part_nodes(t).withColumn("description", F.when(F.expr("CAST(substring(name, 2) AS INT) % 10 <> 0"), F.col("description")))
    edges = part_edges(t).withColumn("description", F.lit("d")).withColumn("keywords", F.lit(None).cast("array<string>"))
    return G.tidy_graph(nodes, edges)[0].select("name")


@query("g12_merged_nodes", """WITH m AS (SELECT 'P' || p_partkey AS name, (p_partkey - p_partkey % 4) AS g, p_brand, p_name FROM part)
SELECT min(name) AS name, arg_min(p_brand, name) AS type, count(*) AS n FROM m GROUP BY g""")
def merged_nodes(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    pairs = t.part.filter(key % 4 != 0).select(name(key).alias("a"), name(key - key % 4).alias("b"))
    nodes = part_nodes(t).withColumn("description", F.col("name"))
    return G.apply_merges(nodes, part_edges(t), pairs)[0].select("name", "type", F.size(F.split("description", "<SEP>")).alias("n"))


@query("g8_subgraphs", "SELECT DISTINCT l_returnflag AS doc, 'P' || l_partkey AS name FROM lineitem")
def subgraphs(t: Tables) -> DataFrame:
    nodes = t.lineitem.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")).agg(F.collect_set("l_returnflag").alias("source_id"))
    return G.subgraphs(nodes).select("doc", "name")


def _pagerank_sql(rounds: int) -> str:
    """So many rounds, each a table of its own."""
    step = """, c{k} AS MATERIALIZED (SELECT s.dst AS name, sum(s.share * p.r) AS got FROM sh s JOIN p{j} p ON p.name = s.src GROUP BY 1),
p{k} AS MATERIALIZED (SELECT p.name, p.dangling, 0.15 / nn.n + 0.85 * (coalesce(c.got, 0) + lost / nn.n) AS r FROM p{j} p LEFT JOIN c{k} c ON c.name = p.name, nn, (SELECT coalesce(sum(r) FILTER (WHERE dangling), 0) AS lost FROM p{j}))"""
    start = _EDGES + """, b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), o AS (SELECT src, sum(weight) AS w FROM b GROUP BY 1),
sh AS MATERIALIZED (SELECT b.src, b.dst, b.weight / o.w AS share FROM b JOIN o ON b.src = o.src), nn AS (SELECT count(*) AS n FROM part),
p0 AS (SELECT 'P' || p_partkey AS name, o.w IS NULL AS dangling, 1.0::DOUBLE / nn.n AS r FROM part LEFT JOIN o ON o.src = 'P' || p_partkey, nn)"""
    return start + "".join(step.format(k=k, j=k - 1) for k in range(1, rounds + 1)) + f" SELECT name, round(r, 8) AS pagerank FROM p{rounds}"


@query("g9_pagerank_rounds", _pagerank_sql(8))
def pagerank_rounds(t: Tables) -> DataFrame:
    """Eight rounds, whether or not that is enough."""
    return ranks(t, tolerance=0.0, rounds=8)


def ranks(t: Tables, **how) -> DataFrame:
    """Parts by number, named last."""
    found = G.group_pagerank(t.part.select(F.col("p_partkey").alias("name")), members(t), **how)
    return found.select(F.concat(F.lit("P"), F.col("name").cast("string")).alias("name"), F.round("pagerank", 8).alias("pagerank"))


@query("g9_pagerank")
def pagerank(t: Tables) -> DataFrame:
    return ranks(t)


#: Names of customers: letters, letters with accents, and names with digits, by turns.
_NAMED = "CASE c_custkey % 3 WHEN 0 THEN translate(right(c_name, 6), '0123456789', 'abcdefghij') WHEN 1 THEN translate(right(c_name, 5), '0123456789', 'éèàùçñöüßø') || right(c_mktsegment, 2) ELSE right(c_name, 4) || 'x' END"


@query("g10_entity_candidates", f"""
WITH c AS (SELECT DISTINCT {_NAMED} AS name, c_mktsegment AS type FROM customer), w AS (SELECT DISTINCT {_NAMED} AS name FROM customer WHERE c_custkey % 5 = 0),
d AS (SELECT name, type, name IN (FROM w) AS is_new, length(name) AS n, regexp_full_match(name, '[\\x00-\\x7F]*') AS e, list_distinct(string_split(name, '')) AS s, list_distinct(list_transform(range(1, greatest(length(name), 2)), lambda i: name[i:i+1])) AS g FROM c),
p AS (SELECT a.name AS a, b.name AS b, a.e AND b.e AS english, levenshtein(a.name, b.name) <= least(a.n, b.n) // 2 AS near, len(list_intersect(a.s, b.s)) AS shared, greatest(len(a.s), len(b.s)) AS most,
  len(list_filter(list_concat(list_filter(a.g, lambda x: NOT list_contains(b.g, x)), list_filter(b.g, lambda x: NOT list_contains(a.g, x))), lambda x: regexp_matches(x, '[0-9]'))) > 0 AS digit
  FROM d a JOIN d b ON a.type = b.type AND a.name < b.name AND (a.is_new OR b.is_new))
SELECT DISTINCT a, b FROM p WHERE NOT digit AND CASE WHEN english THEN near WHEN most < 4 THEN shared > 1 ELSE shared / most >= 0.8 END""")
def entity_candidates(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.translate(F.right("c_name", F.lit(6)), "0123456789", "abcdefghij")).when(k == 1, F.concat(F.translate(F.right("c_name", F.lit(5)), "0123456789", "éèàùçñöüßø"), F.right("c_mktsegment", F.lit(2)))).otherwise(F.concat(F.right("c_name", F.lit(4)), F.lit("x")))
    nodes = t.customer.select(name.alias("name"), F.col("c_mktsegment").alias("type")).distinct()
    return G.entity_candidates(nodes, t.customer.filter("c_custkey % 5 = 0").select(name.alias("name")))


@query("g11_parse_verdicts", "SELECT 'c' || c_custkey AS a, 'd' || c_custkey AS b FROM customer WHERE c_nationkey % 2 = 0")
def parse_verdicts(t: Tables) -> DataFrame:
    pairs = t.customer.select(F.col("c_custkey").alias("n"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("b"))
    said = t.customer.select(F.concat(F.lit("pair <|"), F.col("c_custkey").cast("string"), F.lit("|> &&"), F.when(F.col("c_nationkey") % 2 == 0, "Yes").otherwise("No"), F.lit("&&##")).alias("text"))
    return G.parse_verdicts(said, pairs)


@query("g12_apply_merges", _EDGES + """, m AS (SELECT 'P' || p_partkey AS name, (p_partkey - p_partkey % 4) AS g FROM part), t AS (SELECT name, min(name) OVER (PARTITION BY g) AS root FROM m),
x AS (SELECT least(a.root, b.root) AS src, greatest(a.root, b.root) AS dst, weight FROM e JOIN t a ON a.name = src JOIN t b ON b.name = dst WHERE a.root <> b.root) SELECT src, dst, sum(weight) AS weight FROM x GROUP BY 1, 2""")
def apply_merges(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    first = F.greatest(key - key % 4, F.lit(1))
    pairs = t.part.filter(key != first).select(name(key).alias("a"), name(first).alias("b"))
    return G.apply_merges(part_nodes(t), part_edges(t), pairs)[1]


def _least_sql(edges: str, rounds: int = 14) -> str:
    """``lab`` (name, component): so many rounds of taking the least name next to one; more than any path here is long."""
    step = ", m{k} AS MATERIALIZED (SELECT b.src AS name, least(any_value(p.c), min(q.c)) AS c FROM bb b JOIN m{j} p ON p.name = b.src JOIN m{j} q ON q.name = b.dst GROUP BY 1)"
    start = edges + ", bb AS MATERIALIZED (SELECT src, dst FROM ee UNION SELECT dst, src FROM ee), m0 AS (SELECT DISTINCT src AS name, src AS c FROM bb)"
    return start + "".join(step.format(k=k, j=k - 1) for k in range(1, rounds + 1)) + f", lab AS (SELECT name, c AS component FROM m{rounds})"


@query("g13_largest_component", _least_sql(_EDGES + ", ee AS (SELECT src, dst FROM e)") + """
SELECT upper(name) AS name FROM lab WHERE component = (SELECT component FROM lab GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""")
def largest_component(t: Tables) -> DataFrame:
    found = G.largest_component(t.part.select(F.col("p_partkey").alias("name")), G.group_links(members(t)))
    return found.select(F.concat(F.lit("P"), "name").alias("name"))


@query("g13_components", _least_sql("WITH ee AS (SELECT DISTINCT 'C' || o_custkey AS src, 'P' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)") + " SELECT name, component FROM lab")
def components(t: Tables) -> DataFrame:
    """Customers and the parts they ordered, over all orders."""
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return G.components(bought.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst")))


@query("g14_communities")
def communities(t: Tables) -> DataFrame:
    edges = part_edges(t).select("src", "dst", "weight")
    return M.communities(edges, G.degrees(edges)).withColumn("weight", F.round("weight", 6))


@query("g15_community_context", _EDGES + """, m AS (SELECT 'P' || p_partkey AS name, p_brand AS community FROM part)
SELECT community, 'entity' AS kind, name AS a, '' AS b FROM m WHERE community IN (SELECT community FROM m GROUP BY 1 HAVING count(*) >= 2)
UNION ALL SELECT a.community, 'relation', src, dst FROM e JOIN m a ON a.name = src JOIN m b ON b.name = dst WHERE a.community = b.community""")
def community_context(t: Tables) -> DataFrame:
    members = part_nodes(t).select("name", F.col("type").alias("community"))
    return G.community_context(members, part_nodes(t).select("name", "description"), part_edges(t).select("src", "dst", "weight")).drop("description")


@query("g15_community_reports", "SELECT p_partkey AS community, p_name AS title, p_size::DOUBLE AS rating FROM part WHERE p_partkey % 4 <> 0")
def community_reports(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct(F.col("p_name").alias("title"), F.lit("s").alias("summary"), F.col("p_size").cast("double").alias("rating"), F.lit("e").alias("rating_explanation"), F.array(F.struct(F.lit("a").alias("summary"), F.lit("b").alias("explanation"))).alias("findings")))
    df = t.part.select(F.col("p_partkey").alias("community"), F.when(F.col("p_partkey") % 4 == 0, F.lit('{"title": "x"}')).otherwise(whole).alias("json"))
    return G.community_reports(df).select("community", "title", "rating")


@query("g16_graph_retrieve_entities", """
SELECT o_custkey AS query_id, 'P' || l_partkey AS name, round(sim * CASE WHEN p_brand = 'Brand#12' THEN 2 ELSE 1 END * p_retailprice / 1000, 6) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY sim * CASE WHEN p_brand = 'Brand#12' THEN 2 ELSE 1 END * (p_retailprice / 1000) DESC, 'P' || l_partkey) AS rank
FROM (SELECT o_custkey, l_partkey, max(l_quantity) AS sim FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey QUALIFY rank <= 6""")
def graph_retrieve_entities(t: Tables) -> DataFrame:
    return _retrieve(t)[0].withColumn("score", F.round("score", 6))


@query("g16_graph_retrieve_relations")
def graph_retrieve_relations(t: Tables) -> DataFrame:
    return _retrieve(t)[1].withColumn("score", F.round("score", 6))


def _retrieve(t: Tables) -> tuple[DataFrame, DataFrame]:
    hit = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("query_id"), "l_partkey").agg(F.max("l_quantity").alias("sim"))
    hit = written(hit)
    found = hit.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("query_id", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.col("p_brand").alias("type"), "sim", (F.col("p_retailprice") / 1000).alias("pagerank"))
    types = found.select("query_id", F.lit("Brand#12").alias("type")).distinct()
    one = lambda c: F.concat(F.lit("P"), c.cast("string"))
    relations = hit.select("query_id", F.least(one(F.col("l_partkey")), one(F.col("l_partkey") + 1)).alias("src"), F.greatest(one(F.col("l_partkey")), one(F.col("l_partkey") + 1)).alias("dst"), (F.col("sim") / 100).alias("sim"))
    paths = hit.select("query_id", one(F.col("l_partkey")).alias("name"), F.array(one(F.col("l_partkey")), one(F.col("l_partkey") + 1), one(F.col("l_partkey") + 2)).alias("names"))
    return G.graph_retrieve(found, types, relations, paths)


@query("g17_community_lookup", """
WITH h AS (SELECT DISTINCT o_custkey AS query_id, p_brand AS report, w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN (SELECT p_brand, count(*) AS w FROM part GROUP BY 1) USING (p_brand))
SELECT query_id, report, w AS weight, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, report) AS rank FROM h QUALIFY rank <= 2""")
def community_lookup(t: Tables) -> DataFrame:
    reports = t.part.groupBy(F.col("p_brand").alias("report")).agg(F.count(F.lit(1)).alias("weight"), F.collect_list("p_partkey").alias("names"))
    asked = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("name"))
    return G.community_lookup(reports, asked, 2)


@query("g18_type_samples", "SELECT p_brand AS type, string_agg(n, ',' ORDER BY r) AS names FROM (SELECT p_brand, 'P' || p_partkey AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, 'P' || p_partkey) AS r FROM part) WHERE r <= 3 GROUP BY 1")
def type_samples(t: Tables) -> DataFrame:
    nodes = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("rank"))
    return G.type_samples(nodes).select("type", F.array_join("names", ",").alias("names"))


@query("g19_n_hop_paths", _EDGES + """, b AS (SELECT src, dst, weight FROM e WHERE weight > 1 UNION ALL SELECT dst, src, weight FROM e WHERE weight > 1)
SELECT src || '-' || dst AS path, weight FROM b UNION ALL SELECT a.src || '-' || a.dst || '-' || c.dst, a.weight + c.weight FROM b a JOIN b c ON a.dst = c.src WHERE a.src <> c.dst""")
def n_hop_paths(t: Tables) -> DataFrame:
    return G.n_hop_paths(part_edges(t).filter("weight > 1")).select(F.array_join("names", "-").alias("path"), "weight")


@query("g19_n_hop_paths_all")
def n_hop_paths_all(t: Tables) -> DataFrame:
    """Edges of every weight; the paths are as many as the squares of the degrees."""
    return G.n_hop_paths(part_pairs(t)).select(F.concat(F.lit("P"), F.array_join(F.col("names").cast("array<string>"), "-P")).alias("path"), "weight")


def part_pairs(t: Tables) -> DataFrame:
    """Edges by the parts' numbers, which take less room than names while they move."""
    a = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("src"))
    pairs = a.join(a.withColumnRenamed("src", "dst"), "l_orderkey").filter("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("g20_cluster_tree")
def cluster_tree(t: Tables) -> DataFrame:
    """Twenty neighbouring vectors are the chunks of one document."""
    chunks = t.embeddings.select((F.col("vec_id") / 20).cast("long").alias("doc_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return G.cluster_tree(chunks).select("doc_id", "layer", "cluster", F.array_join("members", ",").alias("members"))
