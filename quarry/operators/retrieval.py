"""Retrieval: exact vector search, fusion, reranking, paging, parents, sections, listings, budgets, citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import running_total
from ..functions.weights import cosine, hybrid_similarity
from ..lineage import checkpoint


#: Bytes of vectors that a task holds while it packs them.
HELD = 2**26


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one, or zero."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class _Best:
    """The ``k`` best ids of each of ``names`` so far, by similarity to nine places and then by id."""

    def __init__(self, names: np.ndarray, k: int, min_sim: float) -> None:
        self.names, self.k, self.min_sim = names, k, min_sim
        self.at, self.id, self.sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bound = np.full(len(names), -np.inf)

    def take(self, where: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """``sims`` of the vectors ``ids`` (rows) with the queries at ``where`` (columns)."""
        least = self.bound[where]
        if len(ids) > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(sims, -self.k, axis=0)[-self.k])
        i, j = np.nonzero((sims >= least - 1e-9) & (sims >= self.min_sim))  # all that are as good to nine places
        at, id_, sim = np.concatenate([self.at, where[j]]), np.concatenate([self.id, ids[i]]), np.concatenate([self.sim, sims[i, j]])
        order = np.lexsort((id_, -np.round(sim, 9), at))
        at, id_, sim = at[order], id_[order], sim[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.at, self.id, self.sim = at[kept], id_[kept], sim[kept]
        last = rank == self.k - 1
        self.bound[at[last]] = sim[last]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.names[self.at], "id": self.id, "sim": self.sim})


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, min_sim: float, block: int = 4096, pivots: int = 256) -> DataFrame:
    """(query_id, id, sim, rank): the ``k`` most similar vectors of each query (query_id, vec) at ``min_sim`` or more, by exact
    cosine to nine places and then by id; a zero vector's is 0, and rows without a vector are left out.

    Up to ``block`` queries go to every task, which keeps its own best k, in one pass over the vectors. More are dealt out with the
    vectors: see ``_celled_topk``."""
    rows, asked = chunks.select("id", "vec").filter("vec IS NOT NULL"), queries.select("query_id", "vec").filter("vec IS NOT NULL")
    first = asked.limit(block + 1).toPandas()  # ``block`` at most are used
    if len(first) > block:
        found = _celled_topk(rows, asked, k, min_sim, min(block, 1024), pivots)
    elif not len(first):
        found = rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim")).filter("false")
    else:
        shared = chunks.sparkSession.sparkContext.broadcast((first["query_id"].to_numpy(), _unit(first["vec"])))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            held, every = _Best(names, k, min_sim), np.arange(len(names))
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    some = batch.iloc[at : at + 1024]
                    held.take(every, some["id"].to_numpy(), _unit(some["vec"]) @ q.T)
            yield held.rows()

        found = rows.mapInPandas(best, "query_id long, id long, sim double")
    return top_n(found, ["query_id"], [F.round("sim", 9).desc(), F.asc("id")], k)


def _celled_topk(rows: DataFrame, asked: DataFrame, k: int, min_sim: float, block: int, pivots: int) -> DataFrame:
    """(query_id, id, sim): the best k and perhaps more, with both sides dealt to tasks.

    Both sides lie in cells about ``pivots`` of the vectors and are packed into blocks of up to ``block`` vectors of a cell. A
    task takes some blocks of queries and all blocks of some part of the vectors, two blocks at a time, so what it holds does not
    grow with the tables and no vector is copied for each query. The k-th best so far bounds the rest: a block whose pivot is
    further from a query than its widest angle and the bound's together holds nothing better. Only pivots come to the driver."""
    spark = rows.sparkSession
    centre = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    if not len(centre):
        return rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim")).filter("false")
    shared = spark.sparkContext.broadcast(_unit(centre["vec"]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def angles(m: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(m @ shared.value.T, -1, 1))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of cells that have ``block`` vectors in the task, and those left at its end."""
        held: dict[int, list] = {}
        size = 0

        def packed(cell: int) -> pd.DataFrame:
            ids, points, far = (np.concatenate(x) for x in zip(*held.pop(cell), strict=True))
            at = range(0, len(ids), block)
            return pd.DataFrame({"cell": cell, "width": [far[i : i + block].max() for i in at], "ids": [ids[i : i + block].tobytes() for i in at], "points": [points[i : i + block].tobytes() for i in at]})

        for batch in batches:
            m, ids = _unit(batch["vec"]), batch["id"].to_numpy(np.int64)
            far = angles(m)
            cell = far.argmin(axis=1)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                held.setdefault(c, []).append((ids[at], m[at], far[at, c]))
                size += m[at].nbytes
                if sum(len(x[0]) for x in held[c]) >= block:
                    size -= sum(x[1].nbytes for x in held[c])
                    yield packed(c)
            while size > HELD:
                c = max(held, key=lambda c: sum(len(x[0]) for x in held[c]))
                size -= sum(x[1].nbytes for x in held[c])
                yield packed(c)
        small = sorted(held)
        while small:  # what is left of cells goes together, under the pivot of the first
            some, n = [], 0
            while small and n < block:
                some.append(small.pop())
                n += sum(len(x[0]) for x in held[some[-1]])
            every = [x for c in some for x in held.pop(c)]
            held[some[0]] = [(ids, m, np.arccos(np.clip(m @ shared.value[some[0]], -1, 1))) for ids, m, _ in every]
            yield packed(some[0])

    def blocks(df: DataFrame, n: int) -> DataFrame:
        return checkpoint(df.mapInPandas(pack, "cell int, width double, ids binary, points binary")).repartition(n)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, q, far = None, None, None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.asked != now:
                    if held is not None:
                        yield held.rows()
                    now, names = r.asked, np.frombuffer(r.asked, np.int64)
                    held, q = _Best(names, k, min_sim), np.frombuffer(r.vectors, np.float64).reshape(len(names), -1)
                    far, none = angles(q), ~q.any(axis=1)
                # a hair more, for what rounding does to angles
                reach = np.arccos(np.clip(np.maximum(held.bound, min_sim) - 2e-9, -1, 1)) + 1e-6
                where = np.flatnonzero((far[:, r.cell] - r.width <= reach) | none)
                if len(where):
                    ids = np.frombuffer(r.ids, np.int64)
                    held.take(where, ids, np.frombuffer(r.points, np.float64).reshape(len(ids), -1) @ q[where].T)
        if held is not None:
            yield held.rows()

    mine = blocks(asked.withColumnRenamed("query_id", "id"), parts).select(F.col("ids").alias("asked"), F.col("points").alias("vectors"))
    return mine.crossJoin(blocks(rows, max(1, parts // 8))).mapInPandas(compare, "query_id long, id long, sim double")


def fuse(text: DataFrame, vectors: DataFrame, w: float = 0.95, topn: int = 10, pagerank: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of text (query_id, id, text_score) and vector (query_id, id, sim) lists; a missing
    side counts as 0, pagerank (id, pagerank) adds a hundredth of itself. Scores equal to nine places go by id."""
    both = text.join(vectors, ["query_id", "id"], "full_outer")
    if pagerank is not None:
        both = both.join(pagerank, "id", "left")
    bonus = F.coalesce(F.col("pagerank") / 100, F.lit(0.0)) if pagerank is not None else F.lit(0.0)
    score = F.coalesce("text_score", F.lit(0.0)) * (1 - w) + F.coalesce("sim", F.lit(0.0)) * w + bonus
    return top_n(both.withColumn("score", score), ["query_id"], [F.round("score", 9).desc(), F.asc("id")], topn).select("query_id", "id", "score", "rank")


def fuse_text_first(text: DataFrame, sims: DataFrame, k: int, w: float, min_sim: float, topn: int) -> DataFrame:
    """The best ``k`` by text, to six places, then only those similar enough, by the weighted sum, to nine."""
    first = top_n(text, ["query_id"], [F.round("text_score", 6).desc(), F.asc("id")], k).drop("rank")
    both = first.join(sims, ["query_id", "id"]).filter(F.col("sim") >= min_sim)
    return top_n(both.withColumn("score", F.col("text_score") * (1 - w) + F.col("sim") * w), ["query_id"], [F.round("score", 9).desc(), F.asc("id")], topn).select("query_id", "id", "score", "rank")


def normalize_weights(fields: dict[str, float]) -> dict[str, float]:
    total = sum(fields.values())
    return {k: v / total if total else 1 / len(fields) for k, v in fields.items()}


def scatter_gather(frames: list[DataFrame], limit: int) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("total", F.col("score") + F.col("pagerank")).orderBy(F.desc("total"), "id").limit(limit)


def rerank_tokens(content: str, title: str, important: str, question: str) -> Column:
    """Distinct content, then title twice, important words five and questions six times."""
    again = lambda c, n: F.flatten(F.array_repeat(F.col(c), n))
    return F.concat(F.array_distinct(content), again(title, 2), again(important, 5), again(question, 6))


def rerank(cands: DataFrame, asked: DataFrame, tw: float = 0.3, vw: float = 0.7) -> DataFrame:
    """(query_id, id, sim, tksim, vtsim): candidates (query_id, id, content, title, important, question, vec, tags, pr)
    scored by tokens and vectors, plus their rank features. ``asked`` (query_id, keys, vec, tags): a query's weighted keys
    (a map), vector and tag weights. The token side is the share of the query's key weight that the bag of the candidate
    holds: its distinct content, and title, important words and questions as often as they count."""
    q = asked.select("query_id", F.col("keys").alias("_keys"), F.col("vec").alias("_vec"), F.col("tags").alias("_tags"))
    bag = F.array_distinct(rerank_tokens("content", "title", "important", "question"))
    both = cands.join(q, "query_id").withColumn("_bag", bag)
    pairs = F.transform(F.sequence(F.lit(1), F.size("content") - 1), lambda i: F.concat_ws(" ", F.element_at("content", i), F.element_at("content", i + 1)))
    both = both.withColumn("_bag", F.when(F.size("content") > 1, F.array_union("_bag", pairs)).otherwise(F.col("_bag")))
    total = F.aggregate(F.map_values("_keys"), F.lit(0.0), lambda s, x: s + x)
    held = F.aggregate(F.array_intersect(F.map_keys("_keys"), "_bag"), F.lit(0.0), lambda s, k: s + F.element_at("_keys", k))
    scored = both.withColumn("tksim", (held + 1e-9) / (total + 1e-9)).withColumn("vtsim", cosine("_vec", "vec"))
    mixed = hybrid_similarity(scored, "query_id", tw, vw)
    return mixed.select("query_id", "id", (F.col("sim") + rank_feature_scores(mixed, "tags", "_tags", "pr")).alias("sim"), "tksim", "vtsim")


def rank_feature_scores(cands: DataFrame, tags: str, query_tags: str, pagerank: str) -> Column:
    """Ten cosines of tag maps, plus pagerank; without common ground pagerank alone."""
    q = F.map_filter(query_tags, lambda k, v: k != "pagerank_fea")
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    common = F.aggregate(F.map_entries(q), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(F.col(tags), e["key"]), F.lit(0.0)))
    size = norm(q) * norm(F.col(tags))
    return F.coalesce(F.when(size > 0, 10 * common / size), F.lit(0.0)) + F.coalesce(F.col(pagerank), F.lit(0.0))


def candidate_window(page_size: int, external: bool = False, top: int = 1024) -> int:
    window = max(30, -(-64 // page_size) * page_size) if page_size > 1 else 30
    return min(window, top, 64) if external else window


def retrieve(scored: DataFrame, page: int, page_size: int, threshold: float = 0.2, vw: float = 0.3, doc_filter: bool = False) -> DataFrame:
    """One page of candidates (query_id, id, sim): above the threshold (none if vectors don't weigh or documents are
    given), best first."""
    least = 0.0 if vw <= 0 or doc_filter else threshold
    kept = scored.filter(F.col("sim") >= least)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")))
    return ranked.filter(F.col("rank").between((page - 1) * page_size + 1, page * page_size))


def doc_aggs(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "docnm_kwd").agg(F.count(F.lit(1)).alias("count"), F.min("doc_id").alias("doc_id"))


def relax(first: DataFrame, queries: DataFrame, second: DataFrame) -> DataFrame:
    """``second`` answers the queries for which ``first`` found nothing."""
    unanswered = queries.select("query_id").join(first, "query_id", "left_anti")
    return first.unionByName(second.join(unanswered, "query_id", "left_semi"))


def lift_to_parent(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of a parent become it, at their mean similarity; the others stay. (query_id, id, text, sim, n)"""
    alone = hits.filter("mom_id IS NULL").select("query_id", "id", "text", "sim", F.lit(1).cast("long").alias("n"))
    grouped = hits.filter("mom_id IS NOT NULL").groupBy("query_id", "mom_id").agg(F.avg("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
    lifted = grouped.join(parents.select(F.col("id").alias("mom_id"), "text"), "mom_id").select("query_id", F.col("mom_id").alias("id"), "text", "sim", "n")
    return alone.union(lifted)


def boost_sections(hits: DataFrame, sections: DataFrame, chunks: DataFrame, boost: float, topn: int) -> DataFrame:
    """In each query's best document by summed similarity, sections (query_id, id) gain ``boost`` or come in with it."""
    by_doc = hits.groupBy("query_id", "doc_id").agg(F.sum("sim").alias("total"))
    best = by_doc.groupBy("query_id").agg(F.max_by("doc_id", F.struct("total", -F.col("doc_id"))).alias("doc_id"))
    own = hits.join(best, ["query_id", "doc_id"])
    wanted = sections.join(chunks.select("id", "doc_id"), "id").join(best, ["query_id", "doc_id"]).select("query_id", "id", "doc_id", F.lit(boost).alias("_gain"))
    both = own.select("query_id", "id", "doc_id", "sim").join(wanted, ["query_id", "id", "doc_id"], "full_outer")
    return top_n(both.withColumn("sim", F.coalesce("sim", F.lit(0.0)) + F.coalesce("_gain", F.lit(0.0))), ["query_id"], [F.desc("sim"), F.asc("id")], topn).select("query_id", "id", "doc_id", "sim", "rank")


def chunk_list(chunks: DataFrame, doc_id, limit: int = 1024) -> DataFrame:
    """A document's chunks by mean page, mean top and id."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return chunks.filter(F.col("doc_id") == doc_id).orderBy(mean("page_num_int"), mean("top_int"), "id").limit(limit)


def chunk_lists(chunks: DataFrame, limit: int = 1024) -> DataFrame:
    """The list of every document, with ``rank`` in it."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return top_n(chunks, ["doc_id"], [mean("page_num_int"), mean("top_int"), F.col("id")], limit)


def list_chunks(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    return chunks.orderBy("chunk_order_int", "page", "top", F.desc("create_timestamp_flt"), "id").offset(offset).limit(limit)


def fit_budget(df: DataFrame, by: str, rank: str, tokens: str, max_tokens: int) -> DataFrame:
    """Rows in order of rank while their running tokens stay within 97 % of the budget."""
    return running_total(df, [by], [F.col(rank)], F.col(tokens), "running").filter(F.col("running") <= 0.97 * max_tokens)


def fit_conversation(turns: DataFrame, max_tokens: int) -> DataFrame:
    """All turns of a conversation under the budget; else its first and last, the longer of the two cut to what is left."""
    w = Window.partitionBy("conv_id")
    marked = turns.withColumn("_total", F.sum("tokens").over(w)).withColumn("_first", F.row_number().over(w.orderBy("turn"))).withColumn("_last", F.row_number().over(w.orderBy(F.desc("turn"))))
    kept = marked.filter((F.col("_total") < max_tokens) | (F.col("_first") == 1) | (F.col("_last") == 1))
    other = F.sum("tokens").over(w) - F.col("tokens")
    room = F.greatest(max_tokens - other, F.lit(0))
    longest = F.row_number().over(w.orderBy(F.desc("tokens"), "turn")) == 1
    over = F.col("_total") >= max_tokens
    return kept.withColumn("kept_tokens", F.when(over & longest, F.least("tokens", room)).otherwise(F.col("tokens"))).drop("_total", "_first", "_last")


def format_chunks(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Prompt text of each hit: its number, title and the document's metadata lines, then the content."""
    lines = meta.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("├── "), "key", F.lit(": "), "value"))), "\n").alias("_meta"))
    body = F.concat_ws("\n", F.concat(F.lit("ID: "), F.col("rank").cast("string")), F.concat(F.lit("├── Title: "), "title"), F.col("_meta"), F.concat(F.lit("└── Content:\n"), "text"))
    return hits.join(lines, "doc_id", "left").select("query_id", "rank", body.alias("prompt"))


#: The ways in which a citation may be written.
CITATIONS = (r"\(\s*ID:?\s*(\d+)\s*\)", r"\[\s*ID:?\s*(\d+)\s*\]", r"【\s*ID:?\s*(\d+)\s*】", r"(?i)\bref\s*(\d+)\b")


def marked_citations(c: Column) -> Column:
    """All ways to write a citation in one."""
    for p in CITATIONS:
        c = F.regexp_replace(c, p, "[ID:$1]")
    return c


def repair_citations(answers: DataFrame, hits: DataFrame, facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, facets): in ``answers`` (answer_id, text) each citation that names a hit is written as one mark and any
    other stays as it was; ``cited`` lists the hits named, in order. Of ``facets`` (answer_id, doc_id, ...) those of cited
    documents stay. ``hits``: answer_id, index, doc_id."""
    known = hits.groupBy("answer_id").agg(F.collect_set(F.col("index").cast("string")).alias("_known"))
    # pieces that are citations, and what lies between them
    whole = "|".join(p.replace("(?i)", "").replace(r"\bref", r"\b[rR][eE][fF]") for p in CITATIONS)
    cut = F.split(F.regexp_replace("text", f"({whole})", "\u0001$1\u0001"), "\u0001", -1)
    joined = answers.join(known, "answer_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>"))).withColumn("_pieces", cut)
    number = lambda x: F.regexp_extract(x, r"(\d+)", 1)
    cites = lambda x: x.rlike(f"^(?:{whole})$") & F.array_contains("_known", F.regexp_replace(number(x), "^0+(?=.)", ""))
    mended = F.array_join(F.transform("_pieces", lambda x: F.when(cites(x), F.concat(F.lit("[ID:"), number(x), F.lit("]"))).otherwise(x)), "")
    cited = F.array_distinct(F.transform(F.filter("_pieces", cites), lambda x: number(x).cast("int")))
    out = joined.select("answer_id", mended.alias("text"), cited.alias("cited"))
    named = out.select("answer_id", F.explode("cited").alias("index")).join(hits, ["answer_id", "index"]).select("answer_id", "doc_id").distinct()
    return out, facets.join(named, ["answer_id", "doc_id"], "left_semi")


def insert_citations(sentences: DataFrame, chunks: DataFrame, tw: float = 0.1, vw: float = 0.9) -> DataFrame:
    """(answer_id, sentence_no, chunk_ids): for sentences (answer_id, sentence_no, tokens, vec) the chunks (answer_id,
    chunk_id, tokens, vec) of the same answer above a threshold that falls from 0.63 by a fifth, while over 0.3, until
    some sentence of the answer has one; at most 4 within 99 % of the sentence's best; each chunk cited once."""
    pairs = sentences.alias("s").join(chunks.select("answer_id", "chunk_id", F.col("tokens").alias("c_tokens"), F.col("vec").alias("c_vec")), "answer_id")
    shared = F.size(F.array_intersect("tokens", "c_tokens")) / F.greatest(F.size(F.array_distinct("tokens")), F.lit(1))
    pairs = pairs.withColumn("sim", tw * shared + vw * cosine("vec", "c_vec")).select("answer_id", "sentence_no", "chunk_id", "sim")
    best = F.max("sim").over(Window.partitionBy("answer_id"))
    levels = [0.63 * 0.8**k for k in range(4)]
    threshold = F.lit(None).cast("double")
    for x in reversed([x for x in levels if x > 0.3]):
        threshold = F.when(best >= x, x).otherwise(threshold)
    good = pairs.withColumn("_t", threshold).withColumn("_m", F.max("sim").over(Window.partitionBy("answer_id", "sentence_no")))
    good = good.filter((F.col("sim") >= F.col("_t")) & (F.col("sim") > 0.99 * F.col("_m")))
    once = top_n(good, ["answer_id", "chunk_id"], [F.asc("sentence_no")], 1, "_c")
    four = top_n(once, ["answer_id", "sentence_no"], [F.desc("sim"), F.asc("chunk_id")], 4, "_n")
    return four.groupBy("answer_id", "sentence_no").agg(F.sort_array(F.collect_list(F.struct("_n", "chunk_id")))["chunk_id"].alias("chunk_ids"))
