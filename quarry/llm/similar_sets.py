"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Sets are put in one order that all texts share, and each files its first ``n - ceil(0.8 n) + 1`` shingles: two sets as
similar as that share one of those. Of the first one that they share, neither may have so few behind it that the overlap
could not be reached. What is left is compared exactly, by the texts' sets. Any order finds all pairs; shingles that are
common in a sample of documents come last, so that few rows meet at one.

Shingles are compared by 64-bit hashes. Texts of fewer than five words are one shingle; those without words have none and
are similar to each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.lineage import written

from .common import checkpoint, components, map_batches

WORDS, SEED = 5, 42
#: The sample that tells common shingles: documents, least count and shingles kept. They change the order alone, not the result.
SAMPLE, COMMON, MOST = 10_000, 5, 100_000
#: Shingles of sets that a task keeps for the pairs to come; beyond that it starts anew.
HELD = 4_000_000
#: Buckets that shingles are counted in, a power of two.
BUCKETS = 128
#: Up to so many ids of candidates are sent to all tasks that read texts; more are shuffled.
BROADCAST = 1_000_000


def shingle_set(text: bytes | None) -> np.ndarray:
    from .simhash_dedup import shingle_hashes

    return np.unique(shingle_hashes(text or b"", WORDS, SEED))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for the set."""
    from xxhash import xxh128_digest

    return tuple(np.frombuffer(xxh128_digest(shingles.tobytes()), dtype="<i8").tolist())


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first; ``common`` is sorted."""
    n = len(shingles)
    order = np.arange(n)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        order = np.lexsort((shingles, np.where(common[at] == shingles, counts[at], 0)))
    return shingles[order[: n - (4 * n + 4) // 5 + 1]]


def reach(n: str, i: str, n_b: str, i_b: str) -> Column:
    """Whether sets of ``n`` and ``n_b`` shingles that first meet at places ``i`` and ``i_b`` can be similar: an overlap of
    at least 4/9 of both sizes is a similarity of 0.8."""
    return 9 * F.least(F.col(n) - F.col(i), F.col(n_b) - F.col(i_b)) >= 4 * (F.col(n) + F.col(n_b))


def bucket_counts(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of ``BUCKETS``, 255 for that many or more."""
    return np.minimum(np.bincount((shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def may_be_similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose overlap could be enough: the sum over buckets of the smaller count bounds it, so none that is
    similar goes. Counts move, texts don't."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingle_set(t) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "n": [len(s) for s in found], "counts": [bucket_counts(s) for s in found]})

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mine, its = (np.frombuffer(b"".join(b[c]), np.uint8).reshape(-1, BUCKETS) for c in ("counts_a", "counts_b"))
            least = np.minimum(mine, its)
            most = np.where((least == 255).any(axis=1), np.iinfo(np.int64).max // 9, least.sum(axis=1, dtype=np.int64))
            yield b.loc[9 * most >= 4 * (b["n_a"] + b["n_b"]), ["a", "b"]]

    counts = checkpoint(map_batches(texts, count, "node long, n long, counts binary"))
    both = pairs.join(counts.toDF("a", "n_a", "counts_a"), "a").join(counts.toDF("b", "n_b", "counts_b"), "b")
    return map_batches(both.select("a", "b", "n_a", "n_b", "counts_a", "counts_b"), bound, "a long, b long")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar, by exact comparison. ``texts``: node, text."""

    def of_nodes(pairs: DataFrame) -> DataFrame:
        nodes = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        count = nodes.count()
        return texts.join(F.broadcast(nodes) if count <= BROADCAST else nodes, "node", "left_semi").select("node", F.col("text").cast("binary").alias("text"))

    pairs = checkpoint(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    pairs = checkpoint(may_be_similar(pairs, of_nodes(pairs)))
    of = of_nodes(pairs)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def of(node: int, text: bytes) -> np.ndarray:
            nonlocal size
            if node not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[node] = shingle_set(text)
                size += len(held[node])
            return held[node]

        for b in batches:
            keep = []
            for x, text, y, other in zip(b["a"].tolist(), b["text_a"], b["b"].tolist(), b["text_b"], strict=True):
                mine, its = of(x, text), of(y, other)
                both = len(np.intersect1d(mine, its, assume_unique=True))
                keep.append(9 * both >= 4 * (len(mine) + len(its)))
            yield b.loc[keep, ["a", "b"]]

    with_texts = pairs.join(of.toDF("b", "text_b"), "b").join(of.toDF("a", "text_a"), "a")
    return map_batches(with_texts.select("a", "b", "text_a", "text_b"), compare, "a long, b long").distinct()


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that several documents of a sample hold, sorted by shingle."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"keys": [shingle_set(t).view(np.int64) for t in b["text"]]})

    part = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(part)) == 0).select(F.col("text").cast("binary").alias("text"))
    counts = map_batches(sample, sets, "keys array<long>").select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "key").limit(MOST).collect()
    shingles = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r[1] for r in found], dtype=np.int64)[order]


def prefixes(texts: DataFrame) -> DataFrame:
    """(node, n, keys): the size of each text's set and the shingles that it is filed under, in order."""
    common, counts = common_shingles(texts)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingle_set(t) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"], "n": [len(s) for s in found], "keys": [prefix(s, common, counts).view(np.int64) for s in found]})

    return map_batches(texts.select("node", F.col("text").cast("binary").alias("text")), make, "node long, n long, keys array<long>").filter("n > 0")


def similar_links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the links that ``nodes`` (node, component) stand for and such others that components come out
    as if all similar pairs of ``nodes`` were linked. ``texts``: node, text.

    As in SimHash groups, what is filed under a shingle is first compared with two only, the smallest and one that differs
    from shingle to shingle; then pairs whose components still differ are compared."""
    filed = written(prefixes(texts))  # tables and not checkpoints: hashes by column take less

    every = filed.join(nodes, "node").select("node", "component", "n", F.posexplode("keys").alias("i", "key"))
    every = every.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    one = F.struct("node", "component", "n", "i")
    live = every.groupBy("key").agg(F.min(one).alias("x"), F.min_by(one, F.xxhash64("node", "key")).alias("y"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    met = written(every.join(live.filter("_lo < _hi").select("key", "x", "y"), "key"))
    stars = met.select("node", "component", "n", "i", F.explode(F.array("x", "y")).alias("z")).filter("component <> z.component").filter(reach("n", "i", "z.n", "z.i"))
    links = checkpoint(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(similar(stars.select(F.greatest("node", "z.node").alias("a"), F.least("node", "z.node").alias("b")), texts)))

    now = met.select("node", "key", "n", "i").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = now.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    left = checkpoint(now.join(split, "key"))
    other = left.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "i")])
    across = left.join(other, (left["key"] == other["key"]) & (F.col("node") > F.col("node_b")) & (F.col("component") != F.col("component_b")) & reach("n", "i", "n_b", "i_b"))
    return checkpoint(links.union(similar(across.select(F.col("node").alias("a"), F.col("node_b").alias("b")), texts)))
