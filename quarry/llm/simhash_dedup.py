"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has ``bits`` bits, cut into ``segments`` words of 64 bits or fewer. Fingerprints that differ in at
most ``radius`` bits differ in at most ``radius // segments`` bits of some segment. Each distinct fingerprint is filed
under its segments' values, the Hamming ball of ``table_ball`` bits about each; it looks up the ball of
``probe_ball`` bits about each segment, so every pair whose segments come within table_ball + probe_ball bits meets,
and then complete distances are compared.

A hot table entry is never paired with itself. First each of its fingerprints is compared with the entry's smallest
only, and the links found make components; then pairs of an entry whose components still differ are compared. A pair
left out has both ends in one component already, so components come out as if all pairs had been compared.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other; equal
fingerprints are one class; a null doc_id never names a class unless the class has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, hide_null, map_batches, show_null, table, union_all
from .similar_sets import digest, shingle_set, similar

SHINGLE_SEED, MORE_SEED = 42, 43


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included, of the text with A-Z lower-cased; bytes.split() splits at
    the six ASCII blanks alone, and bytes.lower() changes A-Z alone."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    if words == 1:
        return np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cut = [joined[s:e] for s, e in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), dtype=np.uint64, count=len(cut))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of ``hashes``, as a signed long; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16_384):
        ones += np.unpackbits(hashes[at : at + 16_384, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64, distinct: bool = False, sets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0[, f1 ...]): 64 bits each, from shingle hashes of one seed each. ``distinct``: repeats count once.
    ``sets``: also g0 and g1, which stand for the set of five-word shingles."""
    n = bits // 64
    more = ["g0", "g1"] if sets else []

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns: list[list[int]] = [[] for _ in range(n)]
            for text in b["text"]:
                hashes = shingle_hashes(text or b"", shingle, SHINGLE_SEED)
                hashes = np.unique(hashes) if distinct else hashes
                for k in range(n):
                    columns[k].append(majority(hashes))
                    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(MORE_SEED)
                    hashes ^= hashes >> np.uint64(29)
            marks = np.array([digest(shingle_set(t)) for t in b["text"]] if sets else [], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {f"f{k}": c for k, c in enumerate(columns)} | {m: marks[:, k] for k, m in enumerate(more)})

    plain = docs.select(hide_null(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = map_batches(plain, make, "doc_id long, " + ", ".join([*(f"f{k} long" for k in range(n)), *(f"{m} long" for m in more)]))
    return out.select(show_null("doc_id"), *out.columns[1:])


def distance(n: int, a: str = "", b: str = "_b") -> Column:
    return sum((F.bit_count(F.col(f"f{k}{a}").bitwiseXOR(F.col(f"f{k}{b}"))) for k in range(n)), F.lit(0))


def segment_keys(named: DataFrame, bits: int, segments: int, ball: int, role: bool, halved: bool = False) -> DataFrame:
    """(node, component, filed, key): a key for each segment of a fingerprint and each value in the ball (of 0 or 1 bits)
    about the segment's value."""
    width = bits // segments
    per = 64 // width
    found = []
    for s in range(segments):
        value = F.shiftrightunsigned(F.col(f"f{s // per}"), width * (s % per)).bitwiseAND((1 << width) - 1 if width < 64 else -1)
        values = F.array(value, *[value.bitwiseXOR(F.lit(1 << i if i < 63 else -(2**63))) for i in range(width * ball)])
        if halved:  # of two values one bit apart one has an even count of ones; it looks up the other
            values = F.when(F.bit_count(value) % 2 == 0, values).otherwise(F.array(value))
        found.append(F.struct(F.lit(s).alias("segment"), values.alias("values")))
    by_segment = named.select("node", "component", F.explode(F.array(*found)).alias("k"))
    # segments of 64 bits have no room for their number, nor do they need it: there is but one for each word
    key = F.explode("k.values") if width == 64 else F.explode(F.transform("k.values", lambda v: v.bitwiseOR(F.shiftleft(F.col("k.segment").cast("long"), width))))
    return by_segment.select("node", "component", F.lit(role).alias("filed"), key.alias("key"))


def entries(named: DataFrame, bits: int, segments: int, table_ball: int, probe_ball: int) -> DataFrame:
    """(node, filed, key, first) of what is filed under or looks up each entry in which several components meet; ``first``
    is the smallest filed there. Keys are dealt out once, for the count of an entry and for its rows."""
    filed = segment_keys(named, bits, segments, table_ball, True)
    # with equal balls, what is filed under an entry is also what looks it up
    every = filed if table_ball == probe_ball else union_all([filed, segment_keys(named, bits, segments, probe_ball, False, halved=(table_ball, probe_ball) == (0, 1))])
    every = every.repartition(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    live = every.groupBy("key").agg(F.min(F.when(F.col("filed"), F.col("node"))).alias("first"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    live = live.filter("first IS NOT NULL AND _lo < _hi").select("key", "first")
    return checkpoint(every.select("node", "filed", "key").join(live, "key").select("node", "filed", "key", "first"))


def near_components(classes: DataFrame, bits: int, segments: int, table_ball: int, probe_ball: int, radius: int, texts: DataFrame | None = None) -> DataFrame:
    """(node, component) of the fingerprints that link with others. ``classes``: node long and f0, f1, ... With ``texts``
    (node, text) only pairs of similar texts link; pairs across components are then left to ``similar_links``.

    Equal segments come first: they join most of a large group at little cost, and entries that only fingerprints of one
    component share need no more looks."""
    n = bits // 64
    names = [f"f{k}" for k in range(n)]

    def with_components(found: DataFrame | None) -> DataFrame:
        if found is None:
            return classes.withColumn("component", F.col("node"))
        return checkpoint(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))

    links, found = None, None
    for balls in dict.fromkeys([(0, 0), (table_ball, probe_ball)]):
        named = with_components(found)
        met = entries(named, bits, segments, *balls)
        pairs = met.filter("node <> first").select("node", "first").distinct()
        other = named.select(F.col("node").alias("first"), F.col("component").alias("component_b"), *[F.col(x).alias(f"{x}_b") for x in names])
        stars = pairs.join(named, "node").join(other, "first").filter("component <> component_b").filter(distance(n) <= radius)
        stars = stars.select(F.greatest("node", "first").alias("a"), F.least("node", "first").alias("b"))
        stars = stars if texts is None else similar(stars, texts)
        links = checkpoint((stars if links is None else links.union(stars)).distinct())
        if texts is not None:
            found = components(links)
            continue
        rows = met.select("node", "filed", "key").join(with_components(components(links)), "node")
        split = rows.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
        left = checkpoint(rows.join(split, "key"))
        other = left.filter("filed").select("key", F.col("node").alias("node_b"), F.col("component").alias("component_b"), *[F.col(x).alias(f"{x}_b") for x in names])
        across = left.join(other, "key").filter("component <> component_b").filter(distance(n) <= radius)
        more = across.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))
        links = checkpoint(links.union(more).distinct())
        found = components(links)
    return found


def group_near_duplicates(prints: DataFrame, bits: int, segments: int, table_ball: int, probe_ball: int, radius: int, texts: DataFrame | None = None) -> DataFrame:
    """``prints`` (doc_id, f0, ..., checkpointed) with component_id: the smallest doc_id reachable by links. Rows equal in
    all but the id are one class."""
    names = prints.columns[1:]
    classes = prints.filter("doc_id IS NOT NULL").groupBy(*names).agg(F.min("doc_id").alias("node"))
    classes = checkpoint(classes)
    near = near_components(classes, bits, segments, table_ball, probe_ball, radius, texts)
    of = classes.join(near, "node", "left").select(*[F.col(x).alias(f"_{x}") for x in names], F.coalesce("component", "node").alias("component_id"))
    return prints.join(of, [F.col(x) == F.col(f"_{x}") for x in names], "left").drop(*[f"_{x}" for x in names])


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each group the document of the smallest id; rows with a null id stay. Of rows that repeat an id one stays."""
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    twice = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return kept
    return kept.join(twice, F.col(id_col) == F.col("_twice"), "left_anti").union(kept.join(twice, F.col(id_col) == F.col("_twice"), "left_semi").dropDuplicates([id_col]))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, links at 2 or fewer differing bits: two segments of 32 bits, one of which differs
    in at most one bit, so exact table entries are probed by balls of one bit."""
    prints = checkpoint(fingerprints(table(spark, sf_dir, "documents")))
    out = group_near_duplicates(prints, bits=64, segments=2, table_ball=0, probe_ball=1, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
