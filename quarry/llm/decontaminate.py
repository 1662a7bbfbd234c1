"""Benchmark decontamination by SimHash fingerprints of item-sized windows, with DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits; an item's shingles are its runs of five words (all its
words if it has fewer). A window of a document, as long as an item, is a leak of it if the weighted similarity of their
shingle multisets (sum of smaller counts over sum of larger ones) is ``similarity`` or more.

1. Where to look. A leak lacks less than 1 - similarity of the item's shingle weight, so it holds one of any shingles of
   the item that weigh more than that together. Those probes are looked up in all texts; every window of an item's
   length about every place of a probe gets a fingerprint (64 bits, those set in over half the shingle hashes).
2. What is there. Fingerprints within ``radius`` bits agree in one of radius + 1 blocks: windows meet the items of their
   length by (block, value) alone, whatever probe led to them, and complete distances are compared.
3. What is left is compared exactly, shingle by shingle.

Texts that hold a probe are dealt out once, by text, and each distinct text once; windows, fingerprints and the exact
comparison stay where the text is. The probe and index tables are broadcast only up to ``broadcast_rows`` rows; beyond
that joins shuffle. Defined results: null and empty texts leak nothing; items without words are never found; a document
shorter than an item is compared whole; rows of one id and text are one; a null id is an id of its own; repeated items
are found each; ties between windows go to the first; texts of any length are taken whole; other columns of the input, whatever
their names, are not read (``drop_leaks`` carries them along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, dealt_checkpoint, table

SHINGLE = 5


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: str, k: Column | int, first: Column | None = None, words: Column | None = None) -> Column:
    """Hashes of the runs of ``k`` words (1 to 5) among ``words`` words from word ``first`` (all by default), in order.

    The word hashes must be a column of their own and the result must not be filtered on: a filter that moves below the
    projection would work them out again for each run.
    """
    first, n = F.lit(0) if first is None else first, F.size(hashes)
    n = n if words is None else F.least(n, first + words)
    if isinstance(k, int):
        runs = F.transform(F.sequence(first + 1, n - k + 1), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]))
        return F.when(n - first >= k, runs).otherwise(F.array().cast("array<bigint>"))
    out = shingles(hashes, SHINGLE, first, words)
    for size in range(1, SHINGLE):
        out = F.when(k == size, shingles(hashes, size, first, words)).otherwise(out)
    return out


def prints_of(rows: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, print) of shingle hashes in rows (keys, h): the 64 bits set in over half of them. Sums of bits are kept
    several in a long, as wide as ``longest``, the most hashes of a print, needs."""
    lane = 16 if longest < 1 << 16 else 32
    ones = sum(1 << at for at in range(0, 64, lane))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(ones))).alias(f"_s{i}") for i in range(lane)]
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), *sums)
    print_ = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(f"_s{bit % lane}", bit - bit % lane).bitwiseAND(F.lit((1 << lane) - 1))
        print_ = print_.bitwiseOR(F.when(2 * count > F.col("_m"), F.lit(1 << bit if bit < 63 else -(2**63))).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, print_.alias("print"))


def blocks(print_: str, radius: int) -> Column:
    """[(block, value)]: 64 bits in radius + 1 runs of as even lengths as can be."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])


def prepared_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, n, k, hashes): words, words a shingle, shingle hashes; ``item`` tells rows apart even if ids repeat."""
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(text_col)).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    items = items.withColumn("k", F.least("n", F.lit(SHINGLE))).withColumn("hashes", shingles("words", F.col("k")))
    return checkpoint(items.withColumn("item", F.xxhash64("item_id", "words")).select("item", "item_id", "n", "k", "hashes").dropDuplicates(["item"]))


def probes(items: DataFrame, similarity: float) -> DataFrame:
    """(h, n, k): for each item the shingles, in order of hash, that first weigh over 1 - similarity."""
    every = items.select("item", "n", "k", F.size("hashes").alias("total"), F.explode("hashes").alias("h"))
    weighed = every.groupBy("item", "n", "k", "total", "h").agg(F.count(F.lit(1)).alias("w"))
    before = Window.partitionBy("item").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return weighed.withColumn("_sum", F.coalesce(F.sum("w").over(before), F.lit(0))).filter(F.col("_sum") <= (1 - similarity) * F.col("total") + 1e-9).select("h", "n", "k").distinct()


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def touched_texts(texts: DataFrame, probe: DataFrame, broadcast_rows: int) -> DataFrame:
    """(t1, t2, n, k, m, starts, runs), dealt by text: for each distinct text and item length that a probe leads to, the
    starts of windows that hold a probe, the shingles in a window and all shingles of the text. ``texts``: text."""
    sizes = [r["k"] for r in probe.select("k").distinct().collect()]  # at most 5 rows
    n_probes = probe.count()
    hashed = texts.select(*text_key(F.col("text")), word_hashes(F.col("text")).alias("words"))
    runs = hashed.select("t1", "t2", F.size("words").alias("n_doc"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), shingles("words", k).alias("runs")) for k in sizes or [SHINGLE]])).alias("r"))
    places = runs.select("t1", "t2", "n_doc", F.col("r.k").alias("k"), F.posexplode("r.runs").alias("pos", "h"))
    hits = places.join(small_side(probe, n_probes, broadcast_rows), ["h", "k"])
    found = checkpoint(hits.groupBy("t1", "t2", "n", "k").agg(F.first("n_doc").alias("n_doc"), F.sort_array(F.collect_set("pos")).alias("at")))
    wanted = found.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    keyed = texts.select(*text_key(F.col("text")), "text")
    holders = keyed.join(small_side(wanted, wanted.count(), broadcast_rows), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left_semi").dropDuplicates(["t1", "t2"])
    both = holders.select("t1", "t2", word_hashes(F.col("text")).alias("words")).join(found, ["t1", "t2"])
    last = F.greatest(F.lit(0), F.col("n_doc") - F.col("n"))
    # of each place the windows about it that the place before does not have
    about = F.transform("at", lambda p, i: F.sequence(F.greatest(F.lit(0), p - (F.col("n") - F.col("k")), F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0)), p))
    starts = F.array_distinct(F.transform(F.flatten(about), lambda s: F.least(s, last)))
    m = F.least("n", "n_doc") - F.col("k") + 1
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_checkpoint(both.select("t1", "t2", "n", "k", m.alias("m"), starts.alias("starts"), shingles("words", F.col("k")).alias("runs")).repartition(n, "t1", "t2", "n", "k"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 22, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, start, similarity): the best window of each document and item that is a leak."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = prepared_items(benchmark, item_col, item_text_col)
    touched = touched_texts(plain.select("text"), checkpoint(probes(items, similarity)), broadcast_rows)
    longest = items.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    inside = touched.select("t1", "t2", "n", "k", F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("runs", s + 1, F.col("m")).alias("hs")))).alias("w"))
    windows = prints_of(inside.select("t1", "t2", "n", "k", F.col("w.start").alias("start"), F.explode("w.hs").alias("h")), ["t1", "t2", "n", "k", "start"], longest)
    marked = prints_of(items.select("item", "n", "k", F.explode("hashes").alias("h")), ["item", "n", "k"], longest)
    index = checkpoint(marked.select("item", F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("print").alias("item_print"), F.explode(blocks("print", radius)).alias("b")).select("item", "_n", "_k", "item_print", F.col("b.block").alias("_block"), F.col("b.value").alias("_value")))
    looked = windows.select("*", F.explode(blocks("print", radius)).alias("b"))
    met = looked.join(small_side(index, index.count(), broadcast_rows), (F.col("b.block") == F.col("_block")) & (F.col("b.value") == F.col("_value")) & (F.col("n") == F.col("_n")) & (F.col("k") == F.col("_k")))
    near = met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).groupBy("t1", "t2", "n", "k").agg(F.collect_set(F.struct("item", "start")).alias("pairs"))
    pairs = touched.join(near, ["t1", "t2", "n", "k"]).select("t1", "t2", "n", "k", F.explode(F.transform("pairs", lambda p: F.struct(p["item"].alias("item"), p["start"].alias("start"), F.slice("runs", p["start"] + 1, F.col("m")).alias("hs")))).alias("p"))
    pairs = pairs.select("t1", "t2", "n", "k", F.col("p.item").alias("item"), F.col("p.start").alias("start"), F.col("p.hs").alias("hs")).join(small_side(items.select("item", "item_id", "hashes"), index.count(), broadcast_rows), "item")
    key = ["t1", "t2", "n", "k", "item", "item_id", "start"]
    # the window's shingles as they are, the item's behind them
    both = pairs.select(*key, F.size("hs").alias("_size"), F.posexplode(F.concat("hs", "hashes")).alias("_at", "h"))
    mine = F.when(F.col("_at") < F.col("_size"), 1).otherwise(0)
    by_shingle = both.groupBy(*key, "h").agg(F.sum(mine).alias("a"), F.sum(1 - mine).alias("b"))
    exact = by_shingle.groupBy(*key).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).filter(F.col("similarity") >= similarity)
    best = checkpoint(exact.groupBy("t1", "t2", "n", "k", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best")))
    best = best.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "item_id", F.col("n").alias("n_words"), (-F.col("best.col2")).alias("start"), F.round("best.similarity", 6).alias("similarity"))
    ids = plain.select("doc_id", *text_key(F.col("text")))
    leaking = ids.join(small_side(best, best.count(), broadcast_rows), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
    return leaking.select("doc_id", "item_id", "n_words", "start", "similarity", "t1", "t2").distinct().drop("t1", "t2")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    leaking = find_leaks(docs, benchmark, id_col=id_col, **settings).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaking, F.col(id_col).eqNullSafe(F.col("_leak")), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that leaks a benchmark item, with the item and the window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
