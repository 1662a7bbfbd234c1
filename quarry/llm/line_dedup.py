"""Line dedup by levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id. A run holds the line hashes a batch met first, hash-partitioned and
sorted. A batch's distinct hashes, dealt and sorted alike, are merge-joined with one run after the other, none of which
moves or is sorted again: hashes found there are repeats, the others are the batch's run. ``fanout`` runs of a level are
merged within their partitions to one of the next, so that a batch meets few runs. Only hashes move until the last
step, where the positions to drop meet the texts. Tasks that hold a frequent line see it once for each partition it came
from; its occurrences meet its key in a join that adaptive execution may split.

Defined results: a null or empty text is one empty line; rows that share a doc_id count as one document, a null doc_id
counts as one document that comes last; lines whose key has fewer than ``min_chars`` code points always stay; a text
without dropped lines comes back as it was (null stays null). Columns of the input named like ours don't clash: only
the id and text columns are read, and ``kept_text`` and the counts are added under the names asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, dealt_checkpoint, empty, table, union_all

BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line that counts: the row it is from (doc_id, text hash), its place and a 128-bit hash of its key."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def sorted_run(hashes: DataFrame) -> DataFrame:
    """``hashes`` dealt by (h1, h2) and sorted, on disk; the checkpoint knows that they are."""
    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt_checkpoint(hashes.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2"))


def add_run(levels: list[list[DataFrame]], run: DataFrame, fanout: int) -> None:
    """Puts ``run`` at level 0 and merges each level that is full into one run of the next. A union of runs that are dealt
    alike is dealt so too: the merge sorts within partitions and moves nothing."""
    at = 0
    while True:
        if at == len(levels):
            levels.append([])
        levels[at].append(run)
        if len(levels[at]) < fanout:
            return
        run = dealt_checkpoint(union_all(levels[at]).sortWithinPartitions("h1", "h2"))
        levels[at] = []
        at += 1


def batch_repeats(lines: DataFrame, runs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(lines to drop, hashes new to the runs) of one batch."""
    keys = sorted_run(lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")))
    seen = F.lit(False)
    for k, run in enumerate(runs):
        keys = keys.join(run.withColumn(f"_in{k}", F.lit(True)), ["h1", "h2"], "left")
        seen = seen | F.col(f"_in{k}").isNotNull()
    if runs:
        keys = dealt_checkpoint(keys.select("h1", "h2", "first", "last", seen.alias("seen")))
    else:
        keys = keys.withColumn("seen", F.lit(False))
    # met by the pair, so that both sides are dealt anew and a hot line can be split
    repeated = keys.filter("seen OR first < last").select(F.struct("h1", "h2").alias("h"), "first", "seen")
    drops = lines.withColumn("h", F.struct("h1", "h2")).join(repeated, "h").filter("seen OR place > first").select("doc_id", "text_hash", "pos")
    return drops, keys.filter("NOT seen").select("h1", "h2")


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines that lose against a smaller doc_id. ``docs``: doc_id long, text."""
    top = 2**63 - 1  # the place of a null id: after all others
    place = F.coalesce(F.col("doc_id"), F.lit(top).cast("long"))
    cuts = [k / batches for k in range(1, batches)]
    bounds = sorted(set(docs.select(place.cast("double").alias("place")).approxQuantile("place", cuts, 0.01))) if cuts else []
    batch = sum((F.when(F.col("place") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    lines = checkpoint(line_hashes(docs, min_chars).withColumn("place", place).withColumn("batch", batch))
    levels: list[list[DataFrame]] = []
    found = []
    for k in range(len(bounds) + 1):
        drops, fresh = batch_repeats(lines.filter(F.col("batch") == k), [r for level in levels for r in level])
        found.append(drops)
        if k < len(bounds):
            add_run(levels, fresh, fanout)
    return union_all(found) if found else empty(docs.sparkSession, "doc_id long, text_hash long, pos int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept_text", counts: tuple[str, str] = ("n_lines", "n_dropped"), min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the kept text and (lines before, lines dropped); ``kept`` may name the text column itself."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_lines(plain, min_chars, batches, fanout).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_gone")
    lines, at = split_lines(F.col(text_col)), F.col("_gone")

    def between(i: Column) -> Column:  # the lines between the i-th dropped one and the one before it
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(at, i - 1))
        after = F.when(i == F.size(at), F.size(F.col("_lines"))).otherwise(F.get(at, i))
        return F.slice(F.col("_lines"), before + 2, after - before - 1)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), between)), "\n")
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash")), "left").withColumn("_lines", lines)
    out = joined.withColumns({kept: F.when(at.isNull(), F.col(text_col)).otherwise(text), "_n": F.size("_lines").cast("long"), "_d": F.coalesce(F.size(at), F.lit(0)).cast("long")})
    return out.withColumns({counts[0]: F.col("_n"), counts[1]: F.col("_d")}).drop("_gone", "_lines", "_id", "_hash", "_n", "_d")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines before, n_dropped, and the SHA-256 of the lines that stay, joined by line feeds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
firsts AS (
  SELECT k, min(doc_id) AS first_id FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.i, l.line, (f.k IS NOT NULL AND l.doc_id > f.first_id) AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
