"""Importance resampling towards a target: hashed word runs counted by a byte automaton over Arrow buffers.

A lookup table classifies (and lower-cases) the bytes of a whole slice of texts; differences of the classes give the words;
the crc32 of all words advances byte by byte, for all that have such a byte at once. Runs of more words go on from the
checksum of one word less. Bucket counts of the documents and of the target are summed by task, then by bucket; their
logarithmic ratios, a row per bucket, weigh the documents in a second pass. Gumbel noise from the id makes the highest
scores a draw without replacement.

Defined results: a null text has no words, weight 0, and is never drawn; a null id hashes as no digits; repeated rows count
and are scored each, ties go to the smaller id, null first, then to any of rows alike; texts of any length count whole;
an empty table, or an empty target, gives rows for what documents there are; columns besides id and text, whatever their
names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.running import running_total

from .common import checkpoint, ready, table
from .text_ids import slices

#: Bytes of text taken at once, by a task that holds some 20 times as much.
SLICE = 4_000_000

#: Fewer words than this that go on beyond a byte are finished one by one.
FEW = 64

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Digits, letters and all bytes of other scripts make words.
IN_WORD = (LOWER >= 128) | ((LOWER >= 97) & (LOWER <= 122)) | ((LOWER >= 48) & (LOWER <= 57))
_FULL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """The crc32 register's step for each byte, by the polynomial's rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


STEP = crc_table()


def find_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, starts, ends, words before each text and after the last) of a string array."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    low = LOWER[raw]
    inside = IN_WORD[low]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = offsets[1:-1]
    before[bounds[bounds < len(low)]] = False
    after[bounds[bounds > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def advance(crcs: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``crcs`` carried on over the bytes from ``starts`` to ``ends``, all at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, out = starts[order], crcs[order] ^ _FULL
    longest_first = -lengths[order]
    k = 0
    while (going := int(np.searchsorted(longest_first, -k, side="left"))) >= FEW:
        now = out[:going]
        out[:going] = STEP[(now ^ low[at[:going] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        k += 1
    for j in range(going):
        out[j] = np.uint32(zlib.crc32(low[at[j] + k : at[j] - longest_first[j]], int(out[j] ^ _FULL))) ^ _FULL
    done = np.empty_like(out)
    done[order] = out ^ _FULL
    return done


def run_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``longest`` words: their buckets, in order, and how many stand before each text and after the
    last."""
    low, starts, ends, words = find_words(texts)
    crcs = advance(np.zeros(len(starts), np.uint32), low, starts, ends)
    yield (crcs % np.uint32(buckets)).astype(np.int64), words
    rest, first, counts = np.repeat(words[1:], np.diff(words)) - np.arange(len(starts)), np.arange(len(starts)), np.diff(words)  # rest: words from this one to the text's last
    space = np.frombuffer(b" ", np.uint8)
    for n in range(2, longest + 1):
        crcs, first, rest = crcs[rest >= n], first[rest >= n], rest[rest >= n]
        zero = np.zeros(len(crcs), np.int64)
        crcs = advance(advance(crcs, space, zero, zero + 1), low, starts[first + n - 1], ends[first + n - 1])
        yield (crcs % np.uint32(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(counts - n + 1, 0))])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column(batch.schema.get_field_index("text"))
    for first, n in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), SLICE):
        yield batch.slice(first, n)


def bucket_counts(rows: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all ``rows``."""
    ready(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                for found, _ in run_buckets(part.column(0), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    sums = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket."""
    n, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over a text's features."""
    ready(docs.sparkSession)
    buckets = len(gains)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                words, features, weight = None, 0, 0
                for found, before in run_buckets(part.column(1), longest, buckets):
                    n = np.diff(before)
                    words = n if words is None else words
                    features, weight = features + n, weight + np.diff(np.concatenate([[0], np.cumsum(gains[found])])[before])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(sums, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str) -> Column:
    """floor(1000 times standard Gumbel noise), from the id alone."""
    digits = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(digits.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (from 1; null if not drawn), n_words. ``target`` has a column ``text``."""
    gains = bucket_gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets))
    scored = checkpoint(weigh(docs, gains, longest, id_col, text_col).withColumn("score", F.col("weight") + gumbel(seed, "doc_id")))
    may = F.col("n_words") >= least_words
    drawn = scored.filter(may).count() * percent // 100
    order = [F.when(may, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = running_total(scored, [], order, F.lit(1), "_place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(may & (F.col("_place") <= drawn), F.col("_place")).cast("long").alias("rank"), "n_words")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))


#: DuckDB: ``crc_steps`` is one row with the register's step for each byte; ``crc_of`` gives a text's crc32.
CRC_STEPS = """crc_bits AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END), k + 1 FROM crc_bits WHERE k < 8),
crc_steps AS (SELECT list(c ORDER BY i) AS step FROM crc_bits WHERE k = 8)"""


def crc_of(text: str) -> str:
    bytes_of = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), (2 * i + 1)::BIGINT, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_of}), lambda c, b: xor(c >> 8, step[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)"


OP12_SQL = rf"""
WITH RECURSIVE {CRC_STEPS},
low AS (SELECT doc_id, 0 AS kind, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, 1, row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, r, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
distinct_words AS (SELECT DISTINCT w FROM words),
hashed AS (SELECT w, ({crc_of("w")} % 10000)::BIGINT AS bucket FROM distinct_words, crc_steps),
counts AS (SELECT bucket, (count(*) FILTER (kind = 0))::DOUBLE AS s, (count(*) FILTER (kind = 1))::DOUBLE AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT r, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM low LEFT JOIN sums USING (r) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, (CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END)::BIGINT AS rank, n_features AS n_words FROM placed
"""
