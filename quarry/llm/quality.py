"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting.

Features are counted from whole texts in one pass. Labelled rows (at most ``max_rows``, those of smallest id hash) are
binned at their quantiles; boosting goes round the features, each time fitting a tree of a few leaves to the gradient of
one feature's bins, and adds it to that feature's lookup table; then the pairs of features that explain most of what is
left get tables of their own, from trees with one cut on each side. A score is a sum of table entries by bin.

Defined results: a null text counts as empty; empty texts get the score their features have; texts of any length are
counted whole; a label that is null or on no document teaches nothing; a document with several labels counts by their
mean, rounded; repeated rows are scored each, and each teaches; ties between features or cuts go to the first; without
any label, or with labels of one kind, the score is the smoothed share of label 1 (0.5 where there is none); an empty
table gives no rows; columns besides id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, hide_null, map_batches, show_null, table

FEATURES = ("log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "upper", "digits", "blanks", "stops", "marks", "symbols", "high_bytes", "log_lines", "line_bytes", "distinct_lines", "capital_words", "symbol_ends", "short_words", "top_byte", "byte_entropy", "repeats")

_kinds = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _kinds[list(_chars)] = _k
_kinds[128:] = 7


def text_features(text: bytes) -> list[float]:
    """The values of FEATURES; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(text), len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_kinds, weights=counts, minlength=8) / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    ends = _kinds[np.fromiter((w[-1] for w in words), np.int64, m)]
    starts = _kinds[np.fromiter((w[0] for w in words), np.int64, m)]
    lines = text.split(b"\n")
    p = counts[counts > 0] / n
    solid = counts.copy()
    solid[[9, 10, 11, 12, 13, 32]] = 0
    return [
        float(x)
        for x in (
            np.log1p(n), np.log1p(m), sizes.mean(), np.log1p(sizes.max()), len(set(words)) / m, *share[1:8], np.log1p(len(lines)), np.log1p(n / len(lines)),
            len(set(lines)) / len(lines), (starts == 1).mean(), ((ends == 5) | (ends == 6)).mean(), (sizes <= 2).mean(), solid.max() / n, -(p * np.log2(p)).sum(), sum(map(eq, words, words[1:])) / m,
        )
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of each row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [text_features(t or b"") for t in b["text"]]})

    plain = docs.select(hide_null(F.col(id_col)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(plain, count, "doc_id long, x array<double>").select(show_null("doc_id"), "x")


def bin_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The value of each bin under a greedy tree of at most ``leaves`` leaves over ordered bins."""
    cg, ch = np.concatenate(([0.0], g.cumsum())), np.concatenate(([0.0], h.cumsum()))
    parts = [(0, len(g))]

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, 0
        at = np.arange(lo + 1, hi)
        lg, lh, ag, ah = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo]
        gain = lg**2 / (lh + ridge) + (ag - lg) ** 2 / (ah - lh + ridge) - ag**2 / (ah + ridge)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    while len(parts) < leaves:
        (gain, cut), (lo, hi) = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts a grid once on each side."""
    pg, ph = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1), np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    total = 0.0
    quads = []
    for r, s in ((0, 0), (0, 1), (1, 0), (1, 1)):
        def of(p: np.ndarray, r: int = r, s: int = s) -> np.ndarray:
            a, b = (i, np.full_like(i, p.shape[0] - 1)) if r else (np.zeros_like(i), i)
            c, d = (j, np.full_like(j, p.shape[1] - 1)) if s else (np.zeros_like(j), j)
            return p[b, d] - p[a, d] - p[b, c] + p[a, c]

        qg, qh = of(pg), of(ph)
        quads.append((qg, qh))
        total = total + qg**2 / (qh + ridge)
    at = np.unravel_index(int(np.argmax(total)), total.shape)
    a, b = at[0] + 1, at[1] + 1
    out = np.zeros_like(g)
    for (qg, qh), (rs, ss) in zip(quads, ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))), strict=True):
        out[rs, ss] = qg[at] / (qh[at] + ridge)
    return float(total[at] - pg[-1, -1] ** 2 / (ph[-1, -1] + ridge)), out


class AdditiveModel:
    """Cuts and tables; ``score`` adds up table entries by bin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, bins: int = 48, grid: int = 12, rate: float = 0.15, ridge: float = 4.0) -> None:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.cuts, self.coarse, self.tables, self.pairs = [], [], [], []
        if len(y) == 0 or y.min() == y.max():
            return
        d = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, grid + 1)[1:-1])) for j in range(d)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        b = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        f = np.full(len(y), self.base)
        for _ in range(rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                n = len(self.tables[j])
                step = rate * bin_tree(np.bincount(b[j], y - p, n), np.bincount(b[j], p * (1 - p), n), 4, ridge)
                self.tables[j] += step
                f += step[b[j]]
        c = [np.searchsorted(k, x[:, j], side="right") for j, k in enumerate(self.coarse)]
        shape = [len(k) + 1 for k in self.coarse]

        def grids(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            at = c[j] * shape[k] + c[k]
            return tuple(np.bincount(at, w, shape[j] * shape[k]).reshape(shape[j], shape[k]) for w in (y - p, p * (1 - p)))

        usable = [jk for jk in combinations(range(d), 2) if min(shape[jk[0]], shape[jk[1]]) > 1]
        ranked = sorted(usable, key=lambda jk: -quadrants(*grids(*jk), ridge)[0])[:pairs]
        self.pairs = [[j, k, np.zeros((shape[j], shape[k]))] for j, k in ranked]
        for _ in range(pair_rounds):
            for pair in self.pairs:
                j, k, t = pair
                step = rate * quadrants(*grids(j, k), ridge)[1]
                t += step
                f += step[c[j], c[k]]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for j, k, t in self.pairs:
            f += t[np.searchsorted(self.coarse[j], x[:, j], side="right"), np.searchsorted(self.coarse[k], x[:, k], side="right")]
        return 1 / (1 + np.exp(-f))


def train(features: DataFrame, labels: DataFrame, label_col: str, max_rows: int = 40_000, id_col: str = "doc_id") -> AdditiveModel:
    """Fits on labelled rows; at most ``max_rows`` of them come to the driver, a bound that doesn't grow with the data."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("_y"))
    marks = marks.withColumn("_h", F.shiftrightunsigned(F.xxhash64("_id"), 34))  # 30 bits
    # hashes below a level that 1.1 max_rows labels reach, so that all tasks together hand on no more than about those
    level = int((1 << 30) * min(1.0, 1.1 * max_rows / max(1, marks.count())))
    few = marks.filter(F.col("_h") <= level)
    rows = features.join(few, F.col("doc_id") == F.col("_id")).select("x", "_y", "_h", "doc_id").orderBy("_h", "doc_id").limit(max_rows).toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel(x, rows["_y"].to_numpy(np.float64))


def score_features(features: DataFrame, model: AdditiveModel) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    return map_batches(features.withColumn("doc_id", hide_null(F.col("doc_id"))), score, "doc_id long, score double").select(show_null("doc_id"), "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; learnt from labels of ids whose crc32 modulo 5 is not 0."""
    features = checkpoint(feature_table(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    out = score_features(features, train(features, labels, "quality"))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
