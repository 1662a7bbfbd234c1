"""Language identification as a mixture: which languages a text is made of, and in what shares.

Each language has a smoothed distribution over hashed character bigrams and trigrams, counted over all its documents. A
text's distinct n-grams and counts come from a mixture of languages; expectation-maximisation estimates the shares. The
set of languages grows greedily from the best single one, by the language that raises the likelihood most, while it
raises the likelihood by more than a penalty for one more share (half the logarithm of the number of n-grams, times
``penalty``). Texts are fitted in batches: one array holds the n-grams of many, and sums run by text.

The model has (languages x ``buckets``) entries whatever the size of the corpus; languages are the distinct values of a
label column. Defined results: ``und`` with score 0 and no shares for a null text, one without a letter, or where nothing
was learnt; rows with a null label teach nothing; ties go to the language that sorts first; repeated rows count each;
texts of any length are taken whole, in runs; an empty table gives no rows; columns besides those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hide_null, map_batches, ready, show_null, table

BUCKETS = 1 << 16
UNDETERMINED = "und"
#: Code points are looked at in runs of this length, so that a long text needs little memory at once.
RUN = 1 << 20
#: Probabilities (n-grams times languages) that texts fitted together take up, if more than one.
BATCH = 1 << 19

_letters: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """For each code point itself if it is a letter or mark, else 0; bit 31 tells letters from marks."""
    if not _letters:
        known = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (kind := unicodedata.category(chr(c))[0]) in "LM":
                known[c] = c + (1 << 31 if kind == "L" else 0)
        _letters.append(known)
    return _letters[0]


def gram_counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the bigrams and trigrams of the lower-cased letters and marks, with other characters as one
    blank; both empty without a letter. Each run takes over the last two characters of the one before, so n-grams across
    runs count once and the length of runs changes nothing."""
    known, found, any_letter = letter_codes(), [], False
    text = (text or "").lower()
    last = np.zeros(1, np.uint64)  # a blank stands before the text
    for at in range(0, max(1, len(text)), RUN):
        codes = known[np.frombuffer(text[at : at + RUN].encode("utf-32-le", "replace"), np.uint32)]
        any_letter |= bool((codes >> 31).any())
        codes = (codes & np.uint32(0x7FFFFFFF)).astype(np.uint64)
        if at + RUN >= len(text):  # and one behind it
            codes = np.append(codes, np.uint64(0))
        if not len(codes):
            continue
        blank = codes == 0
        c = np.concatenate((last, codes[~(blank & np.concatenate((last[-1:] == 0, blank[:-1])))]))
        two = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint64(0x85EBCA77) + c[2:] + np.uint64(1 << 40)
        h = np.concatenate((two[len(last) - 1 :], three)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        last = c[-2:]
    if not any_letter:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if sum(map(len, found)) > buckets // 4:
        counts = sum(np.bincount(f, minlength=buckets) for f in found)
        at = counts.nonzero()[0]
        return at, counts[at]
    return np.unique(np.concatenate(found), return_counts=True)


def count_languages(docs: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows with a label; tasks add up their own rows first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                at, n = gram_counts(text, buckets)
                sums.setdefault(lang, np.zeros(buckets, np.int64))[at] += n
        for lang, total in sums.items():
            at = total.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    plain = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return map_batches(plain, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities [bucket, language]): at most a row for each language and bucket comes to the driver."""
    rows = count_languages(docs, text_col, lang_col, buckets).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((buckets, len(langs)), 0.05)
    counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(langs, rows["lang"]) if langs else []] += rows["n"].to_numpy(np.float64)
    return langs, (counts / counts.sum(axis=0)).astype(np.float64)


def fit_shares(p: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM by text: (shares [text, language] within ``allowed``, log likelihoods). Rows of ``p`` and ``n`` are n-grams;
    those of text i are from starts[i] to starts[i + 1]."""
    sizes = np.diff(starts)
    total = np.add.reduceat(n, starts[:-1])
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mixed = p * np.repeat(shares, sizes, axis=0)
        mixed *= (n / mixed.sum(axis=1))[:, None]
        shares = np.add.reduceat(mixed, starts[:-1], axis=0) / total[:, None]
    mixed = np.einsum("ij,ij->i", p, np.repeat(shares, sizes, axis=0))
    return shares, np.add.reduceat(n * np.log(mixed), starts[:-1])


def infer(grams: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Shares [text, language] of texts that have n-grams each."""
    k = p.shape[1]
    starts = np.concatenate(([0], np.cumsum([len(a) for a, _ in grams])))
    pf, n = p[np.concatenate([a for a, _ in grams])], np.concatenate([c for _, c in grams]).astype(np.float64)
    alone = np.add.reduceat(n[:, None] * np.log(pf), starts[:-1], axis=0)
    best = alone.argmax(axis=1)
    shares, level = np.eye(k)[best], alone.max(axis=1)
    price = penalty * 0.5 * np.log(np.add.reduceat(n, starts[:-1]))
    open_, chosen = np.arange(len(grams)), np.eye(k, dtype=bool)[best]
    for _ in range(k - 1):  # texts whose set may still grow
        # how much the likelihood would rise with a small share of each further language, at first
        rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in open_])
        at = np.concatenate(([0], np.cumsum(np.diff(starts)[open_])))
        now = np.einsum("ij,ij->i", pf[rows], np.repeat(shares[open_], np.diff(at), axis=0))
        slope = np.add.reduceat(n[rows, None] * (pf[rows] / now[:, None]), at[:-1], axis=0) / np.add.reduceat(n[rows], at[:-1])[:, None]
        slope[chosen[open_]] = -np.inf
        following = slope.argmax(axis=1)
        worth = slope.max(axis=1) > 1  # else no share of it raises the likelihood
        open_, following = open_[worth], following[worth]
        if not len(open_):
            break
        rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in open_])
        at = np.concatenate(([0], np.cumsum(np.diff(starts)[open_])))
        tried = chosen[open_].copy()
        tried[np.arange(len(open_)), following] = True
        fit, raised = fit_shares(pf[rows], n[rows], at, tried, rounds)
        better = raised - level[open_] > price[open_]
        open_, tried, fit, raised = open_[better], tried[better], fit[better], raised[better]
        shares[open_], level[open_], chosen[open_] = fit, raised, tried
        if not len(open_):
            break
    return shares


def mixtures(texts: pd.Series, langs: list[str], p: np.ndarray, penalty: float, rounds: int, batch: int = BATCH) -> Iterator[tuple[str, float, dict[str, float]]]:
    """(language of the largest share, that share, the shares above 0) of each text, in order. Texts are fitted together up
    to ``batch`` probabilities, so that memory doesn't grow with their lengths or with the languages."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fit() -> Iterator[tuple[str, float, dict[str, float]]]:
        known = [g for g in held if len(g[0]) and langs]
        shares = iter(infer(known, p, penalty, rounds) if known else ())
        for g in held:
            if len(g[0]) and langs:
                s = next(shares)
                yield langs[int(s.argmax())], float(min(1.0, s.max())), {langs[j]: float(s[j]) for j in s.nonzero()[0]}
            else:
                yield UNDETERMINED, 0.0, {}

    room = 0
    for t in texts:
        held.append(gram_counts(t, len(p)))
        room += len(held[-1][0]) * max(1, len(langs))
        if room >= batch:
            yield from fit()
            held.clear()
            room = 0
    yield from fit()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares): the language of the largest share, that share, and the shares above 0."""
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                some = b.iloc[at : at + 1024]
                pred, score, found = zip(*mixtures(some["text"], langs, shared.value, penalty, rounds), strict=True)
                yield pd.DataFrame({id_col: some[id_col], "lang_pred": pred, "score": score, "shares": found})

    plain = docs.select(hide_null(F.col(id_col)).alias(id_col), F.col(text_col).alias("text"))
    out = map_batches(plain, predict, f"`{id_col}` long, lang_pred string, score double, shares map<string,double>")
    return out.select(show_null(id_col), "lang_pred", "score", "shares")


def set_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang", least: float = 0.5, penalty: float = 4.0, rounds: int = 12) -> DataFrame:
    """``docs`` with the language inferred for each text in ``lang_col``; those go whose language is undetermined or makes
    up less than ``least`` of the text. Done within each task, whatever the ids; columns keep their order."""
    langs, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p)

    @F.pandas_udf("string")
    def predicted(texts: pd.Series) -> pd.Series:
        found = mixtures(texts, langs, shared.value, penalty, rounds)
        return pd.Series([lang if share >= least and lang != UNDETERMINED else None for lang, share, _ in found], dtype=object)

    ready(docs.sparkSession)
    named = docs.withColumn("_language", predicted(F.col(text_col))).filter(F.col("_language").isNotNull())
    return named.withColumn(lang_col, F.col("_language")).drop("_language").select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; learnt from labelled documents whose id's crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2).select("text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))
