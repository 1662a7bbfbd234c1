"""The pipeline's stages against plain versions, on the smallest tables and on odd rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import language_id

from .test_llm import dedup, docs_of, find_all, hold_packing, leaks

DATA = "/root/testdata/sf0.001"


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    return a == b if not a or not b else 5 * len(a & b) >= 4 * len(a | b)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = docs_of(spark)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    kept = corpus_pipeline.identify_languages(spark, docs, DATA)
    langs, p = language_id.train(docs.select("text", "lang"))
    found = dict(zip(texts, language_id.mixtures(list(texts.values()), langs, p, 4.0, 12), strict=True))
    assert {r.doc_id: r.lang for r in kept.collect()} == {k: lang for k, (lang, share, _) in found.items() if lang != "und" and share >= 0.5}
    lines = corpus_pipeline.drop_repeated_lines(spark, kept, DATA)
    want = {k: t for k, _, _, t in dedup(sorted((r.doc_id, r.text) for r in kept.collect()))}
    now = {r.doc_id: r.text for r in lines.collect()}
    assert now == want and lines.columns == docs.columns
    near = corpus_pipeline.drop_near_duplicates(spark, lines, DATA)
    ids = sorted(now)
    sets = {k: five_words(now[k]) for k in ids}
    root = find_all(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if alike(sets[a], sets[b])])
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == {k for k in ids if root[k] == k}
    clean = corpus_pipeline.drop_benchmark_leaks(spark, near, DATA)
    rest = {r.doc_id: r.text for r in clean.collect()}
    assert set(rest) == set(left) - {d for d, _ in leaks(left, items)}
    hold_packing(rest, corpus_pipeline.pack_sequences(spark, clean, DATA).collect())


def test_near_duplicates_by_edits(spark):
    """Words changed here and there, passages put in, taken out, replaced and added at the end, at about the threshold."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(30, 300)))]
        texts.append(base)
        for kind in range(5):
            v, n = list(base), int(len(base) * rng.choice([0.02, 0.05, 0.1, 0.12, 0.2]))
            at = int(rng.integers(0, len(v) - n))
            if kind == 0:
                for i in rng.choice(len(v), max(1, n // 5), replace=False):
                    v[i] = word()
            elif kind == 1:
                v[at:at] = [word() for _ in range(n)]
            elif kind == 2:
                del v[at : at + n]
            elif kind == 3:
                v[at : at + n] = [word() for _ in range(n)]
            else:
                v += [word() for _ in range(2 * n)]
            texts.append(v)
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [five_words(r[1]) for r in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if alike(sets[a], sets[b])]
    assert 40 < len(links)
    root = find_all(range(len(rows)), links)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()} == {k for k, r in root.items() if k == r}


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0, 9), (2, "", "en", "s", 0, 9), (None, "some words here and there", None, None, None, 9), (4, "some words here and there", "en", "s", 25, 9), (4, "some words here and there", "en", "s", 25, 9), (5, "x " * 5000 + "words", "en", "s", 1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for start in (docs, docs.filter("doc_id < 0")):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns
        assert corpus_pipeline.pack_sequences(spark, now, DATA).count() >= 0
        last = now
    assert last.count() == 0
    first = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.identify_languages(spark, docs, DATA), DATA)
    assert sorted(r.doc_id or 0 for r in first.select(F.col("doc_id")).collect()) == [0, 4, 5]
