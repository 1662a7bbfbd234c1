"""The pipeline's near-copy stage against five-word Jaccard similarity of all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import similar_sets

from .test_llm import find_all


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


def made(rng):
    """Texts with passages appended, replaced and scattered, some of them around a passage that many share."""
    shared, out = words(rng, 40), []
    for _ in range(25):
        base = words(rng, int(rng.integers(60, 400)))
        out += [base, base + words(rng, len(base) // 4 - 2), base + words(rng, len(base) // 3)]
        cut = len(base) // 10
        at = int(rng.integers(0, len(base) - cut))
        out.append(base[:at] + words(rng, cut - 1) + base[at + cut :])
        out.append(base[:at] + words(rng, 2 * cut) + base[at + 2 * cut :])
        for share in (0.01, 0.03, 0.06, 0.08):
            out.append([f"x{rng.integers(5000)}" if rng.random() < share else w for w in base])
    out += [shared + words(rng, 30) for _ in range(60)] + [shared] * 2 + [[], ["one"], ["one"], ["one", "two"]]
    return {k: " ".join(t) for k, t in enumerate(out)}


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    every = len(a) + len(b) - both
    return both / every if every else 1


@pytest.fixture(scope="module")
def case(spark):
    texts = made(np.random.default_rng(5))
    sets = {k: similar_sets.shingle_set(t.encode()) for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    return texts, pairs, left


def test_near_copies_go(case):
    texts, pairs, left = case
    root = find_all(texts, pairs)
    assert len(pairs) > 60 and {k for k in texts if root[k] != k}.isdisjoint(left)


def test_any_order_finds_all_pairs(spark):
    texts = made(np.random.default_rng(6))
    sets = {k: similar_sets.shingle_set(t.encode()) for k, t in texts.items()}
    every = np.unique(np.concatenate(list(sets.values())))
    for some in (every[:0], every[::3], every):
        first = {k: similar_sets.prefix(s, some, np.random.default_rng(7).integers(5, 99, len(some))).tolist() for k, s in sets.items()}
        for a in texts:
            for b in texts:
                if a < b and len(sets[a]) and jaccard(sets[a], sets[b]) >= 0.8:
                    i, j = min((first[a].index(h), first[b].index(h)) for h in set(first[a]) & set(first[b]))
                    assert 9 * min(len(sets[a]) - i, len(sets[b]) - j) >= 4 * (len(sets[a]) + len(sets[b]))


def test_others_stay(case):
    texts, pairs, left = case
    root = find_all(texts, pairs)
    assert left == {k for k in texts if root[k] == k}


def test_counts_bound_the_overlap():
    rng = np.random.default_rng(8)
    for n, common in ((0, 0), (3, 2), (500, 480), (60_000, 55_000)):
        a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        a = np.unique(np.concatenate([a, b[:common]]))
        x, y = (np.frombuffer(similar_sets.bucket_counts(s), np.uint8).astype(int) for s in (a, b))
        assert len(x) == similar_sets.BUCKETS and (np.minimum(x, y).sum() >= len(np.intersect1d(a, b)) or (np.minimum(x, y) == 255).any())
