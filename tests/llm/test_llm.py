"""The dealt operators against brute force, exact round trips and held-out accuracy, and odd inputs."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import decontaminate, embedding_dedup, language_id, line_dedup, lm_score, packing, quality, sharding, simhash_dedup, url_filter
from quarry.llm.common import components, rank_in

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three"), (5, "word " * 3000), (6, "word " * 3000), (7, "A\nlong enough line\nB"), (8, "b\n LONG enough line "), (9, "日本 😀 éa")]
SCHEMA = "doc_id long, text string, lang string, score double, shard int, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, and columns with names that the operators use."""
    return spark.createDataFrame([(k, t, "en", 0.5, 1, 2) for k, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def find_all(n, links):
    root = {k: k for k in n}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in n}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = rng.integers(0, 300, (200, 2)).tolist() + [[k, k + 1] for k in range(400, 440)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = find_all({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items()) and all(k in got for k in want if want[k] != k)


def test_rank_in(spark):
    from quarry.llm.common import checkpoint

    df = checkpoint(spark.range(100).select((F.col("id") % 3).alias("key"), "id").repartition(5))
    rows = rank_in(df, "key", [F.col("id")], "place").collect()
    for k in range(3):
        assert sorted(r.place for r in rows if r.key == k) == list(range(sum(r.key == k for r in rows)))


# language ID


def test_language_id(spark):
    rows = language_id.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_mixture_shares(spark):
    docs = spark.createDataFrame([("alpha beta gamma delta " * 50, "x"), ("zyx wvu tsr qpo " * 50, "y")], "text string, lang string")
    langs, p = language_id.train(docs)
    (name, share, found), (one, _, alone) = language_id.mixtures(["alpha beta gamma delta " * 30 + "zyx wvu tsr qpo " * 10, "alpha beta"], langs, p, 4.0, 20)
    assert name == "x" and 0.6 < share < 0.9 and set(found) == {"x", "y"} and one == "x" and set(alone) == {"x"}


def test_language_id_odd(spark, odd, none):
    model = language_id.train(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    named = language_id.set_languages(odd.withColumn("lang", F.lit("?")), model)
    assert named.count() == len(ODD) - 3 and named.columns == odd.columns and {r.lang for r in named.collect()} == {"en"}
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def plain_grams(text, buckets):
    """Counts by bucket, character by character."""
    import unicodedata

    kind = lambda c: unicodedata.category(c)[0]
    if not any(kind(c) == "L" for c in text.lower()):
        return {}
    chars = [0]
    for c in text.lower():
        x = ord(c) if kind(c) in "LM" else 0
        if x or chars[-1]:
            chars.append(x)
    if chars[-1]:
        chars.append(0)
    found, m = Counter(), 2**64
    for i in range(len(chars) - 1):
        two = (chars[i] * 0x9E3779B1 + chars[i + 1]) % m
        found[((two * 0x9E3779B97F4A7C15 % m) >> 40) % buckets] += 1
        if i + 2 < len(chars):
            three = (two * 0x85EBCA77 + chars[i + 2] + (1 << 40)) % m
            found[((three * 0x9E3779B97F4A7C15 % m) >> 40) % buckets] += 1
    return dict(found)


@pytest.mark.parametrize("run", [1, 2, 3, 7, 1 << 20])
def test_grams_equal_plain_loops_whatever_the_runs(monkeypatch, run):
    monkeypatch.setattr(language_id, "RUN", run)
    for text in ("Abc  déf, 12 x", "a", "  ..a", "日本 語", "\u0301\u0302 12", "", "12 34", "e\u0301 ab\n\nc", "A" * 50 + "  b  "):
        at, n = language_id.gram_counts(text, 997)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_grams(text, 997), text


def test_shares_equal_plain_em():
    """The chosen set, the shares and the language of each text as by EM in plain loops."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.full(300, 0.2), 4).T + 1e-6
    p /= p.sum(axis=0)
    texts = []
    for _ in range(40):
        mix = rng.dirichlet(np.full(4, 0.4))
        at, n = np.unique(rng.choice(300, int(rng.integers(5, 400)), p=p @ mix / (p @ mix).sum()), return_counts=True)
        texts.append((at, n))
    got = language_id.infer(texts, p, 4.0, 12)

    def likelihood(at, n, s):
        return sum(c * math.log(sum(p[a, k] * s[k] for k in range(4))) for a, c in zip(at, n, strict=True))

    def em(at, n, allowed):
        s = [1 / len(allowed) if k in allowed else 0.0 for k in range(4)]
        for _ in range(12):
            new = [0.0] * 4
            for a, c in zip(at, n, strict=True):
                z = sum(p[a, k] * s[k] for k in range(4))
                for k in allowed:
                    new[k] += c * p[a, k] * s[k] / z
            s = [x / sum(n) for x in new]
        return s

    for (at, n), shares in zip(texts, got, strict=True):
        level, best = max((likelihood(at, n, [float(j == k) for j in range(4)]), -k) for k in range(4))
        chosen, s = [-best], [float(j == -best) for j in range(4)]
        while len(chosen) < 4:
            slope = {k: sum(c * p[a, k] / sum(p[a, j] * s[j] for j in range(4)) for a, c in zip(at, n, strict=True)) / sum(n) for k in range(4) if k not in chosen}
            k = max(slope, key=slope.get)
            fit = em(at, n, [*chosen, k])
            if slope[k] <= 1 or likelihood(at, n, fit) - level <= 2.0 * math.log(sum(n)):
                break
            chosen, s, level = [*chosen, k], fit, likelihood(at, n, fit)
        assert np.allclose(s, shares, atol=1e-9)
    one_by_one = [language_id.infer([t], p, 4.0, 12)[0] for t in texts]
    assert np.allclose(one_by_one, got)


def test_marks_alone_are_undetermined(spark, odd):
    docs = spark.createDataFrame([(1, "\u0301\u0302 12"), (2, "a\u0301 12"), (3, "12 34 !")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.train(odd)).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == "en"


def test_language_of_a_long_text_and_mixed_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 500, "x"), (2, "zyx wvu tsr qpo " * 500, "y")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    rows = spark.createDataFrame([(1, "alpha beta gamma " * 120_000, "?"), (2, "alpha beta gamma delta zyx wvu tsr qpo " * 30, "?"), (3, "wvu " * 9 + "alpha", "?")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in language_id.set_languages(rows, model, least=0.6).collect()}
    assert got == {1: "x", 3: "y"}


# decontamination


def leaks(texts, items, least=0.8):
    """All windows of each item's length, compared exactly."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())
    found = set()
    for i, item in items.items():
        w = words(item)
        k = min(5, len(w))
        want = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else None
        for d, t in texts.items():
            v = words(t)
            if not want or not any(tuple(v[j : j + k]) in want for j in range(len(v))):
                continue
            for s in range(max(1, len(v) - len(w) + 1)) if want else ():
                part = v[s : s + len(w)]
                got = Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                if got and sum((want & got).values()) >= least * sum((want | got).values()):
                    found.add((d, i))
    return found


def test_decontaminate(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    items = {i: " ".join(word() for _ in range(n)) for i, n in enumerate([1, 3, 5, 8, 20, 40, 59])}
    items |= {90: "again and again and again and again and again", 91: "", 92: None}
    texts = {}
    for d in range(60):
        base = [word() for _ in range(80)]
        item = (items[int(rng.integers(0, 7))]).split()
        if d % 3 == 0:
            base[10:10] = item
        elif d % 3 == 1:  # with a word changed
            item[len(item) // 2] = "changed"
            base[30:30] = [w.upper() + "," for w in item]
        texts[d] = " ".join(base)
    texts |= {100: items[6], 101: " ".join(items[6].split()[:52]), 102: None, 103: "", 104: "x " + items[90] + " y", 105: items[5] + " " + items[5]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = leaks(texts, items)
    for limit in (500_000, 0):  # broadcast and not
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, broadcast_rows=limit).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == set(texts) - {d for d, _ in want}


def test_decontaminate_edits_and_repeats(spark):
    """Words put in, taken out and changed, passages that repeat, heads and tails cut, halves swapped."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    items = {}
    for i in range(24):
        part = [word() for _ in range(int(rng.integers(6, 12) if i % 3 == 0 else rng.integers(46, 75)))]
        items[i] = part * 6 if i % 3 == 0 else part
    texts, d = {}, 0
    for w in items.values():
        for kind in range(6):
            v = list(w)
            for _ in range(1 + kind % 2):
                at = int(rng.integers(0, len(v) if kind else 4))
                v[at : at + (kind != 0)] = [] if kind == 2 else [word()]
            v = v[len(v) // 12 :] if kind == 3 else v[len(v) // 2 :] + v[: len(v) // 2] if kind == 4 else v
            texts[d] = " ".join([*(word() for _ in range(int(rng.integers(0, 40)))), *v, *(word() for _ in range(int(rng.integers(0, 40))))])
            d += 1
    items = {i: " ".join(w) for i, w in items.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = leaks(texts, items)
    assert len(want) > 50
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want


def test_decontaminate_long_text_and_extra_columns(spark):
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 4000, 60_000)]
    item = " ".join(f"item{x}" for x in range(40))
    docs = spark.createDataFrame([(1, " ".join(words[:50_000]) + " " + item + " " + " ".join(words[50_000:]), 5, 6, 7), (2, "x", 5, 6, 7)], "doc_id long, text string, item long, n int, h long")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 7, 50_000, 1.0), (1, 8, 50_000, 1.0)]
    left = decontaminate.drop_leaks(docs, bench)
    assert [r.doc_id for r in left.collect()] == [2] and left.columns == docs.columns


def test_decontaminate_table(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op2_decontaminate(spark, DATA).collect()} == leaks(docs_of(spark), items)


def test_decontaminate_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect()] == [(None, 1)]
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.drop_leaks(odd, bench.filter("item_id > 5")).count() == len(ODD)


# embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    rows = []
    for k in range(500):
        v = centers[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.45])
        rows.append((k, [float(np.float32(x)) for x in v], k % 3))
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, rows[0][1], None), (2003, [float("nan")] * 16, 1), (2004, [1.0, None] * 8, 1), (2005, [], 1), (2006, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if i < 2000]
    links = {(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and a[2] == b[2] and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.93}
    want = find_all([r[0] for r in rows], links)
    counts = Counter(a for a, _ in links)
    for cell in (40, 2048):
        for r in embedding_dedup.link_vectors(df, max_cell=cell).collect():
            assert (r.n_links, r.component_id, r.kept) == (counts[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding_dedup.link_vectors(df.filter("vec_id < 0")).count() == 0


def test_many_multiples_of_one_vector_end(spark):
    """3,000 multiples whose ids agree modulo 16; they link all with all."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=8)
    df = spark.createDataFrame([(16 * k, (v * (1 + k / 7)).tolist(), 1) for k in range(3000)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.link_vectors(df, max_cell=400).groupBy("n_links", "component_id").count().collect()
    assert [(r.n_links, r.component_id, r["count"]) for r in got] == [(2999, 0, 3000)]


def test_cover_tree_covers():
    rng = np.random.default_rng(7)
    points = embedding_dedup.unit(np.repeat(rng.normal(size=(20, 6)), 30, axis=0) + rng.normal(size=(600, 6)) * 0.05)
    todo, seen = [embedding_dedup.cover_tree(points, 0.02)], 0
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.rows] - points[node.center], axis=1).max() <= node.radius + 1e-7 and node.center in node.rows
        if node.kids:
            assert sorted(np.concatenate([k.rows for k in node.kids]).tolist()) == sorted(node.rows.tolist())
            todo += node.kids
        else:
            seen += len(node.rows)
    assert seen == 600


def test_embeddings_odd(spark, none):
    rows = [(None, [1.0, 2.0], "a", 1), (1, [1.0, 2.0], "a", 2), (2, [2.0, 4.0], "a", 3), (3, [1.0, 2.0], None, 4), (4, [2.0, 4.0], "a", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, component_id long").withColumns({"cell": F.lit(1), "node": F.lit(2), "n_links": F.lit(3)})
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df).collect()), key=str)
    assert got == sorted([(0, 0, None, None), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False)], key=str)
    assert embedding_dedup.link_vectors(none.select(F.col("doc_id").alias("vec_id"), F.array(F.col("score")).alias("embedding"), F.col("lang").alias("label"))).count() == 0


# SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = docs_of(spark)
    prints = {k: fingerprint(t) for k, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = find_all(ids, links)
    for r in simhash_dedup.op4_simhash_dedup(spark, DATA).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize(("bits", "segments", "balls", "radius"), [(64, 2, (0, 1), 2), (64, 3, (0, 0), 2), (128, 4, (1, 1), 11)])
def test_multi_index_finds_all_within_the_radius(spark, bits, segments, balls, radius):
    if segments == 3:
        bits, segments = 64, 4  # four segments of 16 bits: one agrees if two bits differ
    rng = np.random.default_rng(8)
    base = [int(x) << 64 | int(y) for x, y in rng.integers(0, 2**63, (30, 2))]
    fps = []
    for b in base:
        fps.append(b)
        for _ in range(6):  # chains: each differs from the last by up to radius + 1 bits
            flips = rng.choice(bits, int(rng.integers(1, radius + 2)), replace=False)
            fps.append(fps[-1] ^ sum(1 << int(f) for f in flips))
    fps = [f % 2**bits for f in fps]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = [(k, *[signed(f >> 64 * w & (2**64 - 1)) for w in range(bits // 64)]) for k, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"f{w} long" for w in range(bits // 64)))
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
    want = find_all(range(len(fps)), links)
    got = simhash_dedup.group_near_duplicates(df, bits, segments, *balls, radius).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_odd(spark, odd, none):
    from quarry.llm.common import checkpoint

    prints = checkpoint(simhash_dedup.fingerprints(odd))
    groups = simhash_dedup.group_near_duplicates(prints, 64, 2, 0, 1, 2)
    by = {r.doc_id: r.component_id for r in groups.collect()}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and groups.count() == len(ODD)
    kept = simhash_dedup.keep_one(odd, groups)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9] and kept.columns == odd.columns
    empty = checkpoint(simhash_dedup.fingerprints(none))
    assert simhash_dedup.group_near_duplicates(empty, 64, 2, 0, 1, 2).count() == 0


# URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://www.example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://A.Example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://a.net/fr/b", "a.net", "/fr/b", "net/fr/", "block"),
        ("http://a.org/free-porn-x", "a.org", "/free-porn-x", None, "block"),
        ("http://a.org/pornography", "a.org", "/pornography", None, "allow"),
        ("http://a.org/casino", "a.org", "/casino", None, "allow"),
        ("http://casino.org/poker?casino", "casino.org", "/poker", None, "block"),
        ("http://casino.org/casino", "casino.org", "/casino", None, "allow"),
        ("no scheme/xxx", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("http://?q", "", "", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    r = url_filter.judge_urls(spark.createDataFrame([(None, url)], "page_id long, url string")).first()
    assert (r.page_id, r.host, r.path, r.rule, r.verdict) == (None, host, path, rule, verdict)


def test_urls_odd(spark):
    rows = [(1, "http://a.org/" + "x/" * 50_000 + "porn", "r"), (1, "http://a.org/casino/casino", "r"), (1, "http://a.org/casino/casino", "r"), (2, "http://B.net/es/?porn", "r"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumns({"host": F.lit(1), "verdict": F.lit("x"), "n_soft": F.lit(9)})
    got = sorted(((r.page_id or 0, len(r.path), r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()), key=str)
    assert got == sorted([(1, 100_005, None, "block"), (1, 14, None, "allow"), (1, 14, None, "allow"), (2, 4, "net/es/", "block"), (0, 0, None, "allow")], key=str)
    assert url_filter.judge_urls(pages.filter("page_id > 9")).count() == 0


# sharding


def test_matrix_is_exact_and_even():
    rows = [0, 7, 1000, 33, 5, 460]
    sums = np.zeros((6, 4))
    for seed in range(200):
        m = sharding.communication_matrix(rows, 4, seed)
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
        sums += m
    assert np.allclose(sums[2] / 200, 250, atol=6)
    assert sharding.communication_matrix([], 4, 1).shape == (0, 4)


def test_strata_stay_even(monkeypatch):
    monkeypatch.setattr(sharding, "STRATUM", 37)
    m = sharding.communication_matrix([100, 51, 3], 8, 2)
    assert m.sum(axis=1).tolist() == [100, 51, 3] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_sharding(spark, odd, none):
    rows = sharding.op6_sharding(spark, DATA).collect()
    texts = docs_of(spark)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in rows:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    small = odd.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(small, ["doc_id", "c"], 3, block=2).collect()) == [(s, i) for s in range(3) for i in range(4 if s < 2 else 3)]
    assert sharding.shuffle_into_shards(none.select("doc_id"), ["doc_id"], 3).count() == 0
    whole = sharding.shuffle_into_shards(odd, ["doc_id", "text"], 3, block=2)  # a column named shard gives way
    assert sorted(whole.columns) == sorted([*odd.columns, "slot"]) and {r.shard for r in whole.collect()} == {0, 1, 2}


# language model


def test_lm_counts_and_gain(spark):
    texts = docs_of(spark)
    counts = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in lm_score.tokens(t.encode()))
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.op7_lm_score(spark, DATA).collect()
    for r in rows:
        w = lm_score.tokens(texts[r.doc_id].encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


TINY = ["a b a c", "b b a d e", "a b a c f", "g g b a", None, "", "b a h i j k", "A b\ta c"]


@pytest.fixture(scope="module")
def tiny(spark):
    """(texts, counts, model) with 4 tokens that have leaves of their own; the others share a bucket."""
    docs = spark.createDataFrame([(t,) for t in TINY], "text string").select(F.col("text").cast("binary").alias("text"))
    counts = lm_score.count_tokens(docs, "text")
    return docs, counts, lm_score.train(docs, counts, head=4, weights=1 << 12)


class PlainLM:
    """The model token by token, from its description: probabilities by plain loops and dicts of weights."""

    def __init__(self, model):
        self.m, self.leaves = model, model.leaves
        self.mass = [c + 1 for c in model.counts.tolist()] + model.bucket_mass.tolist()
        self.members = {}
        for leaf, k in enumerate(self.leaves.leaf_class.tolist()):
            self.members.setdefault(k, []).append(leaf)
        self.total = sum(self.mass)
        self.by_class, self.by_node = {}, {}

    def code(self, w):
        ids = dict(self.m.codes)
        return ids[w] if w in ids else len(ids) + zlib.crc32(w)

    def leaf(self, code):
        k = len(self.m.codes)
        return code if code < k else k + (code - k) % len(self.m.bucket_mass)

    def hashes(self, history, features):
        a = np.array([*history[::-1], 0], np.int64)
        return [int(x[0]) for x in lm_score.keys(a, np.array([3]), features)]

    def classes(self, history):
        rows = self.rows(history)
        z = {k: math.log(sum(self.mass[i] for i in v) / self.total) + sum(self.by_class.get((f, r, k), 0) for f, r in enumerate(rows)) for k, v in self.members.items()}
        top = sum(math.exp(x) for x in z.values())
        return {k: math.exp(x) / top for k, x in z.items()}

    def rows(self, history):
        size = self.m.weights.by_class.shape[1]
        return [int(lm_score.cells(np.array([h], np.uint64), size)[0]) for h in self.hashes(history, lm_score.CLASS_FEATURES)]

    def path(self, leaf, history):
        """[(cells, prior log odds, right)] from the root down, halving runs of members of a power of two."""
        k = int(self.leaves.leaf_class[leaf])
        base = sum(1 << (len(self.members[j]) - 1).bit_length() for j in range(k))
        at, width, lo, node = self.members[k].index(leaf), 1 << (len(self.members[k]) - 1).bit_length(), 0, 1
        found = []
        while width > 1:
            width //= 2
            low, high = self.members[k][lo : lo + width], self.members[k][lo + width : lo + 2 * width]
            right = at >= lo + width
            if high:
                spread = ((base + node) * 0x94D049BB133111EB) % 2**64
                keys = [np.array([h ^ spread], np.uint64) for h in self.hashes(history, lm_score.NODE_FEATURES)]
                found.append(([int(lm_score.cells(x, len(self.m.weights.by_node))[0]) for x in keys], math.log(sum(self.mass[i] for i in high) / sum(self.mass[i] for i in low)), right))
            node, lo = 2 * node + right, lo + width * right
        return found

    def steps(self, text):
        past = [lm_score.START] * 3
        for w in lm_score.tokens(text):
            yield w, tuple(past[-1:-4:-1])
            past.append(self.code(w))

    def odds(self, cells, bias):
        return 1 / (1 + math.exp(-bias - sum(self.by_node.get(c, 0) for c in cells)))

    def probability(self, leaf, history):
        p = self.classes(history)[int(self.leaves.leaf_class[leaf])]
        for cells, bias, right in self.path(leaf, history):
            up = self.odds(cells, bias)
            p *= up if right else 1 - up
        return p

    def round(self, texts, rate, ridge, curves=None):
        grad, node_grad, first = Counter(), Counter(), curves is None
        curve, node_curve = (Counter(), Counter()) if first else curves
        for t in texts:
            for w, history in self.steps(t):
                leaf = self.leaf(self.code(w))
                p = self.classes(history)
                for f, r in enumerate(self.rows(history)):
                    for k, x in p.items():
                        grad[f, r, k] += (k == self.leaves.leaf_class[leaf]) - x
                        if first:
                            curve[f, r, k] += x * (1 - x)
                for cells, bias, right in self.path(leaf, history):
                    up = self.odds(cells, bias)
                    for c in cells:
                        node_grad[c] += right - up
                        if first:
                            node_curve[c] += up * (1 - up)
        for w, g, h in ((self.by_class, grad, curve), (self.by_node, node_grad, node_curve)):
            for k, x in g.items():
                w[k] = w.get(k, 0) + rate * x / (h[k] + ridge)
        return curve, node_curve


def test_lm_training_and_scores_equal_plain_loops(spark, tiny):
    docs, counts, model = tiny
    plain = PlainLM(model)
    texts = [(t or "").encode() for t in TINY]
    curves = plain.round(texts, 0.35, 8.0)
    plain.round(texts, 0.35, 8.0, curves)
    for (f, r, k), x in plain.by_class.items():
        assert abs(model.weights.by_class[f, r, k] - x) < 1e-5
    for c, x in plain.by_node.items():
        assert abs(model.weights.by_node[c] - x) < 1e-5
    assert np.count_nonzero(model.weights.by_node) <= len(plain.by_node) and np.count_nonzero(model.weights.by_class) <= len(plain.by_class)
    known = {bytes(r.token): r.c for r in counts.collect()}
    asked = [*TINY, "b c a unknown", "k", "e d c b a " * 50]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(rows, model, counts).collect()}
    for k, t in enumerate(asked):
        want = 0.0
        for w, history in plain.steps((t or "").encode()):
            leaf = plain.leaf(plain.code(w))
            inside = 1 if w in model.codes else (known.get(w, 0) + 1) / plain.mass[leaf]
            want += math.log10(plain.probability(leaf, history) * inside)
        assert math.isclose(got[k], want, rel_tol=1e-4), t


def test_lm_sums_to_one(tiny):
    """Over all known types and one unknown in each bucket, after any history."""
    _, counts, model = tiny
    plain = PlainLM(model)
    plain.round([(t or "").encode() for t in TINY], 0.35, 8.0)
    for history in ((-1, -1, -1), (0, 1, 0), (5, 2, 7)):
        assert math.isclose(sum(plain.probability(leaf, history) for leaf in range(len(plain.mass))), 1, rel_tol=1e-9)
    rare = [r.c + 1 for r in counts.collect() if bytes(r.token) not in model.codes]
    assert sum(model.bucket_mass) == sum(rare) + len(model.bucket_mass)
    large = lm_score.Leaves(np.arange(3000, 3, -1) ** 1.5, np.arange(1.0, 65.0))
    who, node, right = large.paths(np.arange(len(large.leaf_class)))
    p = np.zeros(len(large.leaf_class))
    np.add.at(p, who, -np.logaddexp(0, np.where(right, -large.bias[node], large.bias[node])))
    mass = np.concatenate((np.arange(3000, 3, -1) ** 1.5, np.arange(1.0, 65.0)))
    assert np.allclose(large.prior[large.leaf_class] * np.exp(p), mass / mass.sum())


def test_lm_does_not_depend_on_partitions(spark, tiny):
    docs, counts, model = tiny
    for parts in (1, 7):
        other = lm_score.train(docs.repartition(parts), counts, head=4, weights=1 << 12).weights
        assert np.allclose(other.by_node, model.weights.by_node, atol=1e-6) and np.allclose(other.by_class, model.weights.by_class, atol=1e-6)


def test_lm_merges_in_levels(spark):
    parts = [(t, b, np.full(4, t + b, np.float32).tobytes()) for t in range(300) for b in range(2)]
    got = lm_score.merge_parts(spark.createDataFrame(parts, "task int, block int, payload binary"), 300, lm_score.BLOCK + 4)
    assert got[:4].tolist() == [300 * 299 / 2] * 4 and got[lm_score.BLOCK :].tolist() == [300 * 299 / 2 + 300] * 4


def test_lm_odd(spark, odd, none):
    learnt = odd.select(F.col("text").cast("binary").alias("text"))
    counts = lm_score.count_tokens(learnt, "text")
    got = lm_score.score(odd, lm_score.train(learnt, counts), counts).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3)) and all(r.n_known == r.n_tokens for r in got)
    zero = none.select(F.col("text").cast("binary").alias("text"))
    nothing = lm_score.count_tokens(zero, "text")
    model = lm_score.train(zero, nothing)
    assert {r.base_score for r in lm_score.score(odd, model, nothing).collect()} == {0.0} and lm_score.score(none, model, nothing).count() == 0


LONG = " ".join(f"word{k % 5000} Über{k % 7}." for k in range(150_000))


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(1, LONG), (2, LONG), (3, "short text")], "doc_id long, text string")


def test_very_long_texts(spark, long):
    from tokenizers import Tokenizer

    words = LONG.split()
    prints = {r.doc_id: r.f0 for r in simhash_dedup.fingerprints(long).collect()}
    assert prints[1] == prints[2] != prints[3] and prints[1] % 2**64 == fingerprint(LONG)
    learnt = long.select(F.col("text").cast("binary").alias("text"))
    counts = lm_score.count_tokens(learnt, "text")
    scored = {r.doc_id: r for r in lm_score.score(long, lm_score.train(learnt, counts), counts).collect()}
    assert scored[1].n_tokens == len(words) + 1 == scored[1].n_known and math.isclose(scored[1].score, scored[2].score, rel_tol=1e-6)
    features = {r.doc_id: r.x for r in quality.feature_table(long).collect()}
    assert math.isclose(features[1][1], math.log1p(len(words))) and features[1] == features[2]
    ids = [*Tokenizer.from_file(packing.tokenizer_file()).encode(LONG, add_special_tokens=False).ids, 1]
    parts = sorted((r.start, r.length, r.ids_crc32) for r in packing.pack(long, packing.tokenizer_file()).filter("doc_id = 1").collect())
    assert [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n, _ in parts] == parts and sum(n for _, n, _ in parts) == len(ids)
    leaks_of = decontaminate.find_leaks(long, spark.createDataFrame([(9, " ".join(words[500:540]))], "item_id long, text string"))
    assert sorted(r.doc_id for r in leaks_of.collect()) == [1, 2]


# packing


def test_pack_places_all():
    histogram = {2048: 3, 1500: 2, 700: 5, 100: 9, 5: 4, 1: 1}
    packs = packing.shortest_pack_first(histogram, 2048)
    used = Counter()
    for n, lengths in packs:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == histogram and packing.shortest_pack_first({}, 2048) == []


def hold_packing(texts, rows):
    """Every id in one piece, sequences without gaps, little padding."""
    from tokenizers import Tokenizer

    tokenizer, by, fill = Tokenizer.from_file(packing.tokenizer_file()), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for k, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(r.length for r in rows) >= 0.9 * 2048 * len(fill)


def test_packing(spark):
    hold_packing(docs_of(spark), packing.op8_packing(spark, DATA).collect())


def test_packing_odd(spark, odd, none):
    rows = packing.pack(odd, packing.tokenizer_file(), 64).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 3001 and sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 4 for r in rows) == 2
    assert packing.pack(none, packing.tokenizer_file()).count() == 0


# lines


def dedup(docs, least=10):
    lines = [(k if k is not None else math.inf, i, j, x) for i, (k, t) in enumerate(docs) for j, x in enumerate((t or "").split("\n"))]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for k, _, _, x in lines:
        first[key(x)] = min(first.get(key(x), math.inf), k)
    out = {}
    for k, i, _, x in lines:
        gone = len(key(x)) >= least and k > first[key(x)]
        out.setdefault(i, []).append(None if gone else x)
    return [(docs[i][0], len(v), sum(x is None for x in v), "\n".join(x for x in v if x is not None)) for i, v in sorted(out.items())]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (6, 3)])
def test_lines(spark, batches, fanout):
    rng = np.random.default_rng(4)
    pool = ["short", "a line that is shared", "A LINE that is shared ", "\tyet another shared line", "ÀÉ longer than ten", "àé longer than ten", "unique"]
    docs = [(int(k), "\n".join(pool[i] if i < 6 else f"unique line {k} {i}" for i in rng.integers(0, 9, rng.integers(1, 9)))) for k in rng.permutation(40)]
    docs += ODD
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in line_dedup.dedup_lines(df, batches=batches, fanout=fanout).collect()), key=str)
    assert got == sorted(dedup(docs), key=str)


def test_runs_are_joined_and_merged_where_they_lie(spark):
    """Neither a run that a batch meets nor a merge of runs is dealt or sorted anew."""
    from quarry.llm.common import checkpoint

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    hashes = lambda lo, hi: spark.range(lo, hi).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(7), "id").alias("h2"), F.col("id").alias("place"))
    runs = [line_dedup.sorted_run(hashes(0, 500).select("h1", "h2")), line_dedup.sorted_run(hashes(500, 900).select("h1", "h2"))]
    lines = checkpoint(hashes(300, 1000).withColumns({"doc_id": F.col("place"), "text_hash": F.col("place"), "pos": F.lit(0)}))
    seen = []
    real = line_dedup.dealt_checkpoint
    try:
        line_dedup.dealt_checkpoint = lambda df: (seen.append(df), real(df))[1]
        drops, fresh = line_dedup.batch_repeats(lines, runs)
        levels = []
        for run in runs:
            line_dedup.add_run(levels, run, 2)
    finally:
        line_dedup.dealt_checkpoint = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys, met, merged = (df._jdf.queryExecution().executedPlan().toString() for df in seen)
    assert keys.count("Exchange") == 1 and met.count("SortMergeJoin") == 2 and "Exchange" not in met and "Sort " not in met and "Exchange" not in merged
    assert drops.count() == 600 and fresh.count() == 100 and [len(x) for x in levels] == [0, 1] and levels[1][0].count() == 900


def test_lines_odd(spark, odd, none):
    out = line_dedup.dedup_lines(odd, kept="text")
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text is None and by[8].text == "b" and by[7].text.count("\n") == 2 and set(odd.columns) < set(out.columns)
    assert line_dedup.dedup_lines(none).count() == 0


def test_long_document(spark):
    long = "\n".join(f"line number {k % 900}" for k in range(20_000))
    df = spark.createDataFrame([(1, "line number 77"), (2, long)], "doc_id long, text string")
    r = line_dedup.dedup_lines(df).filter("doc_id = 2").first()
    assert r.n_lines == 20_000 and r.n_dropped == sum(k % 900 == 77 for k in range(20_000)) and r.kept_text == "\n".join(x for x in long.split("\n") if x != "line number 77")


# quality


def test_quality(spark):
    rows = quality.op10_quality(spark, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(p == q for _, q, p in held) >= 0.9 * len(held) and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_additive_model_learns_an_interaction():
    x = np.random.default_rng(0).uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.AdditiveModel(x, y, rounds=20, pair_rounds=60, pairs=1)
    assert model.pairs[0][:2] == [0, 1] and ((model.score(x) > 0.5) == y).mean() > 0.85


def test_features_equal_plain_ones():
    """Each feature by its own words, over bytes and blank-separated words."""
    kinds = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", ".,;:", "!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~")
    for text in ("Hello, World! 12 a-b\nHello, World!\n\n(x) #tag é", "a", "AAA bbb bbb\tbbb", "one  two. three? ..."):
        b, words, lines = text.encode(), text.encode().split(), text.encode().split(b"\n")
        share = [sum(chr(x) in k for x in b) / len(b) for k in kinds] + [sum(x >= 128 for x in b) / len(b)]
        counts, ends = Counter(b), [chr(w[-1]) in kinds[4] + kinds[5] for w in words]
        want = [
            math.log(1 + len(b)), math.log(1 + len(words)), sum(map(len, words)) / len(words), math.log(1 + max(map(len, words))), len(set(words)) / len(words), *share,
            math.log(1 + len(lines)), math.log(1 + len(b) / len(lines)), len(set(lines)) / len(lines), sum(chr(w[0]) in kinds[0] for w in words) / len(words), sum(ends) / len(words), sum(len(w) <= 2 for w in words) / len(words),
            max(c for x, c in counts.items() if x not in b" \t\n\r\x0b\x0c") / len(b), -sum(c / len(b) * math.log2(c / len(b)) for c in counts.values()), sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words),
        ]
        assert np.allclose(quality.text_features(b), want) and len(want) == len(quality.FEATURES)


def test_additive_scores_equal_plain_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=500) > 0).astype(float)
    model = quality.AdditiveModel(x, y, rounds=10, pair_rounds=10, pairs=2)
    for row, got in zip(x, model.score(x), strict=True):
        f = model.base + sum(t[sum(row[j] >= c for c in model.cuts[j])] for j, t in enumerate(model.tables))
        f += sum(t[sum(row[j] >= c for c in model.coarse[j]), sum(row[k] >= c for c in model.coarse[k])] for j, k, t in model.pairs)
        assert math.isclose(got, 1 / (1 + math.exp(-f)), rel_tol=1e-9)


def test_labels_below_a_level(spark):
    """No more than max_rows labels teach, those of smallest hash, and they are the same with fewer partitions."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    real = quality.AdditiveModel
    try:
        quality.AdditiveModel = lambda x, y: (seen.append((len(x), y.sum())), real(x, y, rounds=1, pair_rounds=1))[1]
        for parts in (1, 6):
            quality.train(quality.feature_table(docs.repartition(parts)), marks, "quality", max_rows=500)
    finally:
        quality.AdditiveModel = real
    assert seen[0] == seen[1] and seen[0][0] == 500


def test_quality_odd(spark, odd, none):
    table = quality.feature_table(odd)
    marks = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1)], "doc_id long, quality int")
    assert quality.score_features(table, quality.train(table, marks, "quality")).count() == len(ODD)
    assert {r.score for r in quality.score_features(table, quality.train(table, marks.filter("doc_id < 0"), "quality")).collect()} == {0.5}
    assert quality.score_features(quality.feature_table(none), quality.train(table, marks, "quality")).count() == 0
