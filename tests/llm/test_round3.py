"""Token files, importance resampling and the prefix trie against brute force, round trips and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import importance, prefix_trie, text_ids, token_files

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (4, "two <|endoftext|> <|ENDOFTEXT|>"), (None, "one two three"), (5, "word " * 40_000), (6, "Don't é é 日本 😀 12 a1b İx ſ \x1c x\x1cy ab\u0085c !!.."), (7, "x" * 5000)]
SCHEMA = "doc_id long, text string, hash string, id string, file string, rank int, weight double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "h", "i", "f", 1, 0.5) for k, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(text_ids.tokenizer_file())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_text_encoder_equals_the_tokenizer(tokenizer):
    texts = [t for _, t in ODD] + ["ΣΣ 日本語 ab", "ﬁ ǅ a­b ​", "\x00a \x7f é\x00 _a_ $%&", "Hello, World. a,b.c", "a<|b", "<|endoftext|> a<|startoftext|>b", "don't I'll 'S it's we've 'twas", "éa é İx ² ½ 12 a1b"]
    encode = text_ids.TextEncoder(text_ids.tokenizer_file(), held=8)  # forgets words all the time
    for part in (texts, texts[::-1], texts[:4], []):
        ids, bounds = encode(pa.array(part, pa.string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids_of(tokenizer, t) for t in part]
    assert text_ids.slices(np.array([3, 4, 9, 1, 1]), 8) == [(0, 2), (2, 1), (3, 2)]


# token files


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype("<u4")
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) == -(-1000 // 64) * 8 * bits and (token_files.unpack_bits(packed, bits)[:1000] == ids).all()
    whole = sum(int(x) << (k * bits) for k, x in enumerate(ids.tolist()))
    assert int.from_bytes(packed, "little") == whole


def test_file_random_access(tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path / "a.bits")
    texts = [rng.integers(0, 49_408, n).astype("<u4") for n in (5, 0, 700, 64, 1, 3000, 128)]
    writer = token_files.TokenWriter(path, 16, block=128)
    for some in (texts[:2], texts[2:6], texts[6:]):
        bounds = np.cumsum([0, *map(len, some)])
        writer.add(np.arange(len(some)), np.zeros(len(some), bool), np.concatenate(some), bounds)
    assert writer.close() == (7, 3898)
    reader = token_files.TokenReader(path)
    flat = np.concatenate(texts)
    assert all((reader.document(k) == t).all() and len(reader.document(k)) == len(t) for k, t in enumerate(texts))
    assert all((reader.ids(a, b) == flat[a:b]).all() for a, b in rng.integers(0, 4000, (50, 2)).tolist())
    for blocks in (1, 3, 100):
        assert reader.checksums(blocks).tolist() == [zlib.crc32(t.tobytes()) for t in texts]
    (tmp_path / "b.bits").write_bytes(b"0" * 100)
    with pytest.raises(ValueError, match="not a whole file"):
        token_files.TokenReader(str(tmp_path / "b.bits"))


def test_token_files(spark, odd, none, tokenizer, tmp_path):
    manifest = token_files.write_token_files(odd, f"file://{tmp_path}/ids", text_ids.tokenizer_file(), 1).collect()
    assert sum(r.n_docs for r in manifest) == len(ODD) and {r.bits for r in manifest} == {16}
    rows = sorted(token_files.read_token_files(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 4, 5, 6, 7]
    left, at = defaultdict(list), 0
    for k, t in ODD:
        ids = ids_of(tokenizer, t)
        left[k].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in rows:
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert r.start == at
        at += r.n_tokens
    token_files.write_token_files(none, f"{tmp_path}/none", text_ids.tokenizer_file(), 1)
    assert token_files.read_token_files(spark, f"{tmp_path}/none").collect() == []


# importance resampling


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, longest, buckets, percent, least, seed):
    raw, aim = np.zeros(buckets), np.zeros(buckets)
    for rows, to in ((docs, raw), (target, aim)):
        for _, t in rows:
            for f in features(t, longest)[1]:
                to[zlib.crc32(f) % buckets] += 1
    gains = [math.floor(1000 * math.log((t + 1) * (raw.sum() + buckets) / ((s + 1) * (aim.sum() + buckets)))) for s, t in zip(raw, aim, strict=True)]
    out = []
    for k, t in docs:
        n, fs = features(t, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[zlib.crc32(f) % buckets] for f in fs)
        out.append([k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_odd(spark, odd, none, longest):
    target = spark.createDataFrame([(1, "Word of one"), (2, None)], "item_id long, text string")
    got = importance.resample(odd, target.select("text"), longest, 97, 50, 1, 5).collect()
    assert sorted(str(list(r)) for r in got) == plain_resample(ODD, [(1, "Word of one"), (2, None)], longest, 97, 50, 1, 5)
    assert sum(r.rank is not None for r in got) == 3
    assert importance.resample(none, target.select("text")).collect() == []
    assert importance.resample(odd, target.select("text").limit(0)).count() == len(ODD)


def test_word_checksums():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abZé ,9"), rng.integers(0, 90))) for _ in range(400)] + ["v" * 700, None, ""]
    for found, before in importance.run_buckets(pa.array(["cut", *texts]).slice(1), 1, 1009):
        assert [found[a:b].tolist() for a, b in zip(before, before[1:], strict=False)] == [[zlib.crc32(f) % 1009 for f in features(t, 1)[1]] for t in texts]


# prefix trie


def plain_trie(rebuilt):
    """{(conv_id, depth): rest of the row} from {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, cs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(re.findall(prefix_trie.WORDS, x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        kids = sum(len(x) == len(node) + 1 for x in under)
        out[min(cs), len(node)] = (min(members[node[:-1]]) if node else None, len(cs), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def hold_trie(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int, words int").repartition(3)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.number_turns(frame))).collect()}
    assert got == plain_trie(rebuild(rows))


def test_trie_odd(spark):
    rows = [(c, t, "user", f"a {t}") for c in (20, 21, 22, 23, 41, 42) for t in range(4)]  # 40 is absent
    rows += [(60, None, None, None), (60, 0, "user", ""), (60, 0, "user", ""), (61, 5, "u", "tie b"), (61, 5, "u", "tie a"), (62, 1, "x", "only")]
    rows += [(None, 1, "user", "nobody"), (80, 0, "user", "word " * 5000), (81, 0, "user", "word " * 5000), (82, 1, "é", "日本 b")]
    rows += [(c, t, "user", "same") for c in (100, 101, 102) for t in range(9)] + [(103, t, "user", "same" if t < 8 else "other") for t in range(9)]
    hold_trie(spark, rows)


def test_trie_random(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)  # ids of a node in many pieces
    rng = np.random.default_rng(4)
    hold_trie(spark, [(int(c), t, "u", str(rng.integers(0, 2))) for c in range(150) for t in range(rng.integers(1, 6))])


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.number_turns(none))).collect() == []
