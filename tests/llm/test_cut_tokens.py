"""Tokens of whole batches against those of each text."""

import zlib

import pyarrow as pa

from quarry.llm import lm_score

TEXTS = [b" a\x0bB\x1c c\x85\xff ", b"", None, b"\t\n", "É x y Z".encode(), b"a " * 5000 + b"b", b"end", b"\x0c\rA a"]


def test_tokens_of_a_batch():
    for texts in ([None], [b""], TEXTS, TEXTS[::-1]):
        words, places, lengths = lm_score.cut_tokens(pa.array(texts, pa.binary()))
        listed = words.to_pylist()
        assert len(set(listed)) == len(listed) and lengths.tolist() == [len(lm_score.tokens(t)) for t in texts]
        assert [listed[p] for p in places] == [w for t in texts for w in lm_score.tokens(t)]


def test_runs_of_rows_hold_all_rows(monkeypatch):
    monkeypatch.setattr(lm_score, "CUT", 10)
    rows = pa.record_batch({"id": pa.array(range(len(TEXTS))), "text": pa.array(TEXTS, pa.binary())})
    runs = list(lm_score.cut_batches([rows, rows.slice(0, 0), rows.slice(3)]))
    assert [i for some, *_ in runs for i in some.column(0).to_pylist()] == [*range(len(TEXTS)), *range(3, len(TEXTS))]
    assert [n for *_, lengths in runs for n in lengths.tolist()] == [len(lm_score.tokens(t)) for t in TEXTS + TEXTS[3:]]


def test_codes_and_streams():
    codes = lm_score.Codes({b"a": 0, b"": 1})
    words, places, lengths = lm_score.cut_tokens(pa.array([b"a zz", None, b"Zz a a"], pa.binary()))
    s, at = lm_score.streams(words, places, lengths, codes)
    zz, start = 2 + zlib.crc32(b"zz"), [lm_score.START] * 3
    assert s.tolist() == [*start, 0, zz, 1, *start, 1, *start, zz, 0, 0, 1] and at.tolist() == [k for k, x in enumerate(s) if x != lm_score.START]
