"""The language model's passes over a batch against plain loops over its tokens, on trees of several depths."""

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import lm_score


def test_words_are_looked_up_together():
    class Codes(lm_score.Codes):
        def get(self, *_):
            raise AssertionError("a lookup in Python for each word")

    words = [b"zz", b"a", b"", b"\xc3\x89", b"b"]
    codes = Codes({b"b": 0, b"": 1, b"a": 2})
    assert codes.of(pa.array(words, pa.binary())).tolist() == [3 + zlib.crc32(b"zz"), 2, 1, 3 + zlib.crc32(b"\xc3\x89"), 0]
    assert Codes().of(pa.array(words[:1], pa.binary())).tolist() == [zlib.crc32(b"zz")] and codes.of(pa.array([], pa.binary())).tolist() == []


@pytest.fixture(scope="module")
def batch():
    """(leaves, weights, stream, places of tokens): 300 frequent tokens, classes of different sizes, 8 buckets; pickled as for a task."""
    rng = np.random.default_rng(7)
    leaves = lm_score.Leaves(np.sort(rng.integers(2, 10_000, 300))[::-1], np.arange(1.0, 9.0))
    w = lm_score.Weights.zero(1 << 11, leaves.classes)
    w.by_class[:] = rng.normal(size=w.by_class.shape)
    w.by_node[:] = rng.normal(size=w.by_node.shape)
    return *pickle.loads(pickle.dumps((leaves, w))), np.concatenate(([-1] * 3, rng.integers(0, 330, 900))), np.arange(3, 903)


@pytest.mark.parametrize("first", [True, False])
def test_sums_and_probabilities_of_a_batch(batch, first):
    leaves, w, stream, at = batch
    assert len(set(leaves.depths.tolist())) > 2 and np.isneginf(leaves.bias).any()
    sums, step = lm_score.new_sums(w, first), lm_score.Step(leaves, w, stream, at)
    sums.add(step)
    by_class, by_node, curve = np.zeros(w.by_class.shape), np.zeros(len(w.by_node)), np.zeros(len(w.by_node))
    lp, right_weight = np.zeros(len(at)), w.by_node.astype(float)
    rows = [lm_score.cells(k, w.by_class.shape[1]) for k in lm_score.keys(stream, at, lm_score.CLASS_FEATURES)]
    node_keys = lm_score.keys(stream, at, lm_score.NODE_FEATURES)
    for t, leaf in enumerate(leaves.of(stream[at]).tolist()):
        kind, z = leaves.leaf_class[leaf], np.log(leaves.prior)
        for f, r in enumerate(rows):
            z = z + w.by_class[f, r[t]]
        p = np.exp(z) / np.exp(z).sum()
        lp[t] = np.log(p[kind])
        for f, r in enumerate(rows):
            if not first:
                by_class[f, r[t]] -= p
            by_class[f, r[t], kind] += 1
        for level in range(leaves.depths[leaf]):
            turn = int(leaves.places[leaf]) >> (int(leaves.depths[leaf]) - level - 1)
            node, right = int(leaves.bases[leaf]) + (turn >> 1), turn & 1
            if np.isneginf(leaves.bias[node]):  # the only child
                assert not right
                continue
            spread = np.uint64(node * 0x94D049BB133111EB % 2**64)
            cells = [int(lm_score.cells(k[t : t + 1] ^ spread, len(w.by_node))[0]) for k in node_keys]
            odds = leaves.bias[node] + sum(right_weight[c] for c in cells)
            lp[t] -= np.logaddexp(0, -odds if right else odds)
            up = 1 / (1 + np.exp(-(leaves.bias[node] if first else odds)))
            for c in cells:
                by_node[c] += right - up
                curve[c] += up * (1 - up)
    want = [by_class.reshape(-1), by_node, *([curve] if first else [])]
    assert np.allclose(sums.flat(), np.concatenate(want), atol=1e-3)
    assert np.allclose(step.log_probability(), lp / np.log(10), atol=1e-4)
