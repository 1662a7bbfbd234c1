"""Exact vector search with queries sent to every task, and with both sides dealt out."""

import numpy as np
import pytest

from quarry.operators.retrieval import vector_topk


def plain(vectors, queries, k, least):
    out = []
    for q, a in queries:
        for_q = []
        for i, b in vectors:
            size = np.linalg.norm(a) * np.linalg.norm(b)
            sim = float(np.dot(a, b) / size) if size else 0.0
            if sim >= least:
                for_q.append((-round(sim, 9), i))
        out += [(q, i, rank + 1, -s) for rank, (s, i) in enumerate(sorted(for_q)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "least"), [(1000, 0.1), (16, 0.1), (16, -1.0), (16, 0.9)])
def test_vector_topk(spark, block, least):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    made = [(k, (centres[k % 6] + 0.3 * rng.normal(size=8))) for k in range(300)]
    made += [(1000 + k, 2.0 * made[0][1]) for k in range(40)] + [(2000, np.zeros(8))]  # a hot cell, and no direction
    asked = [(k, v) for k, v in made if k % 7 == 0] + [(5000, np.zeros(8))]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in made] + [(9000, None)], "id long, vec array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in asked] + [(9000, None)], "query_id long, vec array<double>")
    got = sorted((r.query_id, r["rank"], round(r.sim, 9)) for r in vector_topk(frame, queries, 5, least, block, 12).collect())
    want = sorted((q, rank, s) for q, _, rank, s in plain(made, asked, 5, least))  # ids of equal vectors may differ by rounding
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-8)


def test_nothing(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    queries = frame.withColumnRenamed("id", "query_id")
    assert vector_topk(frame, queries.limit(0), 3, 0.1).count() == 0
    assert vector_topk(frame.limit(0), queries, 3, 0.1, block=0).count() == 0
    assert vector_topk(frame, queries, 3, 0.1).count() == 1
