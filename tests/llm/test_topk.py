import math

import numpy as np
import pytest

from tidegauge.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, k):
    good = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in good if i % 100 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k).collect())


@pytest.mark.parametrize("block", [1024, 2])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(0, 450)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # ties beyond k
    rows += [(200, [1.0] * 5), (7, None), (100, [None] * 6), (300, [float("nan")] * 6), (8, [float("inf")] * 6), (None, [0.1] * 6), (900, [])]
    rows += [(100_000_000_000_000, [0.25] * 6), (-100, [-0.5] * 6)]
    assert run(spark, rows) == brute(rows, 10)


def test_fewer_candidates_than_k_and_repeats(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.4]), (1, [0.3, 0.4]), (2, [-0.001, 0.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_wide_scores(spark):
    rows = [(0, [3e4, 1e4]), (1, [2e4, 2e4]), (2, [-3e4, 5.5])]
    assert run(spark, rows) == brute(rows, 10)
    with pytest.raises(ArithmeticError):
        run(spark, [(0, [1e30]), (1, [1e30])])


@pytest.mark.parametrize("block", [1024, 1])
def test_queries_that_share_an_id(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(101, 150)]
    rows += [(100, [0.5, -0.5, 0.1, 0.2]), (100, [-0.5, 0.5, 0.3, 0.1]), (100, [-0.5, 0.5, 0.3, 0.1])]
    assert len(run(spark, rows)) == 20 and run(spark, rows) == brute(rows, 10)
