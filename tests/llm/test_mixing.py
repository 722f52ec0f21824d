import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import mixing as M

DOCS = "doc_id long, text string, rate string, p_good int, tokens string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [[f"{d}{k}" for k in range(30)] for d in ("fine", "bad", "vile")]
    shared = [f"w{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(n):
        d = rng.choice([0, 0, 0, 1, 2])
        text = " ".join(rng.choice(words[d] if rng.random() < 0.4 else shared) for _ in range(rng.randint(10, 120)))
        docs.append((i, text, "r", 1, "t"))
        labels.append((i, 0 if d == 1 else 1, int(d == 2)))
    return docs, labels


def least_squares(rows, target, have):
    """Relative squares that plain projected descent over whole arrays comes down to in very many steps."""
    p = np.array([[r[f"p_{d}"] for d in M.DOMAINS] for r in rows])
    t = np.array([r.tokens for r in rows], float)
    w = 1 / np.maximum(target, have) ** 2
    largest = np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T @ (t[:, None] * p)) * np.sqrt(w)[None, :]).max()
    r = before = np.ones(len(t))
    for k in range(20_000):  # accelerated
        y = r + k / (k + 3) * (r - before)
        before, r = r, np.maximum(0, y - p @ (((y * t) @ p - target) * w) / largest)
    return float((((r * t) @ p - target) ** 2 * w).sum())


def test_classifier_rates_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(1000, None, "r", 1, "t"), (1001, " ", "r", 1, "t"), (None, "fine1 w1", "r", 1, "t"), (1002, "fine1 " * 30_000, "r", 1, "t"), (5, docs[5][1], "r", 1, "t")]
    frame = spark.createDataFrame(docs + odd, DOCS).repartition(3)
    marks = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, None), (None, 1, 1), (9999, 0, 0)], LABELS)
    got = M.document_rates(frame, marks, {"good": 0.3, "poor": 2.5, "toxic": 0.0}).collect()
    assert len(got) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in got}
    truth = {i: 2 if t else 1 - q for i, q, t in labels if i % 2 == 0}
    hits = [max(range(3), key=lambda k: by_id[i][f"p_{M.DOMAINS[k]}"]) == d for i, d in truth.items()]
    assert np.mean(hits) > 0.9
    have = np.array([sum(r.tokens * r[f"p_{d}"] for r in got) for d in M.DOMAINS])
    target = have * np.array([0.3, 2.5, 0.0])
    reached = np.array([sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) for d in M.DOMAINS])
    squares = float(((reached - target) ** 2 / np.maximum(target, have) ** 2).sum())
    assert squares <= 1.05 * least_squares(got, target, have) + 1e-4 and min(r.rate for r in got) >= 0
    assert reached[2] < 0.1 * have[2]  # a target of 0 pulls down
    assert abs(reached[1] / have[1] - 2.5) < 0.1 and reached[0] / have[0] < 0.45
    assert by_id[1000].rate == by_id[1001].rate == 1.0 and by_id[1000].tokens == 0 and by_id[1002].tokens == 30_000


def test_targets_are_met_and_all_rows_stay(spark):
    docs, labels = corpus(200, 2)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = M.with_posteriors(frame.select("doc_id", "text"), *M.fit(frame, marks)).cache()
    rate, tokens = M.fit_rates(rows)
    assert all(abs(a - b) <= 1e-4 * a for a, b in tokens.values())
    assert rows.select(F.min(rate)).first()[0] > 0.97
    out = M.mix(frame, marks)
    assert out.columns == frame.columns and out.schema == frame.schema
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) == set(range(200)) and 1.05 < len(ids) / 200 < 1.35
    rate, tokens = M.fit_rates(rows, {"good": 1.25, "poor": 1.0, "toxic": 1.0}, least=1.0)
    assert rows.select(F.min(rate)).first()[0] == 1.0
    assert all(abs(a - b) <= 0.05 * a for a, b in tokens.values())
    some = {r.doc_id for r in M.mix(frame, marks, {"good": 1.0, "poor": 0.2, "toxic": 0.2}, least=0.0).collect()}
    assert len(some) < 180


def test_nothing_to_learn_from_or_to_mix(spark):
    docs, labels = corpus(20)
    frame, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    got = M.document_rates(frame, none, {"good": 1.0, "poor": 1.0, "toxic": 1.0}).collect()
    assert all(abs(r.p_good - 1 / 3) < 1e-12 and r.rate == 1.0 for r in got)
    assert M.document_rates(frame.limit(0), none).count() == 0 and M.mix(frame.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_far_targets_are_met_and_misses_are_told(spark):
    import warnings

    docs, labels = corpus(200, 4)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = M.with_posteriors(frame.select("doc_id", "text"), *M.fit(frame, marks)).cache()
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        _, tokens = M.fit_rates(rows, {"good": 2.0, "poor": 0.4, "toxic": 0.3})
    assert all(abs(a - b) <= 0.01 * a for a, b in tokens.values())
    import pytest

    with pytest.warns(UserWarning, match="no rates"):
        M.fit_rates(rows, {"good": 0.5, "poor": 1.0, "toxic": 1.0}, least=1.0)


def test_columns_with_clashing_names_pass_through(spark):
    frame = spark.createDataFrame([(1, "fine words", "x"), (2, None, None)], "doc_id long, text string, raw string")
    got = M.with_posteriors(frame, None, np.zeros(3))
    assert {(r.doc_id, r.raw, r.tokens) for r in got.collect()} == {(1, "x", 2), (2, None, 0)}


def test_each_rounds_weights_leave_the_driver(spark, monkeypatch):
    monkeypatch.setattr(M, "ROUNDS", 2)
    made, put = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(put(self, value)) or made[-1])
    docs, labels = corpus(60)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    M.fit(frame, marks)
    assert len(made) == 2 and not any(b._jbroadcast.isValid() for b in made)
