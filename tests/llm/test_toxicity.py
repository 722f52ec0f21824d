import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import toxicity as X

DOCS = "doc_id long, text string, score string, lang string"


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["river", "stone", "walking", "evening", "harbour", "quiet", "lantern", "market", "bridge", "orchard"]
    bad = ["vilestem" + x for x in ("a", "ek", "ium", "or", "ity", "ax")]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(600, 1)
    odd = [(9001, None), (9002, ""), (9003, "1234 ... !!"), (None, "river stone"), (9004, "river " * 60_000), (9005, "VILESTEMNEW river stone"), (9005, "VILESTEMNEW river stone")]
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t, _ in rows] + [(i, t, "x", "en") for i, t in odd], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 5] + [(1, None), (None, 1), (4, 1), (77777, 1)], "doc_id long, toxic int")
    got = X.score_toxicity(docs, labels)
    assert set(got.columns) == {"doc_id", "text", "lang", "held_out", "score", "predicted"}
    by_id = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(rows) + len(odd)
    unseen = [(by_id[i][0], y) for i, _, y in rows if by_id[i][0].held_out or i % 5 == 0]
    assert np.mean([r.predicted == y for r, y in unseen]) > 0.98
    assert [r.predicted for r in by_id[9005]] == [1, 1] and not any(by_id[i][0].predicted for i in (9001, 9002, 9003, 9004, None))
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("score <> 'x'").count() == 0
    assert kept.count() == len(rows) + len(odd) - sum(r.predicted for rs in by_id.values() for r in rs)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: round(r.score, 9) for r in X.score_toxicity(docs, l).collect()} for l in (labels, turned))
    assert a == b


def test_one_class_or_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "en")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in X.score_toxicity(docs, none).collect()] == [(0.0, 0)]
    assert X.score_toxicity(docs.limit(0), none).count() == 0


def test_hashes_agree_with_sql(spark):
    letters = X._letters("Straße élan 中文")
    full, context = X._hashes(X._codes(letters))
    grams = [letters[i : i + X.ORDER] for i in range(len(full))]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g string")
    got = df.select("i", X._hash_of("g", X.ORDER).alias("h"), X._hash_of("g", X.ORDER - 1).alias("c")).orderBy("i").collect()
    assert [(r.h, r.c) for r in got] == list(zip(full.tolist(), context.tolist()))
