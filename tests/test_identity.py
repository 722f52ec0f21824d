"""Candidates and verdicts against plain Python, and how many rows they make on the way."""

import random

import pytest

from tidegauge.operators import identity as I

WEIGHTS = {"nation": 0.3, "balance": 0.5, "bucket": 0.25}
KEYS = ["balance", "bucket"]


def sides(spark, n, most, seed=3):
    r = random.Random(seed)
    row = lambda i: (i, *[None if r.random() < 0.1 else r.randint(0, most) for _ in WEIGHTS])
    probes, known = [row(i) for i in range(n)], [row(i) for i in range(n)]
    made = lambda rows, id_: spark.createDataFrame(rows, f"{id_} long, nation int, balance long, bucket long")
    return probes, known, made(probes, "probe_id"), made(known, "game_id")


def scored(probes, known):
    for p in probes:
        for k in known:
            same = [x is not None and x == y for x, y in zip(p[1:], k[1:])]
            if same[1] or same[2]:
                yield p[0], k[0], round(sum(w for w, s in zip(WEIGHTS.values(), same) if s), 6)


def most_rows(df):
    """The most rows that any step of a plan made when it ran."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_scores_equal_brute_force_and_each_pair_is_there_once(spark):
    probes, known, p, k = sides(spark, 60, 6)
    got = sorted((r.probe_id, r.game_id, r.score) for r in I.blocked_scores(p, k, KEYS, WEIGHTS).collect())
    assert got == sorted(scored(probes, known)) and len(got) > 500


def test_verdicts_equal_brute_force(spark):
    probes, known, p, k = sides(spark, 60, 6)
    want = {}
    for probe, game, score in scored(probes, known):
        want[probe] = min(want.get(probe, (0, 0)), (-score, game))
    got = {r.probe_id: (-r.score, r.game_id) for r in I.verdicts(p, k, KEYS, WEIGHTS).collect()}
    assert got == want
    with pytest.raises(ValueError):
        I.verdicts(p, k, KEYS, WEIGHTS | {"nation": -0.1})


def test_verdicts_make_no_pairs(spark):
    _, _, p, k = sides(spark, 400, 1)
    assert most_rows(I.verdicts(p, k, KEYS, WEIGHTS)) <= 400 * 6


def test_candidates_of_one_key_are_many_tasks(spark):
    one = spark.range(500).coalesce(1)
    p, k = one.selectExpr("id AS probe_id", "1 AS nation", "1L AS balance", "1L AS bucket"), one.selectExpr("id AS game_id", "1 AS nation", "1L AS balance", "1L AS bucket")
    found = I.blocked_scores(p, k, KEYS, WEIGHTS)
    parts = [r["count"] for r in found.selectExpr("spark_partition_id() AS part").groupBy("part").count().collect()]
    assert sum(parts) == 250_000 and max(parts) < 200_000
