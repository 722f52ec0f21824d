"""Overlaps, picks, chains and folds against plain Python."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators import lifecycle as L
from tidegauge.operators import lookups as U
from tidegauge.operators import slugs as S

START = datetime(2024, 1, 1)


def hours(n):
    return None if n is None else START + timedelta(hours=n)


def test_overlaps_equal_brute_force_without_a_nested_loop(spark):
    r = random.Random(2)
    spans = [(k % 3, i, a, None if i % 9 == 0 else a + r.randint(0, 90)) for i, (k, a) in enumerate((r.randint(0, 5), r.randint(-50, 300)) for _ in range(120))]
    windows = [(k % 3, i, a, a + r.randint(-5, 80)) for i, (k, a) in enumerate((r.randint(0, 5), r.randint(-50, 300)) for _ in range(40))]
    s = spark.createDataFrame([(k, i, hours(a), hours(b)) for k, i, a, b in spans], "game_id int, s int, from_at timestamp_ntz, to_at timestamp_ntz")
    w = spark.createDataFrame([(k, i, hours(a), hours(b)) for k, i, a, b in windows], "game_id int, w int, low timestamp_ntz, high timestamp_ntz")
    found = U.overlapping(s, w, "game_id", 24)
    want = sorted((i, j) for k, i, a, b in spans for m, j, low, high in windows if k == m and low <= high and a <= high and (b is None or b >= low) and (b is None or b >= a))
    assert sorted((x.s, x.w) for x in found.collect()) == want and len(want) > 100
    assert not re.search("Cartesian", found._jdf.queryExecution().executedPlan().toString())
    assert U.overlapping(s, w.where("false"), "game_id").collect() == []


def test_a_pick_does_not_depend_on_how_rows_lie(spark):
    rows = spark.range(1000).withColumn("name", F.concat(F.lit("n"), "id"))
    picks = [{U.random_pick(rows.repartition(n), "id", seed).first().id for n in (1, 3, 7)} for seed in range(12)]
    assert all(len(p) == 1 for p in picks) and len(set.union(*picks)) > 6
    assert U.random_pick(rows.where("false"), "id", 1).collect() == []


def test_chains_end_where_their_links_do(spark):
    links = [(i, i - 1) for i in range(1, 40)] + [(100, 101), (101, 102), (200, 201), (201, 200), (300, 200), (400, 400)]
    got = {r.id: r.last for r in S.final_targets(spark.createDataFrame(links, "id long, next long")).collect()}
    assert got == {**{i: 0 for i in range(1, 40)}, 100: 102, 101: 102}
    assert S.final_targets(spark.createDataFrame([], "id long, next long")).collect() == []


def test_redirects_never_point_to_themselves(spark):
    games = spark.createDataFrame([(1, "now"), (2, "two"), (3, "three")], "id long, slug string")
    history = spark.createDataFrame([("old", 1), ("now", 1), ("gone", 2)], "slug string, game_id long")
    merges = spark.createDataFrame([(2, 3)], "id long, next long")
    aliases = spark.createDataFrame([("old", "elsewhere"), ("hand", "now"), ("same", "same")], "former string, current string")
    assert sorted(map(tuple, S.redirects(games, history, merges, aliases).collect())) == [("gone", "three"), ("hand", "now"), ("old", "now"), ("two", "three")]


def test_renames_take_free_slugs_and_their_own(spark):
    games = spark.createDataFrame([(1, "Old", "corvid"), (2, "B", "b"), (3, "C", "c"), (4, "D", "d"), (5, "E", "e"), (6, "F", "f")], "id long, name string, slug string")
    history = spark.createDataFrame([("raven", 9, START), ("heron", 3, START)], "slug string, game_id long, retired_at timestamp_ntz")
    rows = [(1, "Corvid", hours(0), False), (2, "Raven", hours(0), False), (3, "Heron", hours(0), False), (4, "Corvid", hours(0), False), (5, "New", hours(0), True), (6, "Young", hours(24 * 20), False)]
    declared = spark.createDataFrame(rows, "id long, declared string, since timestamp_ntz, overridden boolean")
    now = "timestamp_ntz'2024-01-25 00:00:00'"
    renames = S.renamed(games, history, declared, now, F.lower("declared"))
    assert sorted(map(tuple, renames.collect()), key=str) == [(1, "Corvid", "corvid", None), (2, "Raven", "raven-2", "b"), (3, "Heron", "heron", "c"), (4, "Corvid", "corvid-2", "d")]
    after, retired = S.with_renames(games, history, renames, now)
    assert sorted((r.slug, r.game_id) for r in retired.collect()) == [("b", 2), ("c", 3), ("d", 4), ("heron", 3), ("raven", 9)]
    assert {(r.id, r.name, r.slug) for r in after.collect()} >= {(1, "Corvid", "corvid"), (5, "E", "e"), (2, "Raven", "raven-2")}


def test_states_move_only_where_the_rules_let_them(spark):
    kinds = [("set", "archived"), ("answered", None), ("exclude", "spam"), ("set", "dark"), ("unlist", "u1"), ("answered", None), ("include", None), ("unlist", "u2"), ("set", "quiet")]
    events = spark.createDataFrame([(1, hours(n), n, k, d) for n, (k, d) in enumerate(kinds)], "game_id long, at timestamp_ntz, tie long, kind string, detail string")
    games = spark.createDataFrame([(1, "active"), (2, "quiet")], "id long, state string")

    def after(n):
        return {r.id: r for r in L.after(games, events.where(F.col("tie") < n)).collect()}

    states = [after(n)[1].state for n in range(len(kinds) + 1)]
    assert states == ["active", "archived", "active", "excluded", "excluded", "excluded", "excluded", "active", "unlisted", "unlisted"]
    last, third = after(9)[1], after(3)[1]
    assert (last.unlisted_by, last.unlisted_at, last.excluded_reason, last.moves) == ("u2", hours(7), None, 5) and (third.excluded_reason, third.excluded_at) == ("spam", hours(2))
    assert after(9)[2].state == "quiet" and after(1)[1].archived_at == hours(0)


def test_visits_of_one_slug_are_many_tasks(spark):
    visits = spark.range(400).coalesce(1).selectExpr("id", "CASE WHEN id < 0 THEN 'two' ELSE 'one' END AS slug", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS at")
    held = spark.createDataFrame([("one", 1, None, hours(100)), ("one", 2, hours(100), None), ("one", 3, None, START), ("one", 4, hours(399), None), ("one", 5, hours(400), None), ("two", 6, None, None)], "slug string, game_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    found = S.holders_at(visits, held)
    assert sorted((r.id, r.game_id) for r in found.collect()) == sorted([(n, 1 if n < 100 else 2) for n in range(400)] + [(399, 4)])
    parts = [r["count"] for r in found.selectExpr("spark_partition_id() AS part").groupBy("part").count().collect()]
    assert max(parts) < 300
    none = S.holders_at(visits.withColumn("slug", F.lit(None).cast("string")), held)
    assert [r.game_id for r in none.collect()] == [None] * 400


def test_holders_equal_brute_force_also_without_times_and_names(spark):
    r = random.Random(5)
    time = lambda low, high: None if r.random() < 0.15 else r.randint(low, high)
    visits = [(k, r.choice(["a", "a", "b", "c", "", None]), time(0, 300)) for k in range(900)]
    held = [(r.choice(["a", "b", "", None, "unseen"]), k, time(-50, 350), time(-50, 350)) for k in range(40)]
    held = [x for x in held if x[0] != "b" or x[2] is not None and x[2] > 40] + [("a", None, 10, 20), ("a", 99, 70, 70), ("", 98, None, None)]
    inside = lambda at, a, b: (a is None or at is not None and at >= a) and (b is None or at is not None and at < b)
    want = []
    for k, slug, at in visits:
        found = [g for s, g, a, b in held if s == slug and slug is not None and inside(at, a, b)]
        want += [(k, slug, hours(at), g) for g in found or [None]]
    v = spark.createDataFrame([(k, s, hours(at)) for k, s, at in visits], "c1 long, slug string, at timestamp_ntz")
    h = spark.createDataFrame([(s, g, hours(a), hours(b)) for s, g, a, b in held], "slug string, game_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    got = S.holders_at(v, h)
    assert got.columns == ["c1", "slug", "at", "game_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 1000
    assert any(g is None for _, s, _, g in want if s == "b") and any(g is not None for _, _, at, g in want if at is None)
    assert {(x.c1, x.game_id) for x in S.holders_at(v, h.where("false")).collect()} == {(k, None) for k, _, _ in visits}
    assert S.holders_at(v.where("false"), h).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\*\(\d+\) Generate explode", plan) and "SortMergeJoin" in plan and not re.search(r"\*\(\d+\) SortMergeJoin \[slug", plan)  # compiled, it holds all rows of a block


def test_rows_of_holders_lie_so_that_they_take_little_disk(spark, tmp_path):
    visits = spark.range(300).selectExpr("id * 7919 AS id", "'one' AS slug", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS at")
    held = spark.range(20_000).selectExpr("'one' AS slug", "id * 104729 AS game_id", "CAST(NULL AS timestamp_ntz) AS from_at", "CAST(NULL AS timestamp_ntz) AS to_at")
    S.holders_at(visits, held).select("id", "slug", "game_id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert [*rows.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("game_id"), F.count_distinct(F.xxhash64("id", "game_id"))).first()] == [6_000_000, 300, 20_000, 6_000_000]
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 0.5 * 6_000_000
