"""Availability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import availability as A
from tidegauge.operators import presence as P
from tidegauge.plans.presence import _DIGEST, LATE, rounded
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

NOW, LOW = C.NOW, "timestamp_ntz'2024-01-10 00:00:00'"
_SPANS = C.sql("observation", "interval")
_CLIP = """, part AS (
  SELECT *, epoch_us(least(coalesce(to_at, TIMESTAMP '2024-01-31'), TIMESTAMP '2024-01-31')) - epoch_us(greatest(from_at, TIMESTAMP '2024-01-10')) AS len
  FROM availability), clipped AS (SELECT * FROM part WHERE len > 0)"""
_STRIP = """, cut AS (SELECT *, coalesce(to_at, TIMESTAMP '2024-01-31') AS end_at,
    CASE state WHEN 'reachable' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END AS severity FROM availability),
cell AS (SELECT game_id, state, cause, severity, from_at, unnest(generate_series(CAST(CAST(from_at AS DATE) AS TIMESTAMP),
         CAST(CAST(end_at - INTERVAL 1 MICROSECOND AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day_at FROM cut WHERE end_at > from_at),
strip AS (SELECT game_id, CAST(day_at AS DATE) AS day_on, state, cause FROM cell
  QUALIFY row_number() OVER (PARTITION BY game_id, day_at ORDER BY severity DESC, from_at) = 1)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    return A.intervals(C.observations(spark, d))


@query(_SPANS + " SELECT * FROM availability")
def availability_intervals(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d)


@query(_SPANS + _CLIP + """ SELECT game_id, round(CAST(sum(CASE WHEN state = 'reachable' THEN len ELSE 0 END) AS DOUBLE) / sum(len), 6) AS fraction,
CAST(sum(len) AS BIGINT) AS observed_us FROM clipped GROUP BY game_id""")
def reachable_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.reachable_fraction(spans(spark, d), LOW, NOW), "fraction")


@query(_SPANS + _CLIP + """ SELECT game_id, len AS outage_us, cause, from_at AS since FROM clipped WHERE state = 'unreachable'
QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY len DESC, from_at) = 1""")
def longest_outage(spark: SparkSession, d: str) -> DataFrame:
    return A.longest_outage(spans(spark, d), LOW, NOW)


@query(_SPANS + """ SELECT game_id, CAST(sum(greatest(epoch_us(least(coalesce(to_at, TIMESTAMP '2024-01-31'), TIMESTAMP '2024-01-31')) - epoch_us(from_at), 0)) AS BIGINT) AS reachable_us
FROM availability WHERE state = 'reachable' GROUP BY game_id""")
def cumulative_reachable(spark: SparkSession, d: str) -> DataFrame:
    return A.cumulative_reachable(spans(spark, d), NOW)


@query(_SPANS + _STRIP + " SELECT game_id, day_on AS day, state, cause FROM strip")
def day_strip(spark: SparkSession, d: str) -> DataFrame:
    return A.day_strip(spans(spark, d), NOW)


@query(_SPANS + _STRIP + """, runs AS (
  SELECT *, day_on - CAST(row_number() OVER (PARTITION BY game_id, state, cause ORDER BY day_on) AS INT) AS run FROM strip WHERE state <> 'reachable')
SELECT game_id, state, cause, min(day_on) AS first_day, max(day_on) AS last_day, count(*) AS n_days FROM runs GROUP BY game_id, state, cause, run""")
def spells(spark: SparkSession, d: str) -> DataFrame:
    return A.spells(day_strip(spark, d))


_LIVE = """, live AS (SELECT game_id, min(from_at) AS first_seen, max(coalesce(to_at, TIMESTAMP '2024-01-31')) FILTER (WHERE state = 'reachable') AS last_reachable,
  CAST(coalesce(sum(greatest(epoch_us(coalesce(to_at, TIMESTAMP '2024-01-31')) - epoch_us(from_at), 0)) FILTER (WHERE state = 'reachable'), 0) AS BIGINT) AS reachable_us,
  max_by(cause, from_at) FILTER (WHERE state <> 'reachable') AS last_cause FROM availability GROUP BY game_id)"""


@query(_SPANS + _LIVE + " SELECT * FROM live")
def known_live(spark: SparkSession, d: str) -> DataFrame:
    return A.known_live(spans(spark, d), NOW)


@query(C.sql("observation", "interval", "game") + """ SELECT slug, name, from_at, cause FROM availability a JOIN public_game g ON g.id = a.game_id
WHERE a.state = 'unreachable' AND to_at IS NULL AND from_at >= TIMESTAMP '2024-01-01' ORDER BY from_at DESC, slug LIMIT 11""")
def went_dark(spark: SparkSession, d: str) -> DataFrame:
    return A.went_dark(spans(spark, d), C.public(C.games(spark, d), C.merges(spark, d)), f"{NOW} - INTERVAL 30 DAYS")


@query(C.sql("observation", "interval", "game") + """ SELECT slug, name, a.from_at, b.from_at AS down_since FROM availability a
JOIN availability b ON b.game_id = a.game_id AND b.to_at = a.from_at AND b.state <> 'reachable' JOIN public_game g ON g.id = a.game_id
WHERE a.state = 'reachable' AND a.to_at IS NULL AND a.from_at >= TIMESTAMP '2024-01-01' ORDER BY a.from_at DESC, slug LIMIT 11""")
def came_back(spark: SparkSession, d: str) -> DataFrame:
    return A.came_back(spans(spark, d), C.public(C.games(spark, d), C.merges(spark, d)), f"{NOW} - INTERVAL 30 DAYS")


@query(C.sql("observation", "interval", "game") + """ SELECT slug, name, from_at FROM availability a JOIN listed_game g ON g.id = a.game_id
WHERE a.state = 'reachable' AND to_at IS NULL ORDER BY from_at, slug LIMIT 20""")
def unbroken_spells(spark: SparkSession, d: str) -> DataFrame:
    return A.unbroken(spans(spark, d), C.listed(C.public(C.games(spark, d), C.merges(spark, d))))


@query(C.sql("game") + " SELECT slug, name, first_seen_at FROM listed_game WHERE first_seen_at >= TIMESTAMP '2024-01-01' ORDER BY first_seen_at DESC, slug LIMIT 11")
def newly_discovered(spark: SparkSession, d: str) -> DataFrame:
    shown = C.listed(C.public(C.games(spark, d), C.merges(spark, d)))
    return shown.where(f"first_seen_at >= {NOW} - INTERVAL 30 DAYS").select("slug", "name", "first_seen_at").orderBy(F.desc("first_seen_at"), "slug").limit(11)


@query(C.sql("observation", "interval", "game") + """, up AS (
  SELECT game_id, sum(greatest(epoch_us(coalesce(to_at, TIMESTAMP '2024-01-31')) - epoch_us(from_at), 0)) AS us FROM availability WHERE state = 'reachable' GROUP BY game_id),
dark AS (SELECT game_id, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(from_at) AS dark_us FROM availability WHERE state = 'unreachable' AND to_at IS NULL),
kept AS (SELECT slug, dark_us, CASE WHEN is_claimed THEN 31536000000000
   ELSE least(greatest(coalesce(us, 0) // 4, 5184000000000), 31536000000000) END AS allowed_us FROM dark LEFT JOIN up USING (game_id) JOIN game ON id = game_id)
SELECT slug, dark_us, CAST(allowed_us AS BIGINT) AS allowed_us, dark_us >= allowed_us AS due FROM kept""")
def archive_candidates(spark: SparkSession, d: str) -> DataFrame:
    return A.archive_candidates(spans(spark, d), C.games(spark, d), NOW)


@query(C.sql("presence", "observation", "interval", "game") + _DIGEST + _LIVE + """
SELECT id, slug, CASE WHEN state = 'archived' THEN 'archived' WHEN players > 0 THEN 'playersNow' WHEN nonzero > 0 THEN 'activeThisWeek'
    WHEN last_reachable IS NULL OR last_reachable < TIMESTAMP '2024-01-01' THEN 'dark' ELSE 'quiet' END AS band,
  CASE WHEN last_reachable IS NULL THEN 'never' WHEN last_reachable >= TIMESTAMP '2024-01-30' THEN 'day' WHEN last_reachable >= TIMESTAMP '2024-01-24' THEN 'week'
    WHEN last_reachable >= TIMESTAMP '2024-01-01' THEN 'month' ELSE 'older' END AS last_seen
FROM game LEFT JOIN digest ON digest.game_id = id LEFT JOIN live ON live.game_id = id""")
def activity_band(spark: SparkSession, d: str) -> DataFrame:
    return A.activity_band(C.games(spark, d), P.digest(C.presence(spark, d), LATE), A.known_live(spans(spark, d), NOW), NOW)


@query(C.sql("observation", "interval") + _LIVE + """, seen AS (
  SELECT CASE WHEN last_reachable IS NULL THEN ['never'] WHEN last_reachable >= TIMESTAMP '2024-01-30' THEN ['day', 'week', 'month']
    WHEN last_reachable >= TIMESTAMP '2024-01-24' THEN ['week', 'month'] WHEN last_reachable >= TIMESTAMP '2024-01-01' THEN ['month'] ELSE ['older'] END AS t FROM live)
SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM seen) GROUP BY token""")
def last_seen_band(spark: SparkSession, d: str) -> DataFrame:
    live = A.known_live(spans(spark, d), NOW)
    games = live.select(F.col("game_id").alias("id"), F.lit("x").alias("slug"), F.lit("active").alias("state"))
    digest = live.select("game_id", F.lit(0).alias("players"), F.lit(0).alias("nonzero"))
    seen = A.activity_band(games, digest, live, NOW).select(A.nested_tokens(F.col("last_seen")).alias("t"))
    return seen.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
