"""Queries on hours, weekdays and runs of days, and on the remaining upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import hours as H
from tidegauge.operators import presence as P
from tidegauge.operators import writes as W
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

_MEANS = """, means AS (SELECT game_id, CAST(extract(hour FROM sampled_at) AS INT) AS hour, CAST(sum(cnt) AS DOUBLE) / count(*) AS mean FROM presence WHERE cnt IS NOT NULL GROUP BY ALL),
ranged AS (SELECT *, max(mean) OVER (PARTITION BY game_id) AS top, min(mean) OVER (PARTITION BY game_id) AS low FROM means)"""
_RUNS = """, runs AS (SELECT game_id, hour - row_number() OVER (PARTITION BY game_id ORDER BY hour) AS run, hour FROM held),
spans AS (SELECT game_id, run, min(hour) AS first, max(hour) AS last FROM runs GROUP BY game_id, run),
best AS (SELECT game_id, first, last, last - first + 1 AS length FROM spans QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY last - first DESC, first) = 1)
SELECT * FROM best"""


@query(C.sql("presence") + _MEANS + ", held AS (SELECT * FROM ranged WHERE top > 0 AND mean >= top * 0.75)" + _RUNS)
def busiest_hours(spark: SparkSession, d: str) -> DataFrame:
    return H.busiest_hours(C.presence(spark, d))


@query(C.sql("presence") + _MEANS + ", held AS (SELECT * FROM ranged WHERE CASE WHEN low = 0 THEN mean = 0 ELSE mean < greatest(0.5, top * 0.10) END)" + _RUNS + " WHERE length >= 2")
def quietest_hours(spark: SparkSession, d: str) -> DataFrame:
    return H.quietest_hours(C.presence(spark, d))


@query(C.sql("dense") + """, cell AS (SELECT game_id, CAST(extract(dow FROM sampled_at) AS INT) AS dow, CAST(extract(hour FROM sampled_at) AS INT) AS hour, min(cnt) AS lo, max(cnt) AS hi,
  CAST(sum(cnt) AS DOUBLE) / nullif(count(cnt), 0) AS mean, count(*) - count(cnt) AS bad FROM presence GROUP BY ALL),
peak AS (SELECT game_id, dow, hour AS peak_hour FROM cell WHERE mean IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_id, dow ORDER BY mean DESC, hour) = 1)
SELECT game_id, dow, min(lo) AS low, max(hi) AS high, min(peak_hour) AS peak_hour, 24 - count(*) AS gaps, CAST(sum(bad) AS BIGINT) AS uncountable
FROM cell LEFT JOIN peak USING (game_id, dow) GROUP BY game_id, dow""")
def weekday_lines(spark: SparkSession, d: str) -> DataFrame:
    return H.weekday_lines(C.presence(spark, d, dense=True))


@query(C.sql("presence") + """, days AS (SELECT DISTINCT game_id, CAST(sampled_at AS DATE) AS day_on FROM presence WHERE cnt IS NOT NULL),
opened AS (SELECT *, CASE WHEN lag(day_on) OVER w = day_on - 1 THEN 0 ELSE 1 END AS opens, day_on - lag(day_on) OVER w - 1 AS missing FROM days WINDOW w AS (PARTITION BY game_id ORDER BY day_on)),
nth AS (SELECT *, sum(opens) OVER (PARTITION BY game_id ORDER BY day_on) AS k FROM opened)
SELECT game_id, min(day_on) AS first_day, max(day_on) AS last_day, CAST(max(missing) FILTER (WHERE opens = 1) AS INT) AS missing_before FROM nth GROUP BY game_id, k""")
def counted_runs(spark: SparkSession, d: str) -> DataFrame:
    return H.counted_runs(C.presence(spark, d))


_EDGES = "SELECT user_id AS a, event_id % 5 AS b, ts AS first_at, ts + INTERVAL '1' HOUR AS last_at, event_type <> 'error' AS present, event_id % 3 = 0 AS is_new FROM events"


@query(f"WITH e AS ({_EDGES}) SELECT a, b, min(first_at) AS first_at, max(last_at) AS last_at, arg_max(present, last_at) AS present FROM e GROUP BY a, b")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = spark.sql(_EDGES.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events"))
    return W.edges_upserted(e.where("NOT is_new").drop("is_new"), e.where("is_new").drop("is_new"), ["a", "b"])


@query("""WITH t AS (SELECT concat('h', o_custkey) AS host, CAST(o_orderkey % 2 AS INT) AS port, o_orderkey AS id, CAST(o_orderkey % 6 AS INT) AS depth, o_orderkey % 4 = 0 AS is_new FROM orders)
SELECT host, port, coalesce(min(id) FILTER (WHERE NOT is_new), min(id)) AS id, min(depth) AS depth FROM t GROUP BY host, port""")
def depth_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = C.table(spark, d, "orders").selectExpr("concat('h', o_custkey) AS host", "CAST(o_orderkey % 2 AS INT) AS port", "o_orderkey AS id", "CAST(o_orderkey % 6 AS INT) AS depth")
    return W.least_depth(t.where("id % 4 <> 0"), t.where("id % 4 = 0"))


@query("""WITH o AS (SELECT c_custkey AS host, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS port, CASE WHEN c_custkey % 5 < 3 THEN TIMESTAMP '2024-01-01' END AS withdrawn_at FROM customer WHERE c_custkey % 4 > 0)
SELECT c.c_custkey AS host, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS port, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE o.withdrawn_at END AS withdrawn_at, o.host IS NULL AS is_first
FROM customer c LEFT JOIN o ON o.host = c.c_custkey WHERE o.host IS NOT NULL OR c_custkey % 2 = 0""")
def tombstone_cleared(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "customer").selectExpr("c_custkey AS host", "nullif(c_custkey % 3, 0) AS port", "CASE WHEN c_custkey % 5 < 3 THEN timestamp_ntz'2024-01-01 00:00:00' END AS withdrawn_at")
    return W.standing_again(rows.where("host % 4 > 0"), rows.where("host % 2 = 0"), ["host", "port"])


@query(C.sql("field") + """ SELECT game_id, CASE field WHEN '1-URGENT' THEN '2-HIGH' WHEN '5-LOW' THEN '4-NOT SPECIFIED' ELSE field END AS field, source,
  min(last_confirmed_at) AS first_at, max(last_confirmed_at) AS last_at, max(value) AS value FROM game_field GROUP BY ALL""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    facts = C.fields(spark, d).selectExpr("game_id", "field", "source", "value", "last_confirmed_at AS first_at", "last_confirmed_at AS last_at")
    return W.aliases_merged(facts, {"1-URGENT": "2-HIGH", "5-LOW": "4-NOT SPECIFIED"})


@query(C.sql("presence") + """, each AS (SELECT game_id, date_trunc('day', sampled_at) AS bucket, count(cnt) AS counted_samples, count(cnt) FILTER (WHERE extract(day FROM sampled_at) > 3 OR extract(hour FROM sampled_at) > 11) AS left_over
  FROM presence GROUP BY ALL)
SELECT game_id, bucket, counted_samples, CASE WHEN left_over = counted_samples AND left_over > 0 OR (counted_samples = 0 AND EXISTS (SELECT 1 FROM presence p WHERE p.game_id = each.game_id
  AND date_trunc('day', p.sampled_at) = each.bucket AND (extract(day FROM p.sampled_at) > 3 OR extract(hour FROM p.sampled_at) > 11))) THEN counted_samples END AS held FROM each""")
def histogram_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Raw samples of the first mornings are gone."""
    samples = C.presence(spark, d)
    left = samples.where("day(sampled_at) > 3 OR hour(sampled_at) > 11")
    out = W.histograms_backfilled(P.rollup(samples, "day"), P.rollup_with_histogram(left, "day"))
    held = F.aggregate(F.map_values("count_histogram"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("game_id", "bucket", "counted_samples", held.alias("held"))
