"""Streaming queries over the events as a file stream. Each twin is the batch result.

The tables come as one batch, so no row is late; a watermark's effect shows in what is not yet given out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import streaming as S
from tidegauge.streaming import expiring as X
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C


def events(spark: SparkSession, d: str) -> DataFrame:
    """As a pattern, since a file stream takes a single file by no other way."""
    return spark.readStream.schema(C.table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parque[t]")


def moment(micros: str) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


# The watermark, in whole milliseconds as Spark keeps it.
_PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3 HOUR FROM events)"


@query(C.sql("dense") + f""" SELECT game_id, date_trunc('hour', sampled_at) AS bucket, count(cnt) AS counted_samples, count(*) - count(cnt) AS unmeasurable_samples,
       min(cnt) AS min_count, max(cnt) AS max_count, CAST(sum(cnt) AS BIGINT) AS sum_count
FROM presence WHERE date_trunc('hour', sampled_at) + INTERVAL 1 HOUR <= {_PASSED} GROUP BY ALL""")
def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    samples = events(spark, d).selectExpr("user_id % 10 AS game_id", "CAST(ts AS TIMESTAMP) AS sampled_at", "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt")
    return S.finished(S.rollup(samples), "stream_rollup")


@query("SELECT DISTINCT user_id AS game_id, ts AS sampled_at FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Everything delivered twice."""
    one = events(spark, d).selectExpr("user_id AS game_id", "CAST(ts AS TIMESTAMP) AS sampled_at")
    two = events(spark, d).selectExpr("user_id AS game_id", "CAST(ts AS TIMESTAMP) AS sampled_at")
    got = S.finished(S.deduplicated(one.unionByName(two), ["game_id", "sampled_at"], "sampled_at"), "stream_dedup")
    return got.withColumn("sampled_at", F.col("sampled_at").cast("timestamp_ntz"))


def _state(event_type: str) -> str:
    return f"CASE WHEN {event_type} = 'error' THEN 'unreachable/timeout' WHEN {event_type} = 'view' THEN 'degraded/handshake_stalled' ELSE 'reachable/none' END"


@query(C.sql("observation", "interval") + f""" SELECT game_id, state, cause, from_at, to_at FROM availability
WHERE to_at IS NOT NULL AND date_trunc('millisecond', to_at) < {_PASSED}""")
def stream_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that have ended, each given out once."""
    seen = events(spark, d).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id", _state("event_type") + " AS state")
    runs = S.finished(S.closed_runs(seen, "user_id", "ts", "event_id", "state"), "stream_intervals")
    part = lambda n: F.element_at(F.split("value", "/"), n)
    return runs.select(F.col("key").alias("game_id"), part(1).alias("state"), part(2).alias("cause"), moment("from_us").alias("from_at"), moment("to_us").alias("to_at"))


@query(f"""WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT user_id AS game_id, old AS old_value, event_type AS new_value, ts AS changed_at FROM e
WHERE old <> event_type AND date_trunc('millisecond', ts) < {_PASSED}""")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each change of a field's value, with the value before."""
    seen = events(spark, d).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "event_type")
    feed = S.finished(S.changes(S.closed_runs(seen, "user_id", "ts", "event_id", "event_type")), "stream_changes")
    return feed.select(F.col("key").alias("game_id"), "old_value", "new_value", moment("changed_us").alias("changed_at"))


_SILENT = f"""WITH passed AS (SELECT user_id AS game_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM (SELECT DISTINCT user_id, ts FROM events WHERE date_trunc('millisecond', ts) < {_PASSED}))
SELECT game_id, 'silent' AS kind, ts AS last_at, ts + INTERVAL 20 HOUR AS at_time FROM passed
WHERE following - ts > INTERVAL 20 HOUR OR following IS NULL AND date_trunc('millisecond', ts + INTERVAL 20 HOUR) < {_PASSED}
UNION ALL SELECT game_id, 'back', ts, following FROM passed WHERE following - ts > INTERVAL 20 HOUR"""


@query(_SILENT)
def stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    """When each listing was silent for twenty hours, and when it was back."""
    seen = events(spark, d).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts")
    got = X.finished(X.silences(seen, "user_id", "ts", 20), "stream_gaps")
    return got.select(F.col("key").alias("game_id"), "kind", moment("last_us").alias("last_at"), moment("at_us").alias("at_time"))


@query(f"""SELECT user_id AS game_id, CAST(ts AS DATE) AS day, count(*) AS entries FROM events
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 8 DAY <= {_PASSED} GROUP BY ALL""")
def stream_expiry(spark: SparkSession, d: str) -> DataFrame:
    """The days whose samples have gone, seven days after their end, and how many samples each had."""
    seen = events(spark, d).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts")
    got = X.finished(X.expired_days(seen, "user_id", "ts", 7), "stream_expiry")
    return got.select(F.col("key").alias("game_id"), F.date_from_unix_date("day").alias("day"), "entries")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT user_id % 20 AS game_id, sha256(props) AS fingerprint, ts FROM events),
given AS (
  SELECT game_id, fingerprint, min(ts) AS ts FROM p GROUP BY ALL
  UNION ALL SELECT p.game_id, p.fingerprint, p.ts FROM given g JOIN p ON p.game_id = g.game_id AND p.fingerprint = g.fingerprint AND p.ts >= g.ts + INTERVAL 5 DAY
  QUALIFY row_number() OVER (PARTITION BY p.game_id, p.fingerprint ORDER BY p.ts) = 1)
SELECT game_id, fingerprint, ts AS at_time FROM given""")
def stream_first_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that a listing had not sent for five days."""
    seen = events(spark, d).select((F.col("user_id") % 20).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.sha2("props", 256).alias("fingerprint"))
    got = X.finished(X.first_payloads(seen, "user_id", "ts", "fingerprint", 5), "stream_first_payloads")
    return got.select(F.col("key").alias("game_id"), "fingerprint", moment("at_us").alias("at_time"))
