"""Queries on upkeep: incremental rollups, watermarks, retention, partitions and write checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import maintenance as M
from tidegauge.operators import presence as P
from tidegauge.operators import writes as W
from tidegauge.plans.presence import rounded
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C
from tidegauge.sources.months import MonthTable

# A tenth of the samples come five hours late, a tenth two: both engines read this.
_ARRIVING = """SELECT user_id % 10 AS game_id, ts AS sampled_at, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt,
  CASE event_id % 10 WHEN 0 THEN ts + INTERVAL '5' HOUR WHEN 1 THEN ts + INTERVAL '2' HOUR ELSE ts END AS arrived_at FROM events"""
_FIRST, _SECOND = datetime(2024, 1, 20, 12, 30), datetime(2024, 1, 31, 0, 0)
_PASSES = f"""WITH presence AS ({_ARRIVING}),
seen AS (
  SELECT 'hour' AS grain, date_trunc('hour', sampled_at) AS bucket, * FROM presence
  WHERE CASE WHEN sampled_at < TIMESTAMP '2024-01-20 09:00:00' THEN arrived_at <= TIMESTAMP '2024-01-20 12:30:00' ELSE arrived_at <= TIMESTAMP '2024-01-31' END
  UNION ALL SELECT 'day', date_trunc('day', sampled_at), * FROM presence
  WHERE CASE WHEN sampled_at < TIMESTAMP '2024-01-20' THEN arrived_at <= TIMESTAMP '2024-01-20 12:30:00' ELSE arrived_at <= TIMESTAMP '2024-01-31' END)
SELECT grain, game_id, bucket, count(cnt) AS counted_samples, count(*) - count(cnt) AS unmeasurable_samples, min(cnt) AS min_count, max(cnt) AS max_count,
       CAST(sum(cnt) AS BIGINT) AS sum_count, round(CAST(sum(cnt) AS DOUBLE) / nullif(count(cnt), 0), 6) AS mean_count
FROM seen WHERE sampled_at < TIMESTAMP '2024-01-31' GROUP BY grain, game_id, bucket"""


@query(_PASSES)
def rollup_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over month-partitioned tables, each over what had arrived by then; both grains."""
    samples = spark.sql(_ARRIVING.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events"))
    rolled = {grain: MonthTable(spark, M.ROLLED, "bucket", name=f"rolled-{grain}") for grain in ("hour", "day")}
    raw, marks, before = MonthTable(spark, samples.schema, "sampled_at", name="samples"), dict.fromkeys(rolled), "arrived_at < timestamp_ntz'0001-01-01 00:00:00'"
    for now in (_FIRST, _SECOND):
        arrived = f"arrived_at <= {M.literal(now)}"
        raw.append(samples.where(f"{arrived} AND NOT ({before})"))
        marks = {grain: M.roll_months(table, raw, grain, marks[grain], now) for grain, table in rolled.items()}
        before = arrived
    hours, days = [table.read().withColumn("grain", F.lit(grain)) for grain, table in rolled.items()]
    return rounded(hours.unionByName(days), "mean_count")


# Samples spread over the twelve months before, so that months can be told apart.
_YEAR = """SELECT user_id % 10 AS game_id, ts - make_ym_interval(0, CAST(event_id % 12 AS INT)) AS sampled_at, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt, event_id FROM {events}"""
_YEAR_SQL = """year AS (SELECT user_id % 10 AS game_id, ts - to_months(CAST(event_id % 12 AS INT)) AS sampled_at, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt, event_id FROM events)"""


def _year(spark: SparkSession, d: str) -> MonthTable:
    samples = spark.sql(_YEAR, events=C.table(spark, d, "events"))
    table = MonthTable(spark, samples.schema, "sampled_at", name="year")
    table.append(samples)
    return table


@query(f"WITH {_YEAR_SQL} SELECT game_id, sampled_at, cnt, event_id FROM year WHERE sampled_at >= TIMESTAMP '2023-06-10' AND sampled_at < TIMESTAMP '2023-07-20' AND game_id = 3")
def raw_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A listing's raw samples of a span, from a month-partitioned table: two months are read."""
    return _year(spark, d).read(datetime(2023, 6, 10), datetime(2023, 7, 20)).where("game_id = 3")


@query(f"""WITH {_YEAR_SQL}, kept AS (SELECT CAST(date_trunc('month', sampled_at) AS DATE) AS m, count(*) AS n FROM year GROUP BY ALL)
SELECT m AS month, n AS samples, 'keep' AS action FROM kept WHERE m >= DATE '2023-05-01'
UNION ALL SELECT m, 0, 'drop' FROM kept WHERE m < DATE '2023-05-01'
UNION ALL SELECT CAST(unnest([DATE '2024-02-01', DATE '2024-03-01', DATE '2024-04-01']) AS DATE), 0, 'create'""")
def month_retention(spark: SparkSession, d: str) -> DataFrame:
    """Months that the plan lets go are dropped, coming ones created; then what each still holds."""
    table = _year(spark, d)
    there = spark.createDataFrame([(m,) for m in table.months()], "month date")
    boundary = spark.sql("SELECT 'raw' AS kind, timestamp_ntz'2023-05-10 00:00:00' AS boundary")
    done = M.apply_month_plan(table, M.month_plan(there, boundary, "timestamp_ntz'2024-01-31 00:00:00'", 3))
    held = table.read().groupBy(F.trunc("sampled_at", "month").alias("month")).agg(F.count("*").alias("samples"))
    return done.join(held, "month", "left").select("month", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), "action")


@query("""WITH m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'hour' ELSE 'day' END AS grain, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)
SELECT grain, max(t) AS rolled_up_through FROM m GROUP BY grain""")
def rollup_watermark(spark: SparkSession, d: str) -> DataFrame:
    marks = C.table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'hour' ELSE 'day' END AS grain", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS rolled_up_through")
    old, new = marks.where("o_orderkey % 3 = 0"), marks.where("o_orderkey % 3 <> 0")
    return M.greatest_watermarks(old.drop("o_orderkey"), new.drop("o_orderkey"))


_MARKS = """, mark AS (SELECT max(date_trunc('hour', sampled_at)) FILTER (WHERE source <> 'view') AS h, max(date_trunc('day', sampled_at)) AS d FROM presence)"""


def _boundaries(spark: SparkSession, d: str, days: tuple[int | None, int | None, int | None], now: str) -> DataFrame:
    samples = C.presence(spark, d)
    hour = samples.where("source <> 'view'").agg(F.max(P.bucket("hour")).alias("rolled_up_through")).withColumn("grain", F.lit("hour"))
    day = samples.agg(F.max(P.bucket("day")).alias("rolled_up_through")).withColumn("grain", F.lit("day"))
    return M.boundaries(hour.unionByName(day), now, *days)


@query(C.sql("presence") + _MARKS + """
SELECT 'raw' AS kind, least(TIMESTAMP '2024-04-05', h, d) AS boundary FROM mark
UNION ALL SELECT 'hour', least(TIMESTAMP '2024-01-10', d) FROM mark UNION ALL SELECT 'day', NULL""")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    """Raw samples could go by age, but wait for the rollups."""
    raw = _boundaries(spark, d, (60, None, None), "timestamp_ntz'2024-06-04 00:00:00'").where("kind = 'raw'")
    return raw.unionByName(_boundaries(spark, d, (None, 146, None), "timestamp_ntz'2024-06-04 00:00:00'").where("kind <> 'raw'"))


@query(C.sql("presence") + """, gone AS (SELECT least(TIMESTAMP '2024-01-10', CAST(max(date_trunc('day', sampled_at)) AS TIMESTAMP)) AS b FROM presence)
SELECT game_id, date_trunc('hour', sampled_at) AS bucket, count(*) AS samples FROM presence, gone
WHERE date_trunc('hour', sampled_at) >= b GROUP BY game_id, date_trunc('hour', sampled_at)""")
def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What stays of the hours when the plan's boundary is applied."""
    boundary = retention_plan(spark, d).where("kind = 'hour'").first()["boundary"]
    hours = P.rollup(C.presence(spark, d), "hour")
    kept = W.expired(hours, "bucket", M.literal(boundary))
    return kept.select("game_id", "bucket", (F.col("counted_samples") + F.col("unmeasurable_samples")).alias("samples"))


@query("""WITH there AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_on FROM orders),
coming AS (SELECT CAST(unnest([DATE '1998-06-01', DATE '1998-07-01', DATE '1998-08-01', DATE '1998-09-01', DATE '1998-10-01']) AS DATE) AS month_on),
every AS (SELECT t.month_on IS NOT NULL AS is_there, coalesce(t.month_on, c.month_on) AS month_on FROM there t FULL JOIN coming c ON c.month_on = t.month_on)
SELECT month_on AS month, CASE WHEN NOT is_there THEN 'create' WHEN month_on + INTERVAL 1 MONTH <= TIMESTAMP '1998-03-15' THEN 'drop' ELSE 'keep' END AS action FROM every""")
def partition_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    months = C.table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"))
    marks = spark.sql("SELECT grain, timestamp_ntz'1998-03-15 00:00:00' AS rolled_up_through FROM VALUES ('hour'), ('day') AS t(grain)")
    return M.month_plan(months, M.boundaries(marks, "timestamp_ntz'1998-06-10 00:00:00'", 56), "timestamp_ntz'1998-06-10 00:00:00'", 4)


_WRITES = """SELECT event_id, user_id AS game_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) - 3 END AS cnt,
  CASE WHEN event_type = 'error' AND event_id % 3 <> 0 OR event_id % 11 = 0 THEN 'who_not_offered' END AS reason, event_id % 7 <> 0 AS reached FROM events"""


@query(f"""WITH w AS ({_WRITES})
SELECT * FROM w WHERE reached AND CASE WHEN cnt IS NULL THEN reason IS NOT NULL ELSE cnt >= 0 AND reason IS NULL END""")
def presence_write_checks(spark: SparkSession, d: str) -> DataFrame:
    return M.sound_samples(spark.sql(_WRITES.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events")))


@query(C.sql("dense") + """ SELECT game_id, date_trunc('day', sampled_at) AS bucket, count(cnt) AS counted_samples, max(cnt) AS max_count FROM presence
WHERE date_trunc('day', sampled_at) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY ALL""")
def series_range(spark: SparkSession, d: str) -> DataFrame:
    """Daily buckets from one day to another, both in it."""
    rolled = P.rollup(C.presence(spark, d, dense=True), "day")
    return M.series(rolled, "timestamp_ntz'2024-01-05 00:00:00'", "timestamp_ntz'2024-01-12 00:00:00'").select("game_id", "bucket", "counted_samples", "max_count")
