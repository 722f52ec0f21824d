"""Presence and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import presence as P
from tidegauge.operators import trend as T
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

NOW, LATE = C.NOW, "timestamp_ntz'2024-01-29 12:00:00'"
_ROLLED = """, rolled AS (
  SELECT game_id, date_trunc('{0}', sampled_at) AS bucket, count(cnt) AS counted_samples, count(*) - count(cnt) AS unmeasurable_samples,
         min(cnt) AS min_count, max(cnt) AS max_count, CAST(sum(cnt) AS BIGINT) AS sum_count FROM presence GROUP BY ALL)"""
_MEDIAN = """, summed AS (SELECT game_id, cnt AS value, count(*) AS times FROM presence WHERE cnt IS NOT NULL GROUP BY ALL),
walked AS (SELECT game_id, value, sum(times) OVER (PARTITION BY game_id ORDER BY value) AS running, sum(times) OVER (PARTITION BY game_id) AS total FROM summed)
SELECT game_id, min(value) FILTER (WHERE running >= ceil(total / 2)) AS median, max(value) AS peak, CAST(max(total) AS BIGINT) AS samples FROM walked GROUP BY game_id"""
_DAYS = """, days AS (
  SELECT game_id, CAST(sampled_at AS DATE) AS day_on, CAST(quantile_disc(cnt, 0.5) AS INT) AS median, count(cnt) AS samples
  FROM presence WHERE sampled_at >= TIMESTAMP '2024-01-17 00:00:00' AND cnt IS NOT NULL GROUP BY ALL HAVING count(cnt) >= 6)"""
_GROWTH = _DAYS + """, fit AS (
  SELECT game_id, count(*) AS n_days, coalesce(regr_slope(CAST(median AS DOUBLE), CAST(datediff('day', DATE '2000-01-01', day_on) AS DOUBLE)), 0) AS slope,
         avg(median) AS mean, max(datediff('day', DATE '2000-01-01', day_on)) - min(datediff('day', DATE '2000-01-01', day_on)) AS span,
         min_by(median, day_on) AS earliest, max_by(median, day_on) AS latest FROM days GROUP BY game_id),
grown AS (
  SELECT game_id, n_days, round(slope * span, 9) AS rise, earliest, latest,
         CASE WHEN n_days >= 3 THEN CASE WHEN mean = 0 THEN 0.0 ELSE round(slope * span, 9) / mean END END AS fraction FROM fit)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@query(C.sql("dense") + _ROLLED.format("hour") + " SELECT *, round(CAST(sum_count AS DOUBLE) / nullif(counted_samples, 0), 6) AS mean_count FROM rolled")
def rollup_hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.rollup(C.presence(spark, d, dense=True), "hour"), "mean_count")


@query(C.sql("presence") + _ROLLED.format("day") + " SELECT *, round(CAST(sum_count AS DOUBLE) / nullif(counted_samples, 0), 6) AS mean_count FROM rolled")
def rollup_day(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.rollup(C.presence(spark, d), "day"), "mean_count")


@query(C.sql("presence") + """, day_rows AS (SELECT game_id % 6 AS k, date_trunc('day', sampled_at) AS b, count(cnt) > 0 AS counted FROM presence GROUP BY game_id, date_trunc('day', sampled_at)),
broken AS (SELECT count(*) FILTER (WHERE k = 1) AS a, count(*) FILTER (WHERE k IN (1, 2) AND counted) AS b, count(*) FILTER (WHERE k = 3 AND counted) AS c,
  count(*) FILTER (WHERE k = 4) AS d, count(*) FILTER (WHERE k IN (1, 5) AND counted) AS e, count(*) AS n FROM day_rows)
SELECT rule, CASE rule WHEN 'some_samples' THEN a WHEN 'extremes_iff_counted' THEN b WHEN 'ordered' THEN c WHEN 'on_the_bucket' THEN d ELSE e END AS violations, n AS row_count
FROM broken, (VALUES ('some_samples'), ('extremes_iff_counted'), ('ordered'), ('on_the_bucket'), ('histogram_total')) AS r(rule)""")
def rollup_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Over rollups in which the rows of five in six listings break one rule or more."""
    k = F.col("game_id") % 6
    rolled = P.rollup_with_histogram(C.presence(spark, d), "day").withColumns({
        "counted_samples": F.when(k == 1, 0).otherwise(F.col("counted_samples")), "unmeasurable_samples": F.when(k == 1, 0).otherwise(F.col("unmeasurable_samples")),
        "min_count": F.when(k == 2, F.lit(None)).when((k == 3) & F.col("min_count").isNotNull(), -1).otherwise(F.col("min_count")),
        "bucket": F.when(k == 4, F.col("bucket") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("bucket")),
        "count_histogram": F.when(k == 5, F.create_map().cast("map<int,bigint>")).otherwise(F.col("count_histogram")),
    })
    return P.rollup_violations(rolled)


@query(C.sql("presence") + " SELECT game_id, date_trunc('day', sampled_at) AS bucket, cnt AS value, count(*) AS times FROM presence WHERE cnt IS NOT NULL GROUP BY ALL")
def histogram_explode(spark: SparkSession, d: str) -> DataFrame:
    return P.expanded(P.rollup_with_histogram(C.presence(spark, d), "day"))


@query(C.sql("dense") + _MEDIAN)
def window_median_hist(spark: SparkSession, d: str) -> DataFrame:
    return P.discrete_median(P.histogram(C.presence(spark, d, dense=True)), "game_id")


@query(C.sql("dense") + " SELECT game_id, quantile_disc(cnt, 0.5) AS median, max(cnt) AS peak, count(cnt) AS samples FROM presence WHERE cnt IS NOT NULL GROUP BY game_id")
def window_median_disc(spark: SparkSession, d: str) -> DataFrame:
    samples = C.presence(spark, d, dense=True).where("cnt IS NOT NULL")
    return samples.groupBy("game_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cnt)").cast("int").alias("median"), F.max("cnt").alias("peak"), F.count("cnt").alias("samples"))


@query(C.sql("dense") + _MEDIAN)
def hybrid_scan(spark: SparkSession, d: str) -> DataFrame:
    samples = C.presence(spark, d, dense=True)
    watermark = "timestamp_ntz'2024-01-20 12:00:00'"
    rolled = P.expanded(P.rollup_with_histogram(samples.where(f"sampled_at < {watermark}"), "hour"))
    return P.discrete_median(P.hybrid(rolled, samples, watermark), "game_id")


@query(C.sql("dense") + _DAYS + " SELECT game_id, day_on AS day, median, samples FROM days")
def daily_medians(spark: SparkSession, d: str) -> DataFrame:
    return P.daily_medians(C.presence(spark, d, dense=True), f"date_trunc('day', {NOW} - INTERVAL 14 DAYS)")


@query(C.sql("dense") + _GROWTH + """
SELECT game_id, n_days, round(fraction, 6) AS fraction,
       CASE WHEN fraction > 0.10 THEN 'up' WHEN fraction < -0.10 THEN 'down' WHEN fraction IS NOT NULL THEN 'steady' END AS direction,
       CAST(CASE WHEN n_days >= 3 THEN CASE WHEN rise >= 0 THEN ceil(rise) ELSE floor(rise) END END AS BIGINT) AS players, earliest, latest FROM grown""")
def growth_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.growth(daily_medians(spark, d)), "fraction")


@query(C.sql("dense", "game") + _GROWTH + """
SELECT slug, name, earliest, latest, CAST(CASE WHEN rise >= 0 THEN ceil(rise) ELSE floor(rise) END AS BIGINT) AS players
FROM grown JOIN game g ON g.id = grown.game_id WHERE fraction > 0.10 ORDER BY players DESC, latest DESC, name LIMIT 20""")
def trending(spark: SparkSession, d: str) -> DataFrame:
    return T.trending(daily_medians(spark, d), C.games(spark, d))


_CELLS = """, cells AS (
  SELECT CAST(extract(dow FROM sampled_at) AS INT) AS dow, CAST(extract(hour FROM sampled_at) AS INT) AS hod, count(*) AS samples, count(cnt) AS counted,
         CAST(sum(cnt) AS BIGINT) AS total FROM presence GROUP BY ALL),
cell AS (SELECT *, round_even(CAST(total AS DOUBLE) / nullif(counted, 0), 0) AS mean FROM cells)"""


@query(C.sql("presence") + _CELLS + " SELECT * FROM cell")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return P.heatmap(C.presence(spark, d), NOW)


@query(C.sql("presence") + _CELLS + """
SELECT CAST(g.id // 24 AS INT) AS dow, CAST(g.id % 24 AS INT) AS hod, samples, mean FROM range(168) AS g(id)
LEFT JOIN cell ON cell.dow = g.id // 24 AND cell.hod = g.id % 24""")
def heatmap_dense_grid(spark: SparkSession, d: str) -> DataFrame:
    return P.dense_grid(P.heatmap(C.presence(spark, d), NOW))


_DIGEST = """, digest AS (
  SELECT game_id, max_by(cnt, sampled_at) FILTER (WHERE cnt IS NOT NULL AND sampled_at > TIMESTAMP '2024-01-29 10:00:00') AS players,
         max(sampled_at) FILTER (WHERE cnt IS NOT NULL AND sampled_at > TIMESTAMP '2024-01-29 10:00:00') AS counted_at,
         max_by(source, sampled_at) FILTER (WHERE cnt IS NOT NULL AND sampled_at > TIMESTAMP '2024-01-29 10:00:00') AS source,
         count(*) FILTER (WHERE cnt > 0) AS nonzero, count(cnt) AS counted, count(*) - count(cnt) AS uncountable
  FROM presence WHERE sampled_at > TIMESTAMP '2024-01-22 12:00:00' AND sampled_at <= TIMESTAMP '2024-01-29 12:00:00' GROUP BY game_id)"""


@query(C.sql("presence") + _DIGEST + " SELECT *, uncountable > 0 AND counted = 0 AS uncounted FROM digest")
def presence_digest(spark: SparkSession, d: str) -> DataFrame:
    return P.digest(C.presence(spark, d), LATE)


_BUSIEST = """, bucket AS (
  SELECT p.game_id, g.slug, g.name, date_trunc('day', p.sampled_at) AS b, p.cnt FROM presence p JOIN listed_game g ON g.id = p.game_id
  WHERE p.cnt IS NOT NULL AND p.sampled_at >= TIMESTAMP '2024-01-02 00:00:00'),
eligible AS (
  SELECT game_id, slug, name, count(*) AS samples, count(DISTINCT b) AS days, quantile_disc(cnt, 0.5) AS median, max(cnt) AS peak
  FROM bucket GROUP BY ALL HAVING count(*) >= 24 AND count(DISTINCT b) >= 15)
SELECT slug, name, median, peak, samples, days, (SELECT count(*) FROM eligible) AS eligible,
       CAST(row_number() OVER (ORDER BY median DESC, peak DESC, name) AS INT) AS place
FROM eligible ORDER BY median DESC, peak DESC, name LIMIT 20"""


@query(C.sql("presence", "game") + _BUSIEST)
def busiest_30d(spark: SparkSession, d: str) -> DataFrame:
    shown = C.listed(C.public(C.games(spark, d), C.merges(spark, d)))
    since = "timestamp_ntz'2024-01-02 00:00:00'"  # the start of a day, so that samples are left out as they are read
    rolled = P.rollup_with_histogram(C.presence(spark, d).where(f"sampled_at >= {since}"), "day")
    return P.busiest(rolled, shown, since, 15)


@query(C.sql("presence") + """, daily AS (
  SELECT game_id, CAST(sampled_at AS DATE) AS day_on, avg(cnt) AS mean, max(cnt) AS peak FROM presence GROUP BY ALL),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY day_on) - 1 AS i, count(*) OVER (PARTITION BY game_id) AS n FROM daily WHERE mean IS NOT NULL),
summary AS (
  SELECT game_id, list_sort(list(mean))[CAST(floor(count(*) / 2) AS INT) + 1] AS middle, max(peak) AS peak, max(n) AS days,
         avg(mean) FILTER (WHERE i < n // 3) AS first_third, avg(mean) FILTER (WHERE i >= n - n // 3) AS last_third FROM counted GROUP BY game_id)
SELECT game_id, round(middle, 6) AS middle, peak, days, round(first_third, 6) AS first_third, round(last_third, 6) AS last_third,
       CASE WHEN days >= 6 AND first_third > 0 THEN CASE WHEN last_third / first_third - 1 > 0.10 THEN 'up' WHEN last_third / first_third - 1 < -0.10 THEN 'down' ELSE 'steady' END END AS direction
FROM summary""")
def day_series(spark: SparkSession, d: str) -> DataFrame:
    daily = C.presence(spark, d).groupBy("game_id", F.col("sampled_at").cast("date").alias("day")).agg(F.avg("cnt").alias("mean"), F.max("cnt").alias("peak"))
    return rounded(T.series_summary(daily), "middle", "first_third", "last_third")
