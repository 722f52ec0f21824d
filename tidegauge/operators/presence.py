"""How busy: rollups, mergeable histograms, discrete medians, digests and heat-maps.

A sample counted players (``cnt``, zero included) or could not (null). A bucket without samples
has no row. Medians are the lower middle, and come from summed histograms, so rolled and raw
samples mix freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINIMUM_DAY_SAMPLES = 6
MINIMUM_RANKED_SAMPLES = 24


def bucket(grain: str, at: Column | str = "sampled_at") -> Column:
    """UTC hour or day of a timestamp."""
    return F.date_trunc(grain, F.col(at) if isinstance(at, str) else at).cast("timestamp_ntz")


def rollup(samples: DataFrame, grain: str) -> DataFrame:
    """One row per listing and bucket: tallies, extremes, sum, and the tally-weighted mean."""
    n, total = F.count("cnt"), F.sum("cnt")
    return samples.groupBy("game_id", bucket(grain).alias("bucket")).agg(
        n.alias("counted_samples"), F.count_if(F.col("cnt").isNull()).alias("unmeasurable_samples"),
        F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"), total.alias("sum_count"),
        (total / F.nullif(n, F.lit(0))).alias("mean_count"),
    )


def histogram(samples: DataFrame, grain: str | None = None) -> DataFrame:
    """How often each count was seen, per listing and, with a grain, bucket."""
    keys = ["game_id"] + ([bucket(grain).alias("bucket")] if grain else [])
    return samples.where("cnt IS NOT NULL").groupBy(*keys, F.col("cnt").alias("value")).agg(F.count("*").alias("times"))


def rollup_with_histogram(samples: DataFrame, grain: str) -> DataFrame:
    """The rollup with ``count_histogram``, a map of count to times, built in two aggregations."""
    each = samples.groupBy("game_id", bucket(grain).alias("bucket"), "cnt").agg(F.count("*").alias("times"))
    counted = F.when(F.col("cnt").isNotNull(), F.col("times"))
    entries = F.collect_list(F.when(F.col("cnt").isNotNull(), F.struct(F.col("cnt").alias("key"), F.col("times").alias("value"))))
    return each.groupBy("game_id", "bucket").agg(
        F.coalesce(F.sum(counted), F.lit(0)).alias("counted_samples"),
        F.coalesce(F.sum(F.when(F.col("cnt").isNull(), F.col("times"))), F.lit(0)).alias("unmeasurable_samples"),
        F.min("cnt").alias("min_count"), F.max("cnt").alias("max_count"), F.sum(F.col("cnt") * F.col("times")).alias("sum_count"),
        F.map_from_entries(F.sort_array(entries)).alias("count_histogram"),
    )


def expanded(rolled: DataFrame) -> DataFrame:
    """Rollup maps as ``(game_id, bucket, value, times)`` rows."""
    return rolled.select("game_id", "bucket", F.explode("count_histogram").alias("value", "times"))


def discrete_median(frequency: DataFrame, *keys: str) -> DataFrame:
    """``median``, ``peak`` and ``samples`` of each key from ``(value, times)`` rows, any of them repeated."""
    summed = frequency.groupBy(*keys, "value").agg(F.sum("times").alias("times"))
    whole = Window.partitionBy(*keys)
    walked = summed.withColumn("running", F.sum("times").over(whole.orderBy("value"))).withColumn("total", F.sum("times").over(whole))
    return walked.groupBy(*keys).agg(
        F.min(F.when(F.col("running") >= F.ceil(F.col("total") / 2), F.col("value"))).alias("median"),
        F.max("value").alias("peak"), F.max("total").alias("samples"),
    )


def hybrid(rolled: DataFrame, samples: DataFrame, watermark: str) -> DataFrame:
    """Frequencies of rolled buckets before the watermark and of raw samples from it on."""
    before = rolled.where(f"bucket < {watermark}").select("game_id", "value", "times")
    after = samples.where(f"sampled_at >= {watermark} AND cnt IS NOT NULL").select("game_id", F.col("cnt").alias("value"), F.lit(1).cast("long").alias("times"))
    return before.unionByName(after)


def daily_medians(samples: DataFrame, since: str, minimum: int = MINIMUM_DAY_SAMPLES) -> DataFrame:
    """``(game_id, day, median, samples)`` of days with enough samples."""
    found = discrete_median(histogram(samples.where(f"sampled_at >= {since}"), "day"), "game_id", "bucket")
    return found.where(F.col("samples") >= minimum).select("game_id", F.col("bucket").cast("date").alias("day"), "median", "samples")


def middle(entries: Column, total: Column) -> Column:
    """The lower middle of values given as ``(key, value)`` entries of value and times, any of them repeated."""
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("int").alias("at"))

    def step(a: Column, e: Column) -> Column:
        run = a["run"] + e["value"]
        return F.struct(run.alias("run"), F.coalesce(a["at"], F.when(run >= F.ceil(total / 2), e["key"])).alias("at"))

    return F.aggregate(F.array_sort(entries), start, step)["at"]


def busiest(rolled: DataFrame, games: DataFrame, since: str, minimum_days: int, limit: int = 20) -> DataFrame:
    """The ranking board, from rollups alone and in one pass over them; ``eligible`` counts all that could be ranked.

    A listing's histograms come together as entries, as many as its days have different counts.
    """
    window = rolled.where(f"bucket >= {since} AND size(count_histogram) > 0")
    each = window.groupBy("game_id").agg(
        F.sum("counted_samples").alias("samples"), F.count("*").alias("days"), F.max("max_count").alias("peak"), F.flatten(F.collect_list(F.map_entries("count_histogram"))).alias("entries")
    )
    able = each.where((F.col("samples") >= MINIMUM_RANKED_SAMPLES) & (F.col("days") >= minimum_days))
    ranked = able.join(games.select(F.col("id").alias("game_id"), "slug", "name"), "game_id").withColumn("median", middle(F.col("entries"), F.col("samples")))
    top = ranked.orderBy(F.desc("median"), F.desc("peak"), "name").limit(limit)
    out = top.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("eligible"))))
    place = F.row_number().over(Window.orderBy(F.desc("median"), F.desc("peak"), "name"))  # at most ``limit`` rows
    return out.select("slug", "name", "median", "peak", "samples", "days", "eligible", place.alias("place"))


def digest(samples: DataFrame, now: str, fresh: str = "INTERVAL 2 HOURS", week: str = "INTERVAL 7 DAYS") -> DataFrame:
    """Latest fresh count, and this week's tallies, in one pass."""
    recent = F.expr(f"cnt IS NOT NULL AND sampled_at > {now} - {fresh} AND sampled_at <= {now}")
    latest = F.max_by(F.when(recent, F.struct("cnt", "sampled_at", "source")), F.when(recent, F.col("sampled_at")))
    seen = samples.where(f"sampled_at > {now} - {week} AND sampled_at <= {now}").groupBy("game_id").agg(
        latest.alias("latest"), F.count_if(F.col("cnt") > 0).alias("nonzero"), F.count("cnt").alias("counted"),
        F.count_if(F.col("cnt").isNull()).alias("uncountable"),
    )
    uncounted = (F.col("uncountable") > 0) & (F.col("counted") == 0)
    return seen.select("game_id", F.col("latest.cnt").alias("players"), F.col("latest.sampled_at").alias("counted_at"), F.col("latest.source").alias("source"), "nonzero", "counted", "uncountable", uncounted.alias("uncounted"))


def heatmap(samples: DataFrame, now: str, days: int = 56) -> DataFrame:
    """Samples and rounded mean by weekday (Sunday is 0) and hour, weighted by tallies."""
    cells = samples.where(f"sampled_at >= {now} - INTERVAL {days} DAYS").groupBy((F.dayofweek("sampled_at") - 1).alias("dow"), F.hour("sampled_at").alias("hod"))
    out = cells.agg(F.count("*").alias("samples"), F.count("cnt").alias("counted"), F.sum("cnt").alias("total"))
    return out.withColumn("mean", F.bround(F.col("total") / F.nullif(F.col("counted"), F.lit(0)), 0))


def dense_grid(cells: DataFrame) -> DataFrame:
    """All 168 weekday hours; those without samples have null means and no tallies."""
    spark = cells.sparkSession
    grid = spark.range(168).select(F.expr("CAST(id DIV 24 AS INT)").alias("dow"), (F.col("id") % 24).cast("int").alias("hod"))
    return grid.join(cells, ["dow", "hod"], "left").select("dow", "hod", "samples", "mean")


def rollup_violations(rolled: DataFrame) -> DataFrame:
    """How many rollup rows break each rule of the table."""
    rules = {
        "some_samples": "counted_samples + unmeasurable_samples < 1",
        "extremes_iff_counted": "(counted_samples > 0) <> (min_count IS NOT NULL) OR (min_count IS NULL) <> (sum_count IS NULL)",
        "ordered": "min_count < 0 OR min_count > max_count OR max_count > sum_count",
        "on_the_bucket": "bucket <> CAST(date_trunc('day', bucket) AS TIMESTAMP_NTZ)",
        "histogram_total": "aggregate(map_values(count_histogram), 0L, (a, x) -> a + x) <> counted_samples",
    }
    counts = rolled.agg(*[F.count_if(F.expr(e)).alias(k) for k, e in rules.items()], F.count("*").alias("row_count"))
    return counts.unpivot(["row_count"], list(rules), "rule", "violations").select("rule", "violations", "row_count")
