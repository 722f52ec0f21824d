"""When it is busy and when quiet: hours of the day, weekdays, and runs of counted days.

Windows run over at most 24 hours or the days of one listing, after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUSY_SHARE, QUIET_SHARE, QUIET_LEAST, QUIET_HOURS = 0.75, 0.10, 0.5, 2


def hour_means(samples: DataFrame) -> DataFrame:
    """``(game_id, hour, mean)`` of hours of the day with counted samples."""
    sums = samples.where("cnt IS NOT NULL").groupBy("game_id", F.hour("sampled_at").alias("hour")).agg(F.sum("cnt").alias("total"), F.count("*").alias("n"))
    return sums.select("game_id", "hour", (F.col("total") / F.col("n")).alias("mean"))


def longest_run(rows: DataFrame, keys: list[str], place: str, holds: Column) -> DataFrame:
    """``(first, last, length)`` of the longest run of neighbouring places where ``holds``, the first of equals."""
    order = Window.partitionBy(*keys).orderBy(place)
    runs = rows.where(holds).withColumn("run", F.col(place) - F.row_number().over(order)).groupBy(*keys, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    length = F.col("last") - F.col("first") + 1
    best = F.max_by(F.struct("first", "last", length.alias("length")), F.struct(length, -F.col("first")))
    return runs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def busiest_hours(samples: DataFrame) -> DataFrame:
    """The longest run of hours whose mean is three quarters of the best one or more; no run where all are 0."""
    top = hour_means(samples).withColumn("top", F.max("mean").over(Window.partitionBy("game_id")))
    return longest_run(top, ["game_id"], "hour", (F.col("top") > 0) & (F.col("mean") >= F.col("top") * BUSY_SHARE))


def quietest_hours(samples: DataFrame) -> DataFrame:
    """The longest run, of two hours or more, of hours at 0; where none is at 0, of those under a tenth of the best or a half player."""
    whole = Window.partitionBy("game_id")
    rows = hour_means(samples).withColumn("top", F.max("mean").over(whole)).withColumn("low", F.min("mean").over(whole))
    quiet = F.when(F.col("low") == 0, F.col("mean") == 0).otherwise(F.col("mean") < F.greatest(F.lit(QUIET_LEAST), F.col("top") * QUIET_SHARE))
    return longest_run(rows, ["game_id"], "hour", quiet).where(F.col("length") >= QUIET_HOURS)


def weekday_lines(samples: DataFrame) -> DataFrame:
    """Per weekday (Sunday is 0): extremes, the first hour of the largest mean, hours without samples, and uncountable samples."""
    cell = samples.groupBy("game_id", (F.dayofweek("sampled_at") - 1).alias("dow"), F.hour("sampled_at").alias("hour")).agg(
        F.min("cnt").alias("low"), F.max("cnt").alias("high"), F.sum("cnt").alias("total"), F.count("cnt").alias("n"), F.count_if(F.col("cnt").isNull()).alias("bad"),
    )
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    return cell.groupBy("game_id", "dow").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("hour", F.when(F.col("n") > 0, F.struct(mean, -F.col("hour")))).alias("peak_hour"),
        (F.lit(24) - F.count("*")).alias("gaps"), F.sum("bad").alias("uncountable"),
    )


def counted_runs(samples: DataFrame) -> DataFrame:
    """Runs of days in a row with a counted sample, with the days missing before each (null before the first)."""
    days = samples.where("cnt IS NOT NULL").select("game_id", F.col("sampled_at").cast("date").alias("day")).distinct()
    order = Window.partitionBy("game_id").orderBy("day")
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(order))).groupBy("game_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    before = F.lag("last_day").over(Window.partitionBy("game_id").orderBy("first_day"))
    return runs.select("game_id", "first_day", "last_day", (F.datediff("first_day", before) - 1).alias("missing_before"))
