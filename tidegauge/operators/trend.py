"""How that changes: least-squares growth over daily medians, the trending board, day series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEADY_BAND = 0.10
MINIMUM_DAYS = 3


def growth(days: DataFrame) -> DataFrame:
    """``fraction``, ``direction`` and whole ``players`` of the fitted rise; null under three days.

    ``days(game_id, day, median)`` has one row a day. The rise is rounded to nine places before
    it is taken to whole players, so that the last bit of a sum does not make a player.
    """
    x, y = F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double"), F.col("median").cast("double")
    fit = days.groupBy("game_id").agg(
        F.count("*").alias("n_days"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.avg(y).alias("mean"), (F.max(x) - F.min(x)).alias("span"),
        F.min_by("median", "day").alias("earliest"), F.max_by("median", "day").alias("latest"),
    )
    rise = F.round(F.col("slope") * F.col("span"), 9)
    enough = F.col("n_days") >= MINIMUM_DAYS
    fraction = F.when(enough, F.when(F.col("mean") == 0, 0.0).otherwise(rise / F.col("mean")))
    out = fit.withColumn("fraction", fraction).withColumn("players", F.when(enough, F.when(rise >= 0, F.ceil(rise)).otherwise(F.floor(rise))))
    direction = F.when(F.col("fraction") > STEADY_BAND, "up").when(F.col("fraction") < -STEADY_BAND, "down").when(F.col("fraction").isNotNull(), "steady")
    return out.select("game_id", "n_days", "fraction", direction.alias("direction"), "players", "earliest", "latest")


def trending(days: DataFrame, games: DataFrame, limit: int = 20) -> DataFrame:
    """Chosen by fraction, ordered by players gained."""
    up = growth(days).where(F.col("fraction") > STEADY_BAND).join(games.select(F.col("id").alias("game_id"), "slug", "name"), "game_id")
    return up.select("slug", "name", "earliest", "latest", "players").orderBy(F.desc("players"), F.desc("latest"), "name").limit(limit)


def upper_median(values: Column) -> Column:
    """The upper middle of an array: for day averages, unlike for counts."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.size(ordered) / 2).cast("int") + 1))


def series_summary(daily: DataFrame) -> DataFrame:
    """Per listing over ``(game_id, day, mean, peak)``: middle day, peak, counted days, first and last thirds."""
    place = Window.partitionBy("game_id").orderBy("day")
    whole = Window.partitionBy("game_id")
    counted = daily.where("mean IS NOT NULL").withColumn("i", F.row_number().over(place) - 1).withColumn("n", F.count("*").over(whole))
    third = F.floor(F.col("n") / 3)
    out = counted.groupBy("game_id").agg(
        upper_median(F.collect_list("mean")).alias("middle"), F.max("peak").alias("peak"), F.max("n").alias("days"),
        F.avg(F.when(F.col("i") < third, F.col("mean"))).alias("first_third"), F.avg(F.when(F.col("i") >= F.col("n") - third, F.col("mean"))).alias("last_third"),
    )
    change = F.when((F.col("days") >= 6) & (F.col("first_third") > 0), F.col("last_third") / F.col("first_third") - 1)
    direction = F.when(change > STEADY_BAND, "up").when(change < -STEADY_BAND, "down").when(change.isNotNull(), "steady")
    return out.withColumn("direction", direction)
