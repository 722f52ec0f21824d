"""Keeping rollups up to date: what a pass reads, where it stops, and what may go afterwards.

A pass rolls whole hours only and re-reads the last three before its watermark, so rows that come
that late still count; rows later than that are in the samples but not in the rollups. Nothing goes
that a coarser grain has not read.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import presence as P
from tidegauge.operators.writes import replace_range
from tidegauge.sources.months import MonthTable, month_after, month_of

OVERLAP = timedelta(hours=3)
#: The fewest days that may be kept of each grain.
LEAST_DAYS = {"raw": 56, "hour": 56, "day": 365}


def truncated(grain: str, at: datetime) -> datetime:
    hour = at.replace(minute=0, second=0, microsecond=0)
    return hour.replace(hour=0) if grain == "day" else hour


def span_to_roll(grain: str, watermark: datetime | None, earliest: datetime | None, now: datetime) -> tuple[datetime, datetime] | None:
    """Half-open span of a pass, or None: nothing was ever measured, or no hour has ended since."""
    resume = watermark or earliest
    if resume is None:
        return None
    low, high = truncated(grain, resume - OVERLAP), truncated("hour", now)
    return (low, high) if low < high else None


def literal(at: datetime) -> str:
    return f"timestamp_ntz'{at.isoformat(sep=' ')}'"


def roll(rolled: DataFrame, samples: DataFrame, grain: str, watermark: datetime | None, now: datetime) -> tuple[DataFrame, datetime | None]:
    """The rollups after a pass, and the watermark to store once they are written.

    The span is two literals, so it prunes the partitions and row groups of both tables. Running a
    pass again, or after one that died before its watermark was stored, gives the same rows. A
    watermark never goes back.
    """
    earliest = None if watermark else samples.agg(F.min("sampled_at")).first()[0]
    span = span_to_roll(grain, watermark, earliest, now)
    if span is None:
        return rolled, watermark
    low, high = map(literal, span)
    new = P.rollup(samples.where(f"sampled_at >= {low} AND sampled_at < {high}"), grain)
    return replace_range(rolled, new, low, high), max(span[1], watermark or span[1])


ROLLED = "game_id long, bucket timestamp_ntz, counted_samples long, unmeasurable_samples long, min_count int, max_count int, sum_count long, mean_count double"


def roll_months(rolled: MonthTable, samples: MonthTable, grain: str, watermark: datetime | None, now: datetime) -> datetime | None:
    """A pass over stored months: reads those of the span, rewrites those alone, returns the watermark to store.

    Without a watermark the span begins with the first sample, looked up in the first month that has one.
    """
    earliest = None
    for month in [] if watermark else samples.months():
        start = datetime.combine(month, datetime.min.time())
        earliest = samples.read(start, datetime.combine(month_after(month), datetime.min.time())).agg(F.min(samples.at)).first()[0]
        if earliest is not None:
            break
    span = span_to_roll(grain, watermark, earliest, now)
    if span is None:
        return watermark
    low, high = span
    months = datetime.combine(month_of(low), datetime.min.time()), datetime.combine(month_after(month_of(high - timedelta(microseconds=1))), datetime.min.time())
    rolled.overwrite(replace_range(rolled.read(*months), P.rollup(samples.read(low, high), grain), literal(low), literal(high)))
    return max(high, watermark or high)


def apply_month_plan(table: MonthTable, plan: DataFrame) -> DataFrame:
    """Create and drop the months that ``month_plan`` names (a row for each month there is or will be); the plan as it was carried out."""
    done = plan.collect()
    table.create(*[r.month for r in done if r.action == "create"])
    table.drop(*[r.month for r in done if r.action == "drop"])
    return plan.sparkSession.createDataFrame(done, plan.schema)


def greatest_watermarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(grain, rolled_up_through)`` of both; of two for one grain the later stays."""
    return old.unionByName(new).groupBy("grain").agg(F.max("rolled_up_through").alias("rolled_up_through"))


def boundaries(watermarks: DataFrame, now: str, raw_days: int | None = None, hour_days: int | None = None, day_days: int | None = None) -> DataFrame:
    """``(kind, boundary)``: what lies before it may go; null if nothing may.

    Raw samples wait for the slower of both grains, hours for the days. Without a number of days a kind is kept for ever.
    """
    for kind, days in {"raw": raw_days, "hour": hour_days, "day": day_days}.items():
        if days is not None and days < LEAST_DAYS[kind]:
            raise ValueError(f"{kind}: {days} days are fewer than the {LEAST_DAYS[kind]} that readers rely on")
    through = lambda g: F.max(F.when(F.col("grain") == g, F.col("rolled_up_through")))
    marks = watermarks.agg(through("hour").alias("h"), through("day").alias("d"))
    before = lambda days: F.lit(None).cast("timestamp_ntz") if days is None else F.expr(f"{now} - INTERVAL {days} DAYS")
    both = lambda a, *read: F.when(F.greatest(*[x.isNull().cast("int") for x in (a, *read)], F.lit(0)) == 0, F.least(a, *read))
    h, d = F.col("h"), F.col("d")
    named = F.array(
        F.struct(F.lit("raw").alias("kind"), both(before(raw_days), h, d).alias("boundary")),
        F.struct(F.lit("hour").alias("kind"), both(before(hour_days), d, d).alias("boundary")),
        F.struct(F.lit("day").alias("kind"), before(day_days).alias("boundary")),
    )
    return marks.select(F.inline(named))


def month_plan(months: DataFrame, boundary: DataFrame, now: str, ahead: int = 2) -> DataFrame:
    """``(month, action)``: ``drop`` for months that end at or before the raw boundary, ``create`` for coming ones not there, else ``keep``."""
    if ahead < 1:
        raise ValueError("at least one month must exist ahead")
    first = F.expr(f"CAST(date_trunc('month', {now}) AS DATE)")
    coming = months.sparkSession.range(1).select(F.explode(F.sequence(first, F.add_months(first, ahead), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    raw = boundary.where("kind = 'raw'").select("boundary")
    there = months.select("month").distinct().withColumn("there", F.lit(True))
    every = there.join(coming.withColumn("coming", F.lit(True)), "month", "full").crossJoin(F.broadcast(raw))
    over = F.add_months("month", 1).cast("timestamp_ntz") <= F.col("boundary")
    return every.select("month", F.when(F.col("there").isNull(), "create").when(over, "drop").otherwise("keep").alias("action"))


def sound_samples(rows: DataFrame) -> DataFrame:
    """Rows that may be written: a count of 0 or more without a reason, or no count and a reason; a failed probe writes none."""
    counted = F.col("cnt").isNotNull() & (F.col("cnt") >= 0) & F.col("reason").isNull()
    return rows.where(F.col("reached") & (counted | (F.col("cnt").isNull() & F.col("reason").isNotNull())))


def series(rolled: DataFrame, low: str, high: str, game_id: int | None = None) -> DataFrame:
    """Rollups of a range of buckets, both ends in it."""
    found = rolled.where(f"bucket BETWEEN {low} AND {high}")
    return found if game_id is None else found.where(F.col("game_id") == game_id)
