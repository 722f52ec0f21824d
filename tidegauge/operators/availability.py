"""How reliably it answers: half-open intervals built from probe outcomes, and questions on them.

A hole in samples is not downtime: only intervals say what was reachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"reachable": 1, "degraded": 2, "unreachable": 3}  # fixed values; 0 is unmeasured


def micros(at: Column | str) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def intervals(observations: DataFrame) -> DataFrame:
    """Runs of one state and cause, each open until the next begins; the last has no end."""
    order = Window.partitionBy("game_id").orderBy("observed_at", "event_id")
    now, before = F.struct("state", "cause"), F.lag(F.struct("state", "cause")).over(order)
    starts = observations.withColumn("opens", ~now.eqNullSafe(before)).where("opens")
    ends = F.lead("observed_at").over(order)
    return starts.select("game_id", "state", "cause", F.col("observed_at").alias("from_at"), ends.alias("to_at"))


def clipped(spans: DataFrame, low: str, high: str) -> DataFrame:
    """``length`` in microseconds of each interval's part in the window; empty parts go."""
    start = F.greatest("from_at", F.expr(low))
    end = F.least(F.coalesce("to_at", F.expr(high)), F.expr(high))
    return spans.withColumn("length", micros(end) - micros(start)).where("length > 0")


def cumulative_reachable(spans: DataFrame, now: str) -> DataFrame:
    end = F.least(F.coalesce("to_at", F.expr(now)), F.expr(now))
    length = F.greatest(micros(end) - micros("from_at"), F.lit(0))
    return spans.where("state = 'reachable'").groupBy("game_id").agg(F.sum(length).alias("reachable_us"))


def reachable_fraction(spans: DataFrame, low: str, high: str) -> DataFrame:
    """Of the observed time, not of the window; degraded time is observed but not reachable."""
    part = F.sum(F.when(F.col("state") == "reachable", F.col("length")).otherwise(0))
    return clipped(spans, low, high).groupBy("game_id").agg((part / F.sum("length")).alias("fraction"), F.sum("length").alias("observed_us"))


def longest_outage(spans: DataFrame, low: str, high: str) -> DataFrame:
    """Longest unreachable part in the window, the first of equals, and its cause."""
    down = clipped(spans, low, high).where("state = 'unreachable'")
    best = F.max_by(F.struct("length", "cause", "from_at"), F.struct(F.col("length"), -micros("from_at")))
    return down.groupBy("game_id").agg(best.alias("b")).select("game_id", F.col("b.length").alias("outage_us"), F.col("b.cause").alias("cause"), F.col("b.from_at").alias("since"))


def day_strip(spans: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Worst state of each day, with the cause of the first interval as bad as that.

    Each interval is spread over its own days, so the range join is a generator per row.
    """
    first = F.expr(f"date_sub(CAST({now} AS DATE), {days - 1})")
    last = F.expr(f"CAST({now} AS DATE)")
    end = F.coalesce("to_at", F.expr(now))
    shown = spans.where(end > F.col("from_at"))
    low = F.greatest(F.col("from_at").cast("date"), first)
    high = F.least((end - F.expr("INTERVAL 1 MICROSECOND")).cast("date"), last)
    cells = shown.where(low <= high).withColumn("day", F.explode(F.sequence(low, high, F.expr("INTERVAL 1 DAY"))))
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("state"))
    worst = F.max_by(F.struct("state", "cause"), F.struct(severity, -micros("from_at")))
    return cells.groupBy("game_id", "day").agg(worst.alias("w")).select("game_id", "day", F.col("w.state").alias("state"), F.col("w.cause").alias("cause"))


def spells(strip: DataFrame) -> DataFrame:
    """Consecutive days of one state and cause, reachable ones left out."""
    order = Window.partitionBy("game_id", "state", "cause").orderBy("day")
    bad = strip.where("state <> 'reachable'").withColumn("run", F.date_sub("day", F.row_number().over(order)))
    return bad.groupBy("game_id", "state", "cause", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("run")


def known_live(spans: DataFrame, now: str) -> DataFrame:
    """When a listing was first seen, last reachable, and for how long in all."""
    end, up = F.coalesce("to_at", F.expr(now)), F.col("state") == "reachable"
    return spans.groupBy("game_id").agg(
        F.min("from_at").alias("first_seen"), F.max(F.when(up, end)).alias("last_reachable"),
        F.coalesce(F.sum(F.when(up, F.greatest(micros(end) - micros("from_at"), F.lit(0)))), F.lit(0)).alias("reachable_us"),
        F.max_by(F.when(~up, F.col("cause")), F.when(~up, F.col("from_at"))).alias("last_cause"),
    )


def named(rows: DataFrame, games: DataFrame) -> DataFrame:
    return rows.join(games.select(F.col("id").alias("game_id"), "slug", "name"), "game_id")


def went_dark(spans: DataFrame, games: DataFrame, since: str, limit: int = 11) -> DataFrame:
    """Listings unreachable now that became so of late."""
    dark = spans.where(f"state = 'unreachable' AND to_at IS NULL AND from_at >= {since}")
    return named(dark, games).select("slug", "name", "from_at", "cause").orderBy(F.desc("from_at"), "slug").limit(limit)


def came_back(spans: DataFrame, games: DataFrame, since: str, limit: int = 11) -> DataFrame:
    """Reachable intervals that begin just where a bad one ended: a temporal self-join on equality."""
    up = spans.where(f"state = 'reachable' AND to_at IS NULL AND from_at >= {since}")
    down = spans.where("state <> 'reachable' AND to_at IS NOT NULL").select("game_id", F.col("to_at").alias("from_at"), F.col("from_at").alias("down_since"))
    return named(up.join(down, ["game_id", "from_at"]), games).select("slug", "name", "from_at", "down_since").orderBy(F.desc("from_at"), "slug").limit(limit)


def unbroken(spans: DataFrame, games: DataFrame, limit: int = 20) -> DataFrame:
    open_ = spans.where("to_at IS NULL AND state = 'reachable'")
    return named(open_, games).select("slug", "name", "from_at").orderBy("from_at", "slug").limit(limit)


def archive_candidates(spans: DataFrame, games: DataFrame, now: str, least_days: int = 60, most_days: int = 365) -> DataFrame:
    """Listings dark for a quarter of the time they were reachable, within bounds; claimed ones for the upper bound."""
    day = 86_400_000_000
    up = cumulative_reachable(spans, now)
    dark = spans.where("to_at IS NULL AND state = 'unreachable'").select("game_id", (micros(F.expr(now)) - micros("from_at")).alias("dark_us"))
    kept = F.least(F.greatest(F.floor(F.coalesce("reachable_us", F.lit(0)) / 4), F.lit(least_days * day)), F.lit(most_days * day))
    rows = dark.join(up, "game_id", "left").join(games.select(F.col("id").alias("game_id"), "slug", "is_claimed"), "game_id")
    rows = rows.withColumn("allowed_us", F.when(F.col("is_claimed"), F.lit(most_days * day)).otherwise(kept))
    return rows.select("slug", "dark_us", "allowed_us", (F.col("dark_us") >= F.col("allowed_us")).alias("due"))


def activity_band(games: DataFrame, digest: DataFrame, live: DataFrame, now: str) -> DataFrame:
    """Archived, or players now, or active this week, or dark for 30 days, or quiet; and how lately reached."""
    rows = games.join(digest.withColumnRenamed("game_id", "id"), "id", "left").join(live.withColumnRenamed("game_id", "id"), "id", "left")
    reached = F.col("last_reachable")
    within = lambda d: F.coalesce(reached >= F.expr(f"{now} - INTERVAL {d} DAYS"), F.lit(False))
    band = (
        F.when(F.col("state") == "archived", "archived").when(F.col("players") > 0, "playersNow").when(F.col("nonzero") > 0, "activeThisWeek")
        .when(~within(30), "dark").otherwise("quiet")
    )
    seen = F.when(reached.isNull(), "never").when(within(1), "day").when(within(7), "week").when(within(30), "month").otherwise("older")
    return rows.select("id", "slug", band.alias("band"), seen.alias("last_seen"))


def nested_tokens(seen: Column) -> Column:
    """A day counts as a week and a month too."""
    month = F.array(F.lit("month"))
    week = F.concat(F.array(F.lit("week")), month)
    day = F.concat(F.array(F.lit("day")), week)
    return F.when(seen == "day", day).when(seen == "week", week).when(seen == "month", month).otherwise(F.array(seen))
