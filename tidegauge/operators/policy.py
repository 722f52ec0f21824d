"""Row-wise rules: schedules, rate limits, presence choice, submission verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def next_interval(failures: Column, busy: Column, delay_hours: Column) -> Column:
    """Seconds to the next probe: 6 h, 2 h if busy; 10 min after one failure, then 6 h doubling up to a week.

    A crawl delay, at most 90 days, only lengthens it, also beyond the week.
    """
    doubled = F.least(F.lit(6 * HOUR) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 2, F.lit(0)), F.lit(20))), F.lit(7.0 * 24 * HOUR))
    base = F.when(failures <= 0, F.when(busy, 2 * HOUR).otherwise(6 * HOUR)).when(failures == 1, 600).otherwise(doubled).cast("long")
    asked = F.when((delay_hours >= 0) & ~F.isnan(delay_hours), F.least(delay_hours, F.lit(90.0 * 24)) * HOUR).cast("long")
    return F.greatest(base, asked)


def due(targets: DataFrame, now: str, limit: int = 200) -> DataFrame:
    return targets.where(f"next_probe_at <= {now}").orderBy("next_probe_at", "id").limit(limit)


def over_rate(rows: DataFrame, key: str, at: str, limit: int, seconds: int = HOUR) -> DataFrame:
    """Rows with how many their key had in the time up to them, and whether that is over the limit."""
    trailing = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return rows.withColumn("trailing", F.count("*").over(trailing)).withColumn("refused", F.col("trailing") > limit)


def presence_choice(who: Column, mssp: Column, info: Column, banner: Column, who_offered: Column, login_prompt: Column) -> Column:
    """The count from the best source that has one, or why there is none."""
    strict = F.when(mssp.rlike(r"^\s*\+?[0-9]{1,9}\s*$"), F.trim(mssp).cast("int"))
    source = F.when(who.isNotNull(), "who").when(strict.isNotNull(), "mssp").when(info.isNotNull(), "info").when(banner.isNotNull(), "banner")
    reason = (
        F.when(source.isNotNull(), F.lit(None)).when(login_prompt, "who_login_prompt").when(mssp.isNotNull(), "players_not_numeric")
        .when(who_offered, "who_unparseable").otherwise("who_not_offered")
    )
    return F.struct(F.coalesce(who, strict, info, banner).alias("cnt"), source.alias("source"), reason.alias("reason"))


def failure_state(cause: Column, offered_options: Column) -> Column:
    """A timeout after options were offered is a stalled handshake, and degraded; all else is unreachable."""
    stalled = (cause == "timeout") & (F.size(offered_options) > 0)
    return F.struct(F.when(stalled, "degraded").otherwise("unreachable").alias("state"), F.when(stalled, "handshake_stalled").otherwise(cause).alias("cause"))


def submission_verdict(over_limit: Column, parsed: Column, listed: Column, queued: Column, in_scope: Column, opted_out: Column) -> Column:
    return (
        F.when(over_limit, "rate_limited").when(~parsed, "malformed").when(listed, "already_listed").when(queued, "already_queued")
        .when(~in_scope, "out_of_scope").when(opted_out, "opted_out").otherwise("accepted")
    )


def close_after_gap(spans: DataFrame, finished: str, now: str, hours: int = 2) -> DataFrame:
    """If the crawler was silent for too long, open intervals end where it last finished."""
    silent = F.expr(f"{now} - {finished} > INTERVAL {hours} HOURS")
    stops = silent & F.col("to_at").isNull() & (F.col("from_at") <= F.expr(finished))
    return spans.withColumn("to_at", F.when(stops, F.expr(finished)).otherwise(F.col("to_at")))
