"""A listing's state through a history of decisions and observations, each of which only some states allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of event needs of the state, and the state it leads to; ``set`` leads to its own ``detail``.
RULES = {
    "exclude": (None, "excluded"), "include": (["excluded"], "active"), "unlist": (["active", "quiet", "dark", "archived", "unlisted"], "unlisted"), "relist": (["unlisted"], "active"),
    "set": (["active", "quiet", "dark", "archived"], None), "answered": (["archived", "unlisted"], "active"),
}


def after(games: DataFrame, events: DataFrame) -> DataFrame:
    """``(id, state, archived_at, excluded_at, excluded_reason, unlisted_at, unlisted_by, moves)`` after ``events(game_id, at, tie, kind, detail)``.

    A fold in order of ``(at, tie)`` from ``games(id, state)``. Dates and reasons go with their state and are cleared when it ends;
    an event that the state does not allow changes nothing. One listing's events are decisions of people and sweeps, and come together.
    """
    no_time, no_text = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")

    def made(state: Column, at: Column, detail: Column, moves: Column) -> Column:
        when = lambda s, x: F.when(state == s, x)
        return F.struct(
            state.alias("state"), when("archived", at).alias("archived_at"), when("excluded", at).alias("excluded_at"), when("excluded", detail).alias("excluded_reason"),
            when("unlisted", at).alias("unlisted_at"), when("unlisted", detail).alias("unlisted_by"), moves.alias("moves"),
        )

    def step(now: Column, e: Column) -> Column:
        allowed = F.lit(False)
        target = e["detail"]
        for kind, (needs, leads) in RULES.items():
            allowed = allowed | ((e["kind"] == kind) & (now["state"].isin(*needs) if needs else F.lit(True)))
            if leads:
                target = F.when(e["kind"] == kind, leads).otherwise(target)
        return F.when(allowed & target.isNotNull(), made(target, e["at"], e["detail"], now["moves"] + F.when(target != now["state"], 1).otherwise(0))).otherwise(now)

    order = F.array_sort(F.collect_list(F.struct("at", "tie", "kind", "detail")))
    folded = games.select("id", "state").join(events.groupBy(F.col("game_id").alias("id")).agg(order.alias("events")), "id", "left")
    nothing = F.array().cast("array<struct<at:timestamp_ntz,tie:bigint,kind:string,detail:string>>")
    end = F.aggregate(F.coalesce("events", nothing), made(F.col("state"), no_time, no_text, F.lit(0)), step)
    return folded.select("id", end.alias("e")).select("id", "e.*")


def targets_after(targets: DataFrame, probes: DataFrame) -> DataFrame:
    """``targets(id, reachable_at, next_probe_at, failures, delay_hours, asked_at)`` after ``probes(id, at, tie, answered, next_at, delay_hours, asked_at)``.

    The reachable time never goes back; the next probe is the soonest that the latest probe or a request asks for; failures count from the last answer;
    a delay that was not heard this time stays; the first request stays. All of it is one aggregation.
    """
    answered = F.col("answered")
    last_answer = F.max(F.when(answered, F.struct("at", "tie")))
    seen = probes.groupBy("id").agg(
        F.max(F.when(answered, F.col("at"))).alias("p_reach"), F.max_by("next_at", F.struct("at", "tie")).alias("p_next"), F.min("asked_at").alias("p_asked"),
        F.max_by(F.when(F.col("delay_hours").isNotNull(), F.col("delay_hours")), F.when(F.col("delay_hours").isNotNull(), F.struct("at", "tie"))).alias("p_delay"),
        last_answer.alias("p_last"), F.array_sort(F.collect_list(F.when(~answered, F.struct("at", "tie")))).alias("p_failed"),
    )
    rows = targets.join(seen, "id", "left")
    since = F.size(F.filter(F.coalesce("p_failed", F.array().cast("array<struct<at:timestamp_ntz,tie:bigint>>")), lambda f: F.col("p_last").isNull() | (f > F.col("p_last"))))
    return rows.select(
        "id", F.greatest("reachable_at", "p_reach").alias("reachable_at"), F.least(F.coalesce("p_next", "next_probe_at"), F.coalesce("p_asked", "p_next", "next_probe_at")).alias("next_probe_at"),
        F.when(F.col("p_last").isNotNull(), since).otherwise(F.col("failures") + since).alias("failures"), F.coalesce("p_delay", "delay_hours").alias("delay_hours"), F.coalesce("asked_at", "p_asked").alias("asked_at"),
    )
