"""The whole catalogue: adoption tables, usage shares, totals, and daily snapshots.

Facts have denominators of their own; what was never measured is null, not zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.fields import MEASURED, winners
from tidegauge.operators.search import commonest


def protocol_adoption(fields: DataFrame) -> DataFrame:
    """Per protocol: offered and declined by handshake, declared by report; null where none was observed."""
    sided = fields.withColumn("side", F.when(F.col("source").isin(*MEASURED), "measured").otherwise("declared"))
    best = winners(sided, "game_id", "field", "side")
    measured, true = F.col("side") == "measured", F.col("value") == "true"
    seen = F.count_if(measured) > 0
    return best.groupBy("field").agg(
        F.when(seen, F.count_if(measured & true)).alias("offered"), F.when(seen, F.count_if(measured & ~true)).alias("declined"),
        F.count_if(~measured & true).alias("declared"),
    )


def totals(games: DataFrame, fields: DataFrame) -> DataFrame:
    """Listings, listings handshaked, listings with a report: one row, three denominators."""
    one = games.agg(F.count("*").alias("listed"))
    kind = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("game_id")))
    mine = fields.join(games.select(F.col("id").alias("game_id")), "game_id", "left_semi")
    two = mine.agg(kind("handshake").alias("handshakes"), kind("mssp").alias("mssp_reports"), F.min(F.when(F.col("source") == "handshake", F.col("last_confirmed_at"))).alias("oldest_handshake"))
    return one.crossJoin(two)


def usage(rows: DataFrame, value: str) -> DataFrame:
    """Families by share of the identified, under their commonest spelling, and whether only one row has it."""
    groups = commonest(rows, value)
    whole = groups.agg(F.sum("n").alias("identified"))
    return groups.crossJoin(F.broadcast(whole)).select("spelling", "n", (F.col("n") / F.col("identified")).alias("share"), (F.col("n") == 1).alias("sole"))


def snapshot(adoption: DataFrame, on_date: str) -> DataFrame:
    """A day's rows of the adoption series."""
    return adoption.select(F.lit(on_date).cast("date").alias("on_date"), F.lit("protocol").alias("metric"), F.col("field").alias("key"), "offered", "declined", "declared")


def pulse(targets: DataFrame, now: str) -> DataFrame:
    """The work queue in one row."""
    return targets.agg(
        F.min("next_probe_at").alias("next_due"), F.max("next_probe_at").alias("last_due"), F.count_if(F.expr(f"next_probe_at <= {now}")).alias("due_now"), F.count("*").alias("known"),
    )


def catalogue_totals(**relations: DataFrame) -> DataFrame:
    """``(relation, n)`` for each."""
    out = None
    for name, df in relations.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def summary_page(games: DataFrame, fields: DataFrame, samples: DataFrame, offset: int, limit: int) -> DataFrame:
    """Per listing of a page: facts, samples, and the latest count; correlated subqueries as joins."""
    page = games.orderBy("slug").offset(offset).limit(limit).select(F.col("id").alias("game_id"), "slug", "state")
    facts = fields.groupBy("game_id").agg(F.count("*").alias("n_fields"))
    seen = samples.groupBy("game_id").agg(F.count("*").alias("n_samples"), F.max_by("cnt", F.when(F.col("cnt").isNotNull(), F.col("sampled_at"))).alias("latest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(page).join(facts, "game_id", "left").join(seen, "game_id", "left").select("slug", "state", zero("n_fields"), zero("n_samples"), "latest")
