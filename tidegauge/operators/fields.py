"""Sourced facts: one winner per field, what changed, what is stale, and who disagrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources from the strongest on.
LADDER = ["staff", "handshake", "owner", "who", "i3", "mssp", "info", "i3_mudlist", "banner"]
MEASURED = ("handshake", "who", "i3", "banner")


def winners(fields: DataFrame, *keys: str) -> DataFrame:
    """The fact of the strongest source per key, the newest of equals: an aggregate, not a sort."""
    rest = [c for c in fields.columns if c not in keys]
    # larger is better: a low rank, then late confirmation, then a low tie
    order = F.struct(-F.col("source_rank"), F.col("last_confirmed_at"), -F.col("tie"))
    return fields.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def provenance(winning: DataFrame, now: str, windows_days: dict[str, int], default_days: int | None = None) -> DataFrame:
    """Winning values with whether they were measured, their age, and whether they are stale.

    A field without a window of its own, or a default, is never stale.
    """
    window = F.lit(default_days).cast("int")
    for name, days in windows_days.items():
        window = F.when(F.col("field") == name, F.lit(days)).otherwise(window)
    age = F.greatest(F.lit(0), F.unix_seconds(F.expr(f"CAST({now} AS TIMESTAMP)")) - F.unix_seconds(F.col("last_confirmed_at").cast("timestamp")))
    return winning.select(
        "game_id", "field", "value", "source", F.col("source").isin(*MEASURED).alias("measured"), age.alias("age_seconds"),
        F.coalesce(age > window.cast("long") * 86_400, F.lit(False)).alias("stale"),
    )


def declared_map(fields: DataFrame) -> DataFrame:
    """Per listing, lower-cased field to winning value. Empty values are out before the choice."""
    best = winners(fields.where("value <> ''"), "game_id", "field")
    return best.groupBy("game_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.lower("field"), "value")))).alias("declared"))


def reconcile(fields: DataFrame) -> DataFrame:
    """Each observation against the last of its source: added, confirmed or changed; white space aside."""
    order = Window.partitionBy("game_id", "field", "source").orderBy("last_confirmed_at", "tie")
    folded = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = fields.withColumn("folded", folded).withColumn("old_value", F.lag("value").over(order)).withColumn("old_folded", F.lag("folded").over(order))
    verdict = F.when(F.col("old_folded").isNull(), "added").when(F.col("folded") == F.col("old_folded"), "confirmed").otherwise("changed")
    return rows.select("game_id", "field", "source", "tie", "old_value", F.col("value").alias("new_value"), F.col("last_confirmed_at").alias("changed_at"), verdict.alias("verdict"))


def recent_changes(ledger: DataFrame, games: DataFrame, since: str, limit: int = 20, per_game: int = 3, internal: tuple[str, ...] = ()) -> DataFrame:
    """Latest changes, at most ``per_game`` of a listing."""
    changes = ledger.where(f"verdict = 'changed' AND changed_at >= {since}").where(~F.col("field").isin(*internal) & ~F.col("field").startswith("connect_screen"))
    order = Window.partitionBy("game_id").orderBy(F.desc("changed_at"), F.desc("tie"))
    few = changes.join(games.select(F.col("id").alias("game_id"), "slug"), "game_id").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_game)
    return few.select("slug", "field", "source", "old_value", "new_value", "changed_at", "tie", sentence().alias("sentence")).orderBy(F.desc("changed_at"), F.desc("tie")).limit(limit)


def sentence():
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "nothing").otherwise(F.col(c))
    return F.when(F.col("old_value").isNull(), F.concat(F.lit("recorded as "), shown("new_value"))).otherwise(F.concat(F.lit("changed from "), shown("old_value"), F.lit(" to "), shown("new_value")))


def capability_matrix(fields: DataFrame) -> DataFrame:
    """Per listing and capability, what was measured and what was declared, and whether they disagree.

    Without an observation a side is null: neither present nor absent.
    """
    best = winners(fields.withColumn("side", F.when(F.col("source").isin(*MEASURED), "measured").otherwise("declared")), "game_id", "field", "side")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value") == "true"))
    out = best.groupBy("game_id", "field").agg(side("measured").alias("measured"), side("declared").alias("declared"), F.max("last_confirmed_at").alias("confirmed_at"))
    return out.withColumn("disagrees", F.coalesce(F.col("measured") != F.col("declared"), F.lit(False)))


def lint(fields: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A scorecard per listing against ``vocabulary(field, required, kind)``, kind 'boolean' or 'text'."""
    mine = winners(fields, "game_id", "field").select("game_id", "field", "value")
    every = fields.select("game_id").distinct().crossJoin(F.broadcast(vocabulary))
    rows = every.join(mine, ["game_id", "field"], "full")
    known = F.col("kind").isNotNull()
    finding = (
        F.when(~known, "non_standard").when(F.col("value").isNull() & F.col("required"), "missing").when(F.col("value").isNull(), "not_carried")
        .when(F.trim("value") == "", "unanswered").when((F.col("kind") == "boolean") & ~F.lower("value").isin("true", "false", "0", "1"), "wrong_type").otherwise("answered")
    )
    names = ["missing", "unanswered", "wrong_type", "non_standard", "answered"]
    out = rows.withColumn("finding", finding).groupBy("game_id").agg(*[F.count_if(F.col("finding") == x).alias(x) for x in names])
    return out.withColumn("meets_standard", (F.col("missing") == 0) & (F.col("wrong_type") == 0))


def measured_protocols(fields: DataFrame) -> DataFrame:
    """Per listing, the names of ``capability.*.measured`` facts that are true, in order, each once."""
    name = F.upper(F.regexp_extract("field", r"^capability\.(.+)\.measured$", 1))
    true = fields.where((F.col("value") == "true") & (name != "")).select("game_id", name.alias("protocol"))
    return true.groupBy("game_id").agg(F.array_sort(F.collect_set("protocol")).alias("protocols"))


def latest_change(ledger: DataFrame, field: str) -> DataFrame:
    """Per listing, when a field, in either case, last changed."""
    return ledger.where(F.lower("field") == field.lower()).groupBy("game_id").agg(F.max("changed_at").alias("changed_at"))
