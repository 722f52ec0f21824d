"""A cycle of the inter-service gateway: what its list says, which listing each entry is, and what its replies count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import vocabulary
from tidegauge.operators.lookups import gateway_presence


def cycle(entries: DataFrame, targets: DataFrame, bound: DataFrame) -> DataFrame:
    """``(name, host, port, verdict, game_id, bound_to)`` for each of ``entries(name, host, port, place)``.

    ``targets(host, port, game_id)``, ``bound(name, game_id)`` from before. An entry without host or port cannot be listed; one whose address is
    not known is seeded. Else it may be bound to the listing there: an entry to one listing at most and a listing to one entry at
    most. What is bound stays bound; of several new entries for one listing the first on the list gets it.
    """
    at = targets.groupBy("host", "port").agg(F.min("game_id").alias("game_id"), F.lit(True).alias("known"))
    sound = (F.coalesce(F.trim("host"), F.lit("")) != "") & (F.coalesce("port", F.lit(0)) > 0)
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    rows = entries.withColumn("sound", sound).join(at, ["host", "port"], "left").join(bound.select("name", F.col("game_id").alias("old")), "name", "left")
    taken = bound.select("game_id", F.lit(True).alias("taken"))
    rows = rows.join(taken, "game_id", "left")
    free = rows.where(F.col("sound") & named & F.col("game_id").isNotNull() & F.col("old").isNull() & F.col("taken").isNull())
    first = free.groupBy("game_id").agg(F.min_by("name", F.struct("place", "name")).alias("name")).select("name", F.col("game_id").alias("new"))
    out = rows.join(first, "name", "left")
    verdict = (
        F.when(~F.col("sound"), "unlistable").when(F.col("known").isNull(), "seeded").when(F.col("game_id").isNull(), "unlisted")
        .when(F.col("old").isNotNull(), "kept").when(F.col("new").isNotNull() & (F.col("new") == F.col("game_id")), "bound").otherwise("refused")
    )
    return out.select("name", "host", "port", verdict.alias("verdict"), "game_id", F.coalesce("old", F.when(verdict == "bound", F.col("new"))).alias("bound_to"))


def observations(entries: DataFrame) -> DataFrame:
    """``(name, field, value)`` of ``entries(name, driver, mudlib, mud_type)``: the driver as code base, a mudlib that differs, and the family; texts of templates are none."""
    told = lambda c: F.when(~vocabulary.is_template(F.col(c)), F.trim(c))
    driver, lib = told("driver"), told("mudlib")
    differs = F.when(driver.isNull() | (F.lower(driver) != F.lower(lib)), lib)
    facts = [("CODEBASE", driver), ("MUDLIB", differs), ("FAMILY", told("mud_type"))]
    every = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, v in facts]))
    return entries.select("name", F.explode(every).alias("f")).select("name", "f.field", "f.value")


def readings(bound: DataFrame, replies: DataFrame) -> DataFrame:
    """``(game_id, cnt, reason)`` of the entries that were asked: ``replies(name, replied, users)``; one without a row did not reply."""
    asked = bound.join(replies, "name", "left")
    return asked.select("game_id", gateway_presence(F.coalesce("replied", F.lit(False)), F.col("users")).alias("p")).select("game_id", "p.cnt", "p.reason")


def summary(read: DataFrame) -> DataFrame:
    """How many readings were counted, or for which reason not, and the people counted."""
    return read.groupBy(F.coalesce("reason", F.lit("counted")).alias("outcome")).agg(F.count("*").alias("readings"), F.sum("cnt").cast("long").alias("people"))
