"""Upserts as pure functions of old and new rows, to be written over a partition or a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert if absent; of new rows with one key the first by ``order`` enters."""
    rest = [c for c in new.columns if c not in keys]
    firsts = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    return old.unionByName(firsts.join(old.select(*keys).distinct(), keys, "left_anti"))


def greatest_last(rows: DataFrame, keys: list[str], value: str, first: str, last: str, tie: str) -> DataFrame:
    """Earliest first time, latest last time, and the latest value, per key."""
    return rows.groupBy(*keys).agg(F.min(first).alias("first_at"), F.max(last).alias("last_at"), F.max_by(value, F.struct(last, tie)).alias(value))


def replace_range(old: DataFrame, new: DataFrame, low: str, high: str, column: str = "bucket") -> DataFrame:
    """New rows in the place of all old ones from ``low`` up to ``high``: a rerun changes nothing."""
    return old.where(f"{column} < {low} OR {column} >= {high}").unionByName(new.where(f"{column} >= {low} AND {column} < {high}"))


def tombstoned(edges: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with ``present``: whether the current list still has them."""
    return edges.join(current.select(*keys).distinct().withColumn("present", F.lit(True)), keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def expired(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    """What retention keeps."""
    return rows.where(f"{column} >= {cutoff}")


def edges_upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest ``first_at``, latest ``last_at``; ``present`` as the latest row has it, a new row before an old one of its time."""
    rows = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return rows.groupBy(*keys).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max_by("present", F.struct("last_at", "is_new", "present")).alias("present"))


def least_depth(old: DataFrame, new: DataFrame) -> DataFrame:
    """Targets by address: the id that was there first, and the least depth of all rows."""
    rows = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return rows.groupBy("host", "port").agg(F.min_by("id", F.struct("is_new", "id")).alias("id"), F.min("depth").alias("depth"))


def standing_again(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old(*keys, withdrawn_at)`` after requests ``new(*keys)``: what is asked for stands, and ``is_first`` tells keys never seen. Null keys equal each other."""
    there, asked = old.withColumn("there", F.lit(1)).withColumn("asked", F.lit(0)), new.select(*keys).withColumns({"withdrawn_at": F.lit(None).cast("timestamp_ntz"), "there": F.lit(0), "asked": F.lit(1)})
    both = there.unionByName(asked).groupBy(*keys).agg(F.max("withdrawn_at").alias("withdrawn_at"), F.max("there").alias("there"), F.max("asked").alias("asked"))
    return both.select(*keys, F.when(F.col("asked") == 0, F.col("withdrawn_at")).alias("withdrawn_at"), (F.col("there") == 0).alias("is_first"))


def aliases_merged(rows: DataFrame, aliases: dict[str, str], field: str = "field") -> DataFrame:
    """Facts under an alias go under its name: earliest first and latest last time, ``true`` if any says so."""
    name = F.coalesce(*[F.when(F.col(field) == a, F.lit(n)) for a, n in aliases.items()], F.col(field))
    each = rows.withColumn(field, name).groupBy("game_id", field, "source")
    return each.agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("value").alias("value"))


def histograms_backfilled(rolled: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``rolled`` with the histogram rebuilt from samples, where they still are all there: where both tallies agree."""
    again = rebuilt.select("game_id", "bucket", F.col("counted_samples").alias("again"), "count_histogram")
    joined = rolled.join(again, ["game_id", "bucket"], "left")
    return joined.withColumn("count_histogram", F.when(F.col("again") == F.col("counted_samples"), F.col("count_histogram"))).drop("again")
