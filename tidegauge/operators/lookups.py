"""Look-ups and joins that other queries are made of: keys, latest rows, optional rows, overlaps, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key list up to this many rows goes to every task; a longer one is shuffled like any table.
MOST_KEYS = 100_000


def inline(spark: SparkSession, ids: list[int], name: str = "id") -> DataFrame:
    """A relation of the given ids."""
    return spark.createDataFrame([(i,) for i in ids], f"{name} long")


def of_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in a list; a key that is listed twice counts once. The list is broadcast only if it was counted to be short."""
    few = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    short = few.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return rows.join(F.broadcast(few) if short else few, column, "left_semi")


def folded(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def with_value(fields: DataFrame, field: str, value: str, longest: int = 256) -> DataFrame:
    """``(game_id)`` of the listings that have a value, whatever its case and white space; longer values are not looked at."""
    same = (F.lower("field") == field.lower()) & (folded(F.col("value")) == folded(F.lit(value))) & (F.length("value") <= longest)
    return fields.where(same).select("game_id").distinct()


def latest_of(rows: DataFrame, key: str, at: str, tie: str, where: Column) -> DataFrame:
    """The latest row of each key among those that count, as one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(where).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("l")).select(key, "l.*")


def beside_latest(rows: DataFrame, cycles: DataFrame, at: str) -> DataFrame:
    """``rows`` beside the latest of all ``cycles``; if there is none, the rows stay and its columns are null."""
    names = cycles.columns
    last = cycles.agg(F.max_by(F.struct(*names), at).alias("last"))  # one row, also of nothing
    return rows.crossJoin(F.broadcast(last)).select(*rows.columns, *[F.col(f"last.{c}").alias(c) for c in names])


def icons_due(games: DataFrame, icons: DataFrame, now: str, days: int = 7) -> DataFrame:
    """``(id, url, changed)`` of the listings whose icon is missing, has another address, or is older than ``days``; changed addresses come first."""
    rows = games.join(icons.select("id", F.col("url").alias("had"), "fetched_at"), "id", "left")
    changed = F.col("had").isNotNull() & (F.col("url") != F.col("had"))
    due = F.col("had").isNull() | changed | (F.col("fetched_at") < F.expr(f"{now} - INTERVAL {days} DAYS"))
    return rows.where(F.col("url").isNotNull() & due).select("id", "url", changed.alias("changed")).orderBy(F.desc("changed"), "id")


def overlapping(spans: DataFrame, windows: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Pairs of a span and a window of the same key that share a moment, ends included; an open span has no end.

    ``spans(key, from_at, to_at, …)``, ``windows(key, low, high, …)``. Both are put into buckets of time and joined on key and bucket; of the
    buckets that a pair shares only the first gives it out. An open span's buckets end with the last window of all.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (3600 * hours)).cast("long")
    last = windows.agg(F.max("high").alias("last"))
    bounded = spans.crossJoin(F.broadcast(last)).withColumn("_end", F.least(F.coalesce("to_at", "last"), F.col("last"))).drop("last").where("from_at <= _end")
    s = bounded.withColumn("_first", bucket(F.col("from_at"))).withColumn("_bucket", F.explode(F.sequence("_first", bucket(F.col("_end"))))).drop("_end")
    w = windows.where("low <= high").withColumn("_low", bucket(F.col("low"))).withColumn("_bucket", F.explode(F.sequence("_low", bucket(F.col("high")))))
    meet = (F.col("from_at") <= F.col("high")) & (F.col("to_at").isNull() | (F.col("to_at") >= F.col("low")))
    pairs = s.join(w, [key, "_bucket"]).where(meet & (F.col("_bucket") == F.greatest("_first", "_low")))
    return pairs.drop("_bucket", "_first", "_low")


def random_pick(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """One row, each as likely, the same for a seed however the rows lie: the least seeded hash, found by a partial aggregation."""
    hashed = F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), F.col(key).alias("k"))
    return rows.agg(F.min_by(F.struct(*rows.columns), hashed).alias("r")).where("r IS NOT NULL").select("r.*")


def capability_tally(winning: DataFrame) -> DataFrame:
    """How many listings have each winning value of each field."""
    return winning.groupBy("field", "value").agg(F.count("*").alias("games"))


def headline_first(names: DataFrame, headline: list[str]) -> DataFrame:
    """``(position, name)``: headline names in their order, whether there or not, then all others once each by name."""
    spark = names.sparkSession
    first = spark.createDataFrame(list(enumerate(headline)), "rank long, name string")
    rest = names.select(F.lit(len(headline)).cast("long").alias("rank"), "name")
    each = first.unionByName(rest).groupBy("name").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.orderBy("rank", "name"))  # one row per name of a vocabulary
    return each.select(place.alias("position"), "name")


def browsable(games: DataFrame, include_archived: bool = False, band: str | None = None) -> DataFrame:
    """Listings that may be browsed: never excluded or unlisted ones; archived ones only if asked for, by a flag or as the band."""
    shown = games.where("state NOT IN ('excluded', 'unlisted')")
    return shown if include_archived or band == "archived" else shown.where("state <> 'archived'")


def neighbours_in_order(rows: DataFrame) -> DataFrame:
    """Neighbours of a listing: those still present first, then by name whatever its case."""
    order = Window.partitionBy("node").orderBy(F.desc("present"), F.lower("name"), "other")
    return rows.withColumn("place", F.row_number().over(order))


def negotiated_charset(fields: DataFrame) -> DataFrame:
    """``(game_id, charset, shown)``: what the handshake settled on; the screen does not show UTF-8, which is what is expected."""
    value = F.max_by("value", F.struct("last_confirmed_at", "tie"))
    best = fields.where("upper(field) = 'CHARSET' AND source = 'handshake'").groupBy("game_id").agg(value.alias("charset"))
    plain = F.regexp_replace(F.lower("charset"), "[^a-z0-9]", "")
    return best.withColumn("shown", F.when(plain != "utf8", F.col("charset")))


def may_be_listed(stranger: Column, named: Column, hostname: Column, codebase: Column, who_confidence: Column) -> Column:
    """A stranger's proposal is listed only once the service has said itself what it is: a name, a host, an engine, or a list of players that was counted."""
    said = F.coalesce(named != "", F.lit(False)) | F.coalesce(hostname != "", F.lit(False)) | F.coalesce(codebase != "", F.lit(False)) | F.coalesce(who_confidence == "count", F.lit(False))
    return ~stranger | said


#: What the errors of a dial are called.
DIAL_FAILURES = {
    "HostNotFound": "dns", "TryAgain": "dns", "NoData": "dns", "NoRecovery": "dns", "ConnectionRefused": "refused", "TimedOut": "timeout", "Cancelled": "timeout",
    "NetworkUnreachable": "no_route", "HostUnreachable": "no_route", "NetworkDown": "no_route",
}


def dial_failure(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DIAL_FAILURES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit("error"))


def gateway_presence(replied: Column, users: Column) -> Column:
    """A reply's users are counted, also none; no reply is uncountable, with a reason."""
    return F.struct(F.when(replied, F.size(F.coalesce(users, F.array().cast("array<string>")))).alias("cnt"), F.when(~replied, "i3_no_reply").alias("reason"))


def reviews_opened(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(low_id, high_id, score, opened_at)``: a pair has one review, whichever side it was found from; the first stays."""
    pair = lambda df, is_new: df.select(F.least("a", "b").alias("low_id"), F.greatest("a", "b").alias("high_id"), "score", "opened_at", F.lit(is_new).alias("is_new")).where("low_id <> high_id")
    first = F.min_by(F.struct("score", "opened_at"), F.struct("is_new", "opened_at", "score"))
    return pair(old, 0).unionByName(pair(new, 1)).groupBy("low_id", "high_id").agg(first.alias("r")).select("low_id", "high_id", "r.*")
