"""A listing as one nested document: many child tables brought to their parent in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import availability as A
from tidegauge.operators import fields as D


def assembled(parents: DataFrame, children: dict[str, DataFrame], key: str = "game_id") -> DataFrame:
    """``parents`` with an array of structs per child table, ordered by the child's columns from the left.

    All rows go through one union and one grouping by ``key``, so that a further child costs no further
    join; a parent without rows in a child has an empty array there, and children without a parent go.
    """
    columns = [c for c in parents.columns if c != key]
    parts = [parents.select(key, F.struct(*columns).alias("_parent"))]
    parts += [child.select(key, F.struct(*[c for c in child.columns if c != key]).alias(name)) for name, child in children.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    grouped = every.groupBy(key).agg(F.max("_parent").alias("_parent"), *[F.sort_array(F.collect_list(name)).alias(name) for name in children])
    return grouped.where("_parent IS NOT NULL").select(key, "_parent.*", *children)


def shown_time(at: Column | str) -> Column:
    return F.date_format(F.col(at) if isinstance(at, str) else at, "yyyy-MM-dd HH:mm:ss")


def game_children(fields: DataFrame, spans: DataFrame, samples: DataFrame, neighbours: DataFrame, since: str, now: str, changes: int = 3) -> dict[str, DataFrame]:
    """The child tables of a listing's document. Facts and spans are dealt by listing once and grouped where they are; samples are tallied before they move."""
    facts = fields.repartition("game_id")
    declared = D.winners(facts.where("value <> ''"), "game_id", "field").select("game_id", F.lower("field").alias("field"), "value", "source")
    capabilities = D.capability_matrix(facts).select("game_id", "field", "measured", "declared", "disagrees")
    latest = Window.partitionBy("game_id").orderBy(F.desc("changed_at"), F.desc("tie"))
    changed = D.reconcile(facts).where("verdict = 'changed'").withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= changes)
    changed = changed.select("game_id", "nth", shown_time("changed_at").alias("at"), "field", D.sentence().alias("sentence"))
    stretches = spans.select("game_id", shown_time("from_at").alias("from"), shown_time("to_at").alias("to"), "state", "cause")
    reach = A.clipped(spans, since, now).groupBy("game_id").agg(
        F.sum(F.when(F.col("state") == "reachable", F.col("length")).otherwise(0)).alias("reachable_us"), F.sum("length").alias("observed_us"),
        F.max(F.when(F.col("state") == "unreachable", F.col("length"))).alias("outage_us"),
    )
    cells = samples.where(f"sampled_at >= {since}").groupBy("game_id", (F.dayofweek("sampled_at") - 1).alias("dow"), F.hour("sampled_at").alias("hod"))
    activity = cells.agg(F.count("*").alias("samples"), F.count("cnt").alias("counted"), F.sum("cnt").alias("total"))
    listed = neighbours.select(F.col("node").alias("game_id"), "direction", "slug")
    return {"declared": declared, "capabilities": capabilities, "reachability": reach, "availability": stretches, "activity": activity, "changes": changed, "referrals": listed}


def game_documents(games: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """``(game_id, document)``: each listing with all its children as JSON, nulls kept."""
    parents = games.select(F.col("id").alias("game_id"), "slug", "name", "state", (F.col("state") == "archived").alias("archived"), F.col("is_claimed").alias("claimed"))
    rows = assembled(parents, children)
    reach, cells = F.try_element_at("reachability", F.lit(1)), F.struct(F.lit("dayOfWeekHour").alias("shape"), F.lit("UTC").alias("zone"), F.col("activity").alias("cells"))
    disagreements = F.size(F.filter("capabilities", lambda c: c["disagrees"]))
    document = F.struct(
        F.col("game_id").alias("id"), "slug", "name", "state", "archived", "claimed", reach.alias("reachability"), disagreements.alias("disagreements"), "declared", "capabilities",
        cells.alias("presence"), "availability", F.transform("changes", lambda c: F.struct(c["at"].alias("at"), c["field"].alias("field"), c["sentence"].alias("sentence"))).alias("changes"), "referrals",
    )
    return rows.select("game_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def dump(documents: DataFrame, path: str) -> None:
    """The documents as lines of JSON, written by the tasks that hold them."""
    documents.select("document").write.mode("overwrite").text(path)
