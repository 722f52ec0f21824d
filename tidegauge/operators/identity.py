"""Which entries are one: candidate blocking, weighted scores, verdicts, merges, redirects, referrals."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import stored

MERGE, REVIEW = 1.0, 0.4
#: Parts into which the listings that share a key are cut.
TILES = 16


def blocked_scores(probes: DataFrame, catalogue: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """``(probe_id, game_id, score)`` of pairs that agree on any key; nulls do not match.

    One equi-join a key, which leaves out pairs that an earlier key has found, so a pair is made once, with its
    score, and never moves again. There are as many pairs as a key's groups have, so groups are cut into tiles by listing.
    """
    mine, theirs = _sides(probes, catalogue, weights)
    tile, n = F.pmod(F.xxhash64("game_id"), F.lit(TILES)).cast("int"), int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for nth, k in enumerate(keys):
        left = mine.where(F.col(f"p_{k}").isNotNull()).withColumn("p_tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))))
        # a number of partitions is given, as what grows is the pairs and not the bytes by which partitions are merged
        right = theirs.where(F.col(f"g_{k}").isNotNull()).withColumn("g_tile", tile).repartition(n, f"g_{k}", "g_tile")
        agree = (F.col(f"p_{k}") == F.col(f"g_{k}")) & (F.col("p_tile") == F.col("g_tile"))
        for before in keys[:nth]:
            agree = agree & ~_same(before)
        pairs = left.join(right, agree).select("probe_id", "game_id", _score(weights).alias("score"))
        out = pairs if out is None else out.unionAll(pairs)
    return out


def _sides(probes: DataFrame, catalogue: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    return probes.select("probe_id", *[F.col(k).alias(f"p_{k}") for k in weights]), catalogue.select("game_id", *[F.col(k).alias(f"g_{k}") for k in weights])


def _same(k: str) -> Column:
    return F.coalesce(F.col(f"p_{k}") == F.col(f"g_{k}"), F.lit(False))


def _score(weights: dict[str, float]) -> Column:
    """Sum of the weights of matching signals."""
    return F.round(sum((F.when(_same(k), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)), 6)


def verdicts(probes: DataFrame, catalogue: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """The best of the candidates that agree with a probe on any key, the lower id among equals, and what follows from its score.

    Pairs are not made. Of the listings that agree on at least a set of signals one with the lowest id is looked up for each
    set that holds a key. Weights are not negative, so the best candidate is among them: it is what its own set finds.
    """
    if min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    mine, theirs = _sides(probes, catalogue, weights)
    found = None
    for signals in (s for n in range(1, len(weights) + 1) for s in combinations(weights, n) if set(s) & set(keys)):
        least = theirs.dropna(subset=[f"g_{k}" for k in signals]).groupBy(*[F.col(f"g_{k}").alias(f"s_{k}") for k in signals]).agg(F.min(F.struct(*theirs.columns)).alias("g"))
        some = mine.join(least, reduce(and_, [F.col(f"p_{k}") == F.col(f"s_{k}") for k in signals])).select(*mine.columns, "g.*").select("probe_id", "game_id", _score(weights).alias("score"))
        found = some if found is None else found.unionAll(some)
    best = F.max_by(F.struct("game_id", "score"), F.struct(F.col("score"), -F.col("game_id")))
    out = found.groupBy("probe_id").agg(best.alias("b")).select("probe_id", F.col("b.game_id").alias("game_id"), F.col("b.score").alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= MERGE, "merge").when(F.col("score") >= REVIEW, "review").otherwise("fresh"))


def redirects(merges: DataFrame, games: DataFrame) -> DataFrame:
    """Absorbed slug to surviving slug; a survivor that was itself absorbed leads nowhere."""
    old = games.select(F.col("id").alias("from_game_id"), F.col("slug").alias("from_slug"))
    new = games.select(F.col("id").alias("into_game_id"), F.col("slug").alias("to_slug"))
    ends = merges.join(merges.select(F.col("from_game_id").alias("into_game_id")), "into_game_id", "left_anti")
    return ends.join(old, "from_game_id").join(new, "into_game_id").select("from_slug", "to_slug")


def merge_verdicts(requests: DataFrame, games: DataFrame, merges: DataFrame) -> DataFrame:
    """Self, unknown, already absorbed, would chain, or merged; in that order. Requests name (from_id, into_id)."""
    known = games.select(F.col("id").alias("k"))
    flagged = (
        requests.join(known.withColumn("from_known", F.lit(True)), F.col("from_id") == F.col("k"), "left").drop("k")
        .join(known.withColumn("into_known", F.lit(True)), F.col("into_id") == F.col("k"), "left").drop("k")
        .join(merges.select(F.col("from_game_id").alias("k"), F.lit(True).alias("from_absorbed")).distinct(), F.col("from_id") == F.col("k"), "left").drop("k")
        .join(merges.select(F.col("from_game_id").alias("k"), F.lit(True).alias("into_absorbed")).distinct(), F.col("into_id") == F.col("k"), "left").drop("k")
        .join(merges.select(F.col("into_game_id").alias("k"), F.lit(True).alias("from_survivor")).distinct(), F.col("from_id") == F.col("k"), "left").drop("k")
    )
    verdict = (
        F.when(F.col("from_id") == F.col("into_id"), "self").when(F.col("from_known").isNull() | F.col("into_known").isNull(), "unknown")
        .when(F.col("from_absorbed"), "already_absorbed").when(F.col("into_absorbed") | F.col("from_survivor"), "chain").otherwise("merged")
    )
    return flagged.select("from_id", "into_id", verdict.alias("verdict"))


def reachable_from(edges: DataFrame, start: int) -> DataFrame:
    """Nodes that referrals reach, with the fewest steps: a frontier joined until it is empty; cycles end.

    Each frontier is computed once and stored, so a round costs the same however many went before.
    """
    spark = edges.sparkSession
    known = spark.createDataFrame([(start, 0)], "node long, depth int")
    frontier, depth = known, 0
    links = stored(edges.select(F.col("from_id").cast("long").alias("node"), F.col("to_id").cast("long").alias("next")).distinct())
    while True:
        depth += 1
        found = frontier.join(links, "node").select(F.col("next").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        frontier = stored(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Both directions of each referral, once each: ``(node, direction, other, slug)``."""
    out = edges.select(F.col("from_id").alias("node"), F.lit("lists").alias("direction"), F.col("to_id").alias("other"))
    back = edges.select(F.col("to_id").alias("node"), F.lit("listed_by").alias("direction"), F.col("from_id").alias("other"))
    return out.unionByName(back).distinct().join(names.select(F.col("id").alias("other"), "slug"), "other").select("node", "direction", "other", "slug")


def referral_verdicts(edges: DataFrame, known: DataFrame, fan_out: int = 50, deepest: int = 4) -> DataFrame:
    """Per proposed edge ``(from_id, to_id, depth, routable, tie)``: the first rule that refuses it, or known or added."""
    nth = F.row_number().over(Window.partitionBy("from_id").orderBy("tie"))
    rows = edges.withColumn("nth", nth).join(known.select(F.col("id").alias("to_id"), F.lit(True).alias("is_known")), "to_id", "left")
    verdict = (
        F.when(F.col("from_id") == F.col("to_id"), "self").when(~F.col("routable"), "not_routable").when(F.col("nth") > fan_out, "fan_out")
        .when(F.col("depth") > deepest, "too_deep").when(F.col("is_known"), "known").otherwise("added")
    )
    return rows.select("from_id", "to_id", "tie", verdict.alias("verdict"))


def unique_slugs(rows: DataFrame, slug: Column, taken: DataFrame) -> DataFrame:
    """``(id, slug)``: slugs made unique in id order; the first row of a stem keeps it, unless taken, and later ones get -2, -3, …

    A number is passed over if the slug with it is taken, or is some row's own.
    """
    own = rows.select("id", slug.alias("stem"))
    used = taken.select("slug").union(own.select("stem")).distinct()
    # numbers of a stem that are spoken for: what is taken, or another row's own, and reads stem-<number>
    numbered = used.select(F.regexp_extract("slug", r"^(.*)-[1-9][0-9]*$", 1).alias("stem"), F.regexp_extract("slug", r"^.*-([1-9][0-9]*)$", 1).try_cast("long").alias("number")).where("number >= 2")
    gone = numbered.groupBy("stem").agg(F.sort_array(F.collect_set("number")).alias("gone"))
    first = own.join(taken.select(F.col("slug").alias("stem"), F.lit(1).alias("used")).distinct(), "stem", "left").join(gone, "stem", "left")
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("id")) + F.coalesce("used", F.lit(0))
    # each spoken-for number at or below the running one moves it up by one
    moved = F.aggregate(F.coalesce("gone", F.array().cast("array<bigint>")), F.col("nth").cast("long"), lambda n, g: F.when(g <= n, n + 1).otherwise(n))
    out = first.withColumn("nth", nth).withColumn("number", moved)
    return out.select("id", F.when(F.col("nth") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("number").cast("string"))).alias("slug"))
