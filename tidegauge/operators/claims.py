"""Claims on listings: an ordered history of requests and beacons, folded into the state of each claim.

``events(game_id, id, at, kind, user_id, token, intent, channel)``, ordered by ``(at, id)``. Kinds: ``issue``
mints a token for a user, ``beacon`` is a token seen published, ``check`` asks for a look, ``resign`` and
``revoke`` end a claim. A token belongs to the game that it was issued for.

What a claim becomes depends on others in two ways only, and each is one shuffle. Whether a request
mints a new claim depends on the user's last one on that game still being pending: a walk along the
sorted requests of one user and game. And a claim that takes over ends all others that are verified by then:
a running minimum along the verified claims of a game. Beacons and revocations meet their claim by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How long a claim may wait for its beacon, and how long after one look the next may be asked for.
PENDING = "INTERVAL 30 DAYS"
RECHECK = "INTERVAL 3 MINUTES"
#: Verdicts on a beacon, from the strongest on.
VERDICTS = ["assumed", "verified", "still_seen", "stale", "nothing_to_do"]


def greedy(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``rows`` with ``nth``: of each key's rows in order of ``start``, those that begin no sooner than the last kept one ends.

    ``start`` and ``end`` are ``(at, id)``, never null; ``nth`` counts from 0. One walk over sorted rows, which holds the end of
    the last kept row and nothing else, however many rows a key has.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("nth", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until, nth = None, None, -1
        for batch in batches:
            moment = lambda c, b=batch: zip(b.column(c).field("at").cast(pa.int64()).to_pylist(), b.column(c).field("id").to_pylist())
            marks = []
            for this, begins, ends in zip(zip(*[batch.column(k).to_pylist() for k in keys]), moment(start), moment(end)):
                if this != key:
                    key, until, nth = this, None, -1
                free = until is None or begins >= until
                if free:
                    until, nth = ends, nth + 1
                marks.append(nth if free else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, start, end).mapInArrow(walk, schema).where("nth IS NOT NULL")


def _when(at: Column, id_: Column) -> Column:
    return F.struct(at.alias("at"), id_.alias("id"))


def claim_states(events: DataFrame, lifetime: str = PENDING) -> DataFrame:
    """One row per minted claim.

    ``(game_id, token, user_id, intent, issued, expires_at, reissued, claimed, via, last_seen_at, ended, revoked_at, reason, displaced)``;
    ``issued``, ``claimed`` and ``ended`` (the first revocation) are ``(at, id)`` of the event. ``revoked_at`` and ``reason`` are those of the latest revocation.
    """
    order = F.struct("at", "id")
    token = Window.partitionBy("game_id", "token")
    rows = events.where("token IS NOT NULL").withColumn("order", order)
    issue = F.min(F.when(F.col("kind") == "issue", F.struct("at", "id", "user_id", "intent"))).over(token)
    rows = rows.withColumn("issue", issue).where("issue IS NOT NULL").withColumn("issued", F.struct("issue.at", "issue.id")).where("order >= issued")
    rows = rows.withColumn("expires_at", F.col("issue.at") + F.expr(lifetime))
    revoke = F.col("kind") == "revoke"
    rows = rows.withColumn("first_revoke", F.min(F.when(revoke, F.col("order"))).over(token))
    barred = (F.col("channel") == "dns_txt") & (F.col("issue.intent") == "assume")
    proves = (F.col("kind") == "beacon") & (F.col("at") < F.col("expires_at")) & ~barred & (F.col("first_revoke").isNull() | (F.col("order") < F.col("first_revoke")))
    rows = rows.withColumn("proof", F.min(F.when(proves, F.struct("at", "id", "channel"))).over(token)).withColumn("claimed", F.when(F.col("proof").isNotNull(), F.struct("proof.at", "proof.id")))
    resigned = (F.col("kind") == "resign") & (F.col("user_id") == F.col("issue.user_id")) & (F.col("order") > F.col("claimed"))
    each = rows.groupBy("game_id", "token").agg(
        *[F.any_value(c).alias(c) for c in ("issue", "issued", "expires_at", "first_revoke", "claimed")], F.any_value("proof.channel").alias("via"),
        F.min(F.when(resigned, F.col("order"))).alias("resigned"), F.max(F.when(revoke, F.col("order"))).alias("last_revoke"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "beacon") & (F.col("order") >= F.col("claimed")), F.col("order")))).alias("seen"),
    )
    each = each.withColumn("pending_until", F.least("claimed", "first_revoke", _when(F.col("expires_at"), F.lit(-1).cast("long"))))
    minted = greedy(each.withColumn("user_id", F.col("issue.user_id")), ["game_id", "user_id"], "issued", "pending_until").withColumn("reissued", F.col("nth") > 0)
    # from the last claim on, as a running minimum; a frame that reaches to the end is worked out anew for each row
    later = Window.partitionBy("game_id").orderBy(F.col("claimed").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    takeover = F.when(F.col("claimed").isNotNull(), F.min(F.when(F.col("issue.intent") == "assume", F.col("claimed"))).over(later))
    # rows without ``claimed`` come last in the window and are no one's successor
    ends = minted.withColumn("takeover", takeover).withColumn("ended", F.least("first_revoke", "resigned", "takeover"))
    latest = F.greatest("ended", "last_revoke")
    reason = F.when(latest.isNull(), F.lit(None)).when(latest == F.col("last_revoke"), "revoked").when(latest == F.col("resigned"), "resigned").otherwise("counter_claim")
    lost = ends.where("ended = takeover").groupBy("game_id", F.col("ended").alias("claimed")).agg(F.count("*").alias("n"))
    out = ends.join(lost, ["game_id", "claimed"], "left")
    before = F.filter("seen", lambda s: F.col("ended").isNull() | (s < F.col("ended")))
    return out.select(
        "game_id", "token", "user_id", F.col("issue.intent").alias("intent"), "issued", "expires_at", "reissued", "claimed", "via", F.array_max(before)["at"].alias("last_seen_at"),
        "ended", latest["at"].alias("revoked_at"), reason.alias("reason"), F.coalesce("n", F.lit(0)).cast("long").alias("displaced"),
    )


def state_at(now: str) -> Column:
    at = F.expr(now)
    return F.when(F.col("ended").isNotNull(), "revoked").when(F.col("claimed").isNotNull(), "verified").when(F.col("expires_at") > at, "pending").otherwise("expired")


def pending_or_dns(claims: DataFrame, now: str) -> DataFrame:
    """Claims whose token the name system should be asked for: still pending, or verified by it."""
    pending = F.col("claimed").isNull() & (F.col("expires_at") > F.expr(now))
    return claims.where(F.col("ended").isNull() & (pending | (F.col("claimed").isNotNull() & (F.col("via") == "dns_txt"))))


def claim_verdicts(events: DataFrame, claims: DataFrame, recheck: str = RECHECK) -> DataFrame:
    """What each event came to: ``(game_id, id, kind, verdict)``. Issues come to a new claim, a repeated one, or the pending one there is."""
    checks = events.where("kind = 'check' AND token IS NOT NULL").withColumn("order", F.struct("at", "id")).join(claims.select("game_id", "token", "issued"), ["game_id", "token"]).where("order > issued")
    checks = checks.withColumn("until", _when(F.col("at") + F.expr(recheck), F.lit(-1).cast("long")))
    looked = greedy(checks.select("game_id", "token", "id", "order", "until"), ["game_id", "token"], "order", "until").select("game_id", "id", F.lit(True).alias("looked"))
    mine = claims.select("game_id", "token", F.col("user_id").alias("owner"), "intent", "issued", "expires_at", "reissued", "claimed", "ended", "displaced")
    rows = events.drop("intent").withColumn("order", F.struct("at", "id")).join(mine, ["game_id", "token"], "left").join(looked, ["game_id", "id"], "left")
    known = F.coalesce(F.col("order") > F.col("issued"), F.lit(False))
    proven = F.coalesce(F.col("order") > F.col("claimed"), F.lit(False)) & (F.col("ended").isNull() | (F.col("order") < F.col("ended")))
    waiting = F.col("claimed").isNull() | (F.col("order") < F.col("claimed"))
    waiting = waiting & (F.col("at") < F.col("expires_at")) & (F.col("ended").isNull() | (F.col("order") < F.col("ended")))
    beacon = (
        F.when(~known, "nothing_to_do").when(F.col("order") == F.col("claimed"), F.when((F.col("intent") == "assume") & (F.col("displaced") > 0), "assumed").otherwise("verified"))
        .when(proven, "still_seen").when(waiting, "nothing_to_do").otherwise("stale")
    )
    ended_now = F.coalesce(F.col("order") == F.col("ended"), F.lit(False))
    resign = F.when(~known, "not_found").when(F.col("user_id") != F.col("owner"), "not_yours").when(proven | ended_now, "resigned").otherwise("not_verified")
    issue = F.when(F.col("order") == F.col("issued"), F.when(F.col("reissued"), "reissued").otherwise("issued")).otherwise("pending")
    check = F.when(~known, "not_found").when(F.col("looked"), "checked").otherwise("too_soon")
    verdict = (
        F.when(F.col("kind") == "beacon", beacon).when(F.col("kind") == "resign", resign).when(F.col("kind") == "issue", issue).when(F.col("kind") == "check", check)
        .otherwise(F.when(known, "revoked").otherwise("not_found"))
    )
    return rows.select("game_id", "id", "kind", verdict.alias("verdict"))


def dns_sweep(live: DataFrame, offered: DataFrame) -> DataFrame:
    """``(game_id, verdict)``: of each game with claims to ask for, the strongest verdict on the tokens its name publishes, or ``none``."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in zip(VERDICTS, range(len(VERDICTS))) for x in pair]), F.col("verdict"))
    best = offered.groupBy("game_id").agg(F.min_by("verdict", rank).alias("best"))
    verdict = F.when(F.col("best").isNull() | (F.col("best") == "nothing_to_do"), "none").otherwise(F.col("best"))
    return live.select("game_id").distinct().join(best, "game_id", "left").select("game_id", verdict.alias("verdict"))


def claimed_games(claims: DataFrame) -> DataFrame:
    """Per game with claims, its owners in order and whether it counts as claimed."""
    owner = F.when(F.col("claimed").isNotNull() & F.col("ended").isNull(), F.col("user_id"))
    return claims.groupBy("game_id").agg(F.array_sort(F.collect_set(owner)).alias("owners")).select("game_id", "owners", (F.size("owners") > 0).alias("is_claimed"))
