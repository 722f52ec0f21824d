"""The claim lifecycle, one transition after another."""

import random
from datetime import datetime, timedelta

from tidegauge.operators import claims as K

START = datetime(2024, 1, 1)
SCHEMA = "game_id long, id long, at timestamp_ntz, kind string, user_id long, token string, intent string, channel string"


def history(spark, *events):
    """``(minutes, kind, user, token, intent or channel)`` on game 1, in any order."""
    rows = []
    for n, (at, kind, user, token, more) in enumerate(events):
        rows.append((1, n, START + timedelta(minutes=at), kind, user, token, more if kind == "issue" else None, more if kind == "beacon" else None))
    return spark.createDataFrame(rows[::-1], SCHEMA)


def seen(spark, *events, now="timestamp_ntz'2024-01-10 00:00:00'"):
    made = history(spark, *events)
    claims = K.claim_states(made)
    verdicts = {r.id: r.verdict for r in K.claim_verdicts(made, claims).collect()}
    states = {r.token: r for r in claims.withColumn("state", K.state_at(now)).collect()}
    return [verdicts[n] for n in range(len(events))], states


def test_issue_verify_see_again_resign(spark):
    verdicts, states = seen(
        spark, (0, "issue", 7, "a", "join"), (1, "issue", 7, "b", "join"), (5, "beacon", None, "b", "mssp"), (6, "beacon", None, "a", "mssp"), (9, "beacon", None, "a", "dns_txt"),
        (10, "resign", 8, "a", None), (11, "resign", 7, "a", None), (12, "resign", 7, "a", None), (13, "beacon", None, "a", "mssp"), (20, "issue", 7, "c", "join"),
    )
    assert verdicts == ["issued", "pending", "nothing_to_do", "verified", "still_seen", "not_yours", "resigned", "not_verified", "stale", "reissued"]
    assert set(states) == {"a", "c"} and states["a"].state == "revoked" and states["a"].reason == "resigned" and states["c"].state == "pending"
    assert states["a"].last_seen_at == START + timedelta(minutes=9)


def test_taking_over_ends_only_claims_verified_by_then(spark):
    verdicts, states = seen(
        spark, (0, "issue", 1, "a", "join"), (1, "beacon", None, "a", "mssp"), (2, "issue", 2, "b", "join"), (3, "issue", 3, "c", "assume"), (4, "beacon", None, "c", "dns_txt"),
        (5, "beacon", None, "c", "connect_screen"), (6, "beacon", None, "b", "dns_txt"), (7, "beacon", None, "a", "mssp"), (8, "issue", 4, "d", "assume"), (9, "beacon", None, "d", "mssp"),
    )
    assert verdicts == ["issued", "verified", "issued", "issued", "nothing_to_do", "assumed", "verified", "stale", "issued", "assumed"]
    assert states["c"].displaced == 1 and states["d"].displaced == 2 and states["a"].reason == "counter_claim" and states["b"].revoked_at == START + timedelta(minutes=9)


def test_taking_over_what_nobody_holds_is_only_verified(spark):
    verdicts, _ = seen(spark, (0, "issue", 1, "a", "assume"), (1, "beacon", None, "a", "mssp"))
    assert verdicts == ["issued", "verified"]


def test_expiry_and_revocation(spark):
    day = 24 * 60
    verdicts, states = seen(
        spark, (0, "issue", 1, "a", "join"), (30 * day, "beacon", None, "a", "mssp"), (31 * day, "issue", 1, "b", "join"), (31 * day + 1, "revoke", None, "b", None),
        (31 * day + 2, "beacon", None, "b", "mssp"), (31 * day + 9, "revoke", None, "b", None), (31 * day + 10, "revoke", None, "zz", None), now="timestamp_ntz'2024-03-01 00:00:00'",
    )
    assert verdicts == ["issued", "stale", "reissued", "revoked", "stale", "revoked", "not_found"]
    assert states["a"].state == "expired" and states["b"].state == "revoked" and states["b"].revoked_at == START + timedelta(minutes=31 * day + 9) and states["b"].claimed is None


def test_checks_wait_for_the_last_that_was_made(spark):
    verdicts, _ = seen(spark, (0, "issue", 1, "a", "join"), *[(m, "check", 1, "a", None) for m in (1, 3, 4, 6, 7)], (8, "check", 1, "none", None))
    assert verdicts[1:] == ["checked", "too_soon", "checked", "too_soon", "checked", "not_found"]


def test_owners_and_the_sweep(spark):
    made = history(spark, (0, "issue", 1, "a", "join"), (1, "beacon", None, "a", "dns_txt"), (2, "issue", 2, "b", "join"), (3, "beacon", None, "b", "mssp"), (4, "issue", 3, "c", "join"), (5, "beacon", None, "a", "dns_txt"))
    claims = K.claim_states(made)
    assert [(r.game_id, r.owners, r.is_claimed) for r in K.claimed_games(claims).collect()] == [(1, [1, 2], True)]
    live = K.pending_or_dns(claims, "timestamp_ntz'2024-01-02 00:00:00'")
    assert sorted(r.token for r in live.collect()) == ["a", "c"]
    offered = K.claim_verdicts(made, claims).where("id IN (1, 5)")
    assert [tuple(r) for r in K.dns_sweep(live, offered).collect()] == [(1, "verified")]
    assert [tuple(r) for r in K.dns_sweep(live, offered.where("false")).collect()] == [(1, "none")]


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.claim_states(none).collect() == [] and K.claim_verdicts(none, K.claim_states(none)).collect() == []


def test_kept_rows_equal_brute_force_also_over_many_batches(spark):
    r = random.Random(5)
    rows = [(None if k == 4 else k, n, START + timedelta(minutes=a), START + timedelta(minutes=a + r.randint(0, 50))) for n, (k, a) in enumerate((r.randint(0, 4), r.randint(0, 900)) for _ in range(600))]
    made = spark.createDataFrame(rows, "k int, id long, a timestamp_ntz, b timestamp_ntz").selectExpr("k", "struct(a AS at, id AS id) AS begins", "struct(b AS at, -1L AS id) AS ends")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((x.k, x.nth, x.begins.id) for x in K.greedy(made, ["k"], "begins", "ends").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, until, nth = [], {}, {}
    for k, n, a, b in sorted(rows, key=lambda x: (x[2], x[1])):
        if k not in until or (a, n) >= until[k]:
            until[k], nth[k] = (b, -1), nth.get(k, -1) + 1
            want.append((k, nth[k], n))
    assert got == sorted(want, key=str) and 50 < len(got) < 500


def test_no_claim_looks_at_all_later_ones(spark):
    """Frames from the next row to the end are worked out anew for each row; lists that a fold appends to are copied at each step."""
    plan = K.claim_states(history(spark, (0, "issue", 1, "a", "join")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, 1, unboundedfollowing" not in plan and "aggregate(" not in plan
