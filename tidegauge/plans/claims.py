"""Queries on claims. Blocks of ten events make a claim's history; some point to tokens of earlier blocks of the same game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import claims as K
from tidegauge.plans.registry import query
from tidegauge.session import stored
from tidegauge.sources import catalogue as C

# Both engines read this text.
_EVENTS = """SELECT b % 40 AS game_id, event_id AS id, ts AS at, kind, CASE WHEN kind = 'resign' AND b % 2 = 1 THEN 9 ELSE CAST(floor(target / 40) AS BIGINT) % 2 END AS user_id,
  concat('claim-', CAST(target AS STRING)) AS token, CASE WHEN kind = 'issue' THEN CASE WHEN b % 7 = 0 THEN 'assume' ELSE 'join' END END AS intent,
  CASE WHEN kind = 'beacon' THEN CASE k WHEN 4 THEN 'dns_txt' WHEN 7 THEN 'connect_screen' ELSE 'mssp' END END AS channel
FROM (SELECT *,
    CASE WHEN k = 0 THEN 'issue' WHEN k IN (2, 3) OR k = 9 AND b % 3 <> 0 THEN 'check' WHEN k = 6 THEN 'resign' WHEN k = 5 AND b % 3 <> 0 OR k = 9 THEN 'revoke' ELSE 'beacon' END AS kind,
    CASE WHEN k IN (0, 2, 3) OR k IN (1, 8) AND b % 5 <> 0 THEN b WHEN k IN (1, 5) THEN b - 80 WHEN k IN (4, 6) OR k = 9 AND b % 3 <> 0 THEN b - 40 WHEN k = 9 THEN b - 200 ELSE b - 120 END AS target
  FROM (SELECT event_id, ts, event_id % 10 AS k, CAST(floor(event_id / 10) AS BIGINT) AS b FROM events) x) y"""
LIFETIME, RECHECK, AT = "INTERVAL 6 DAYS", "INTERVAL 20 MINUTES", "timestamp_ntz'2024-01-20 00:00:00'"

_CLAIMS = f"""WITH RECURSIVE claim_event AS ({_EVENTS}),
history AS (
  SELECT e.*, {{'at': e.at, 'id': e.id}} AS ord, {{'at': i.at, 'id': i.id}} AS issued, i.user_id AS owner, i.intent AS wanted, i.at + INTERVAL 6 DAY AS expires_at
  FROM claim_event e JOIN claim_event i ON i.kind = 'issue' AND i.game_id = e.game_id AND i.token = e.token WHERE (e.at, e.id) >= (i.at, i.id)),
stopped AS (SELECT *, min(ord) FILTER (WHERE kind = 'revoke') OVER (PARTITION BY game_id, token) AS first_revoke FROM history),
proven AS (SELECT *, min({{'at': "at", 'id': id, 'channel': channel}}) FILTER (WHERE kind = 'beacon' AND "at" < expires_at AND NOT (channel = 'dns_txt' AND wanted = 'assume')
    AND (first_revoke IS NULL OR ord < first_revoke)) OVER (PARTITION BY game_id, token) AS proof FROM stopped),
marked AS (SELECT *, CASE WHEN proof IS NOT NULL THEN {{'at': proof.at, 'id': proof.id}} END AS claimed, proof.channel AS via FROM proven),
asked AS (
  SELECT game_id, token, owner AS user_id, wanted AS intent, issued, expires_at, first_revoke, claimed, via, max(ord) FILTER (WHERE kind = 'revoke') AS last_revoke,
         min(ord) FILTER (WHERE kind = 'resign' AND user_id = owner AND ord > claimed) AS resigned, list(ord) FILTER (WHERE kind = 'beacon' AND ord >= claimed) AS seen
  FROM marked GROUP BY ALL),
due AS (SELECT *, least(coalesce(claimed, first_revoke, {{'at': expires_at, 'id': -1}}), coalesce(first_revoke, {{'at': expires_at, 'id': -1}}), {{'at': expires_at, 'id': -1}}) AS pending_until FROM asked),
minted AS (
  SELECT *, 0 AS nth FROM (SELECT * FROM due QUALIFY row_number() OVER (PARTITION BY game_id, user_id ORDER BY issued) = 1) f
  UNION ALL SELECT d.*, nth + 1 FROM minted m JOIN due d ON d.game_id = m.game_id AND d.user_id = m.user_id AND d.issued >= m.pending_until
  QUALIFY row_number() OVER (PARTITION BY d.game_id, d.user_id ORDER BY d.issued) = 1),
followed AS (SELECT *, CASE WHEN claimed IS NOT NULL THEN (SELECT min(o.claimed) FROM minted o WHERE o.game_id = m.game_id AND o.intent = 'assume' AND o.claimed > m.claimed) END AS takeover FROM minted m),
ends AS (SELECT *, list_min(list_filter([first_revoke, resigned, takeover], lambda x: x IS NOT NULL)) AS ended FROM followed),
lasting AS (SELECT *, list_max(list_filter([ended, last_revoke], lambda x: x IS NOT NULL)) AS latest FROM ends),
claim AS (
  SELECT game_id, token, user_id, intent, issued, expires_at, nth > 0 AS reissued, claimed, via, list_max(list_filter(seen, lambda x: ended IS NULL OR x < ended)).at AS last_seen_at, ended, latest.at AS revoked_at,
         CASE WHEN latest IS NULL THEN NULL WHEN latest = last_revoke THEN 'revoked' WHEN latest = resigned THEN 'resigned' ELSE 'counter_claim' END AS reason,
         (SELECT count(*) FROM lasting o WHERE o.game_id = l.game_id AND o.ended = o.takeover AND o.ended = l.claimed) AS displaced FROM lasting l)"""
_SHOWN = """game_id, token, user_id, intent, issued.at AS issued_at, expires_at, reissued, claimed.at AS claimed_at, via, last_seen_at, revoked_at, reason, displaced,
CASE WHEN ended IS NOT NULL THEN 'revoked' WHEN claimed IS NOT NULL THEN 'verified' WHEN expires_at > TIMESTAMP '2024-01-20' THEN 'pending' ELSE 'expired' END AS state"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_EVENTS.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events"))


def _shown(claims: DataFrame) -> DataFrame:
    return claims.select(
        "game_id", "token", "user_id", "intent", F.col("issued.at").alias("issued_at"), "expires_at", "reissued", F.col("claimed.at").alias("claimed_at"), "via", "last_seen_at",
        "revoked_at", "reason", "displaced", K.state_at(AT).alias("state"),
    )


@query(_CLAIMS + f" SELECT {_SHOWN} FROM claim")
def claim_states(spark: SparkSession, d: str) -> DataFrame:
    return _shown(K.claim_states(_events(spark, d), LIFETIME))


@query(_CLAIMS + f" SELECT {_SHOWN} FROM claim WHERE ended IS NULL AND (claimed IS NULL AND expires_at > TIMESTAMP '2024-01-20' OR claimed IS NOT NULL AND via = 'dns_txt')")
def claims_to_ask_for(spark: SparkSession, d: str) -> DataFrame:
    return _shown(K.pending_or_dns(K.claim_states(_events(spark, d), LIFETIME), AT))


@query(_CLAIMS + """ SELECT game_id, list_sort(list_distinct(list(user_id) FILTER (WHERE claimed IS NOT NULL AND ended IS NULL))) AS l, coalesce(array_to_string(l, ','), '') AS owners, coalesce(len(l), 0) > 0 AS is_claimed FROM claim GROUP BY game_id""".replace("SELECT game_id, list_sort", "SELECT game_id, owners, is_claimed FROM (SELECT game_id, list_sort") + ")")
def claimed_games(spark: SparkSession, d: str) -> DataFrame:
    found = K.claimed_games(K.claim_states(_events(spark, d), LIFETIME))
    return found.withColumn("owners", F.array_join(F.col("owners").cast("array<string>"), ","))


_VERDICTS = _CLAIMS + """,
chk AS (SELECT h.game_id, h.token, h.ord, h.at, h.id FROM history h JOIN claim c USING (game_id, token) WHERE h.kind = 'check' AND h.ord > c.issued),
looked AS (
  SELECT * FROM (SELECT * FROM chk QUALIFY row_number() OVER (PARTITION BY game_id, token ORDER BY ord) = 1) f
  UNION ALL SELECT c.* FROM looked l JOIN chk c ON c.game_id = l.game_id AND c.token = l.token AND c.at >= l.at + INTERVAL 20 MINUTE
  QUALIFY row_number() OVER (PARTITION BY c.game_id, c.token ORDER BY c.ord) = 1),
faced AS (
  SELECT e.game_id, e.id, e.at, e.kind, e.user_id AS who, {'at': e.at, 'id': e.id} AS ord, e.channel, c.*, l.id IS NOT NULL AS looked FROM claim_event e LEFT JOIN claim c ON c.game_id = e.game_id AND c.token = e.token
  LEFT JOIN looked l ON l.id = e.id),
verdict AS (
  SELECT game_id, id, channel, kind, CASE
    WHEN kind = 'issue' THEN CASE WHEN ord = issued THEN CASE WHEN reissued THEN 'reissued' ELSE 'issued' END ELSE 'pending' END
    WHEN issued IS NULL OR ord <= issued THEN CASE WHEN kind = 'beacon' THEN 'nothing_to_do' ELSE 'not_found' END
    WHEN kind = 'check' THEN CASE WHEN looked THEN 'checked' ELSE 'too_soon' END
    WHEN kind = 'revoke' THEN 'revoked'
    WHEN kind = 'resign' THEN CASE WHEN who <> user_id THEN 'not_yours' WHEN claimed IS NULL OR ord < claimed OR ord > ended THEN 'not_verified' ELSE 'resigned' END
    WHEN ord = claimed THEN CASE WHEN intent = 'assume' AND displaced > 0 THEN 'assumed' ELSE 'verified' END
    WHEN ord > claimed AND (ended IS NULL OR ord < ended) THEN 'still_seen'
    WHEN (ended IS NULL OR ord < ended) AND (claimed IS NULL OR ord < claimed) AND "at" < expires_at THEN 'nothing_to_do' ELSE 'stale' END AS verdict
  FROM faced)"""


@query(_VERDICTS + " SELECT game_id, id, kind, verdict FROM verdict")
def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return K.claim_verdicts(events, stored(K.claim_states(events, LIFETIME)), RECHECK)


@query(_VERDICTS + """, live AS (SELECT DISTINCT game_id FROM claim WHERE ended IS NULL AND (claimed IS NULL AND expires_at > TIMESTAMP '2024-01-20' OR claimed IS NOT NULL AND via = 'dns_txt')),
best AS (SELECT game_id, min(CASE verdict WHEN 'assumed' THEN 0 WHEN 'verified' THEN 1 WHEN 'still_seen' THEN 2 WHEN 'stale' THEN 3 END) AS r FROM verdict WHERE kind = 'beacon' AND channel = 'dns_txt' GROUP BY game_id)
SELECT game_id, CASE r WHEN 0 THEN 'assumed' WHEN 1 THEN 'verified' WHEN 2 THEN 'still_seen' WHEN 3 THEN 'stale' ELSE 'none' END AS verdict FROM live LEFT JOIN best USING (game_id)""")
def claim_dns_sweep(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    claims = stored(K.claim_states(events, LIFETIME))
    verdicts = K.claim_verdicts(events, claims, RECHECK).join(events.where("channel = 'dns_txt'").select("game_id", "id"), ["game_id", "id"])
    return K.dns_sweep(K.pending_or_dns(claims, AT), verdicts)
