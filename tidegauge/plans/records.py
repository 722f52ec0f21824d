"""Queries on records from outside, addresses, hashes, and the rules that read them row by row."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import net, text
from tidegauge.operators import fields as FD
from tidegauge.operators import policy
from tidegauge.plans.availability import _SPANS, spans
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C
from tidegauge.sources import records as R

# Both engines read each of these.
_ADDRESSES = """SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'no address' WHEN 3 THEN NULL
  ELSE concat(event_id % 256, '.', user_id % 256, '.', event_id % 7, '.', user_id % 251) END AS address,
  ((CAST(event_id % 256 AS BIGINT) * 256 + user_id % 256) * 256 + event_id % 7) * 256 + user_id % 251 AS n FROM events"""
_RESERVED = " OR ".join(f"n BETWEEN {int(b.network_address)} AND {int(b.broadcast_address)}" for b in map(ipaddress.ip_network, net.RESERVED))


def _view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events"))


@query(f"WITH a AS ({_ADDRESSES}) SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NOT ({_RESERVED}) END AS routable FROM a")
def routable_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, _ADDRESSES).select("event_id", net.routable_ipv4(F.col("address")).alias("routable"))


_SOURCES = """SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN concat('198.18.', user_id % 256, '.', event_id % 256) WHEN 3 THEN 'unknown'
  ELSE concat('2a00:', user_id % 9000 + 1000, ':0:', event_id % 9 + 1, ':aa:0:0:', event_id % 10) END AS address FROM events"""


@query(f"""WITH s AS ({_SOURCES}) SELECT event_id, CASE event_id % 4 WHEN 0 THEN address WHEN 3 THEN NULL
  ELSE concat(regexp_extract(address, '^(2a00:[0-9]+:0:[0-9])', 1), '::/64') END AS bucket, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS epoch FROM s""")
def source_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, _SOURCES).select("event_id", net.source_bucket(F.col("address")).alias("bucket"), net.salt_epoch(F.col("ts")).alias("epoch"))


_KEY = b"an example key"
_INNER, _OUTER = (bytes(x ^ pad for x in _KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"""SELECT c_custkey, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))) AS hash FROM customer""")
def keyed_hashes(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "customer").select("c_custkey", net.keyed_hash(_KEY, F.col("c_name")).alias("hash"))


@query("""SELECT doc_id, '"' || rtrim(translate(base64(unhex(sha256(text))), '+/', '-_'), '=') || '"' AS tag FROM documents""")
def entity_tags(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id", net.entity_tag(F.col("text")).alias("tag"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'last' END AS players FROM events""")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    report = """CASE event_id % 3 WHEN 0 THEN map('NAME', array('x'), 'Players', array('0', CAST(user_id AS STRING)))
      WHEN 1 THEN map('players', array('first', 'last')) ELSE map('PLAYERS_MAX', array('9')) END AS report"""
    return C.table(spark, d, "events").selectExpr("event_id", report).select("event_id", R.last_value(F.col("report"), "PLAYERS").alias("players"))


@query("""WITH e AS (SELECT event_id, CAST(user_id % 9 AS INT) + 4000 AS port FROM events)
SELECT event_id, port, 'capability.gmcp.measured' AS field, 'handshake' AS source, 'true' AS value FROM e WHERE event_id % 2 = 0
UNION ALL SELECT event_id, port, 'capability.mssp.measured', 'handshake', 'true' FROM e WHERE event_id % 2 = 0
UNION ALL SELECT event_id, port, 'CODEBASE', 'mssp', 'b' FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, port, 'VERSION', 'info', concat('v', event_id) FROM e WHERE event_id % 5 = 0""")
def probe_facts(spark: SparkSession, d: str) -> DataFrame:
    """Probe records as facts: offered options, the last of each declared variable that is not empty, and the version."""
    rows = C.table(spark, d, "events").selectExpr(
        "CAST(event_id AS STRING) AS host", "CAST(user_id % 9 AS INT) + 4000 AS port", "ts AS observed_at",
        "CASE WHEN event_id % 2 = 0 THEN array('GMCP', 'MSSP') END AS offered_options",
        "CASE WHEN event_id % 3 = 0 THEN map('codebase', array('a', 'b'), 'genre', array('')) END AS mssp",
        "CASE WHEN event_id % 5 = 0 THEN concat('v', event_id) END AS version",
    )
    return R.field_observations(rows).select(F.col("host").cast("long").alias("event_id"), "port", "field", "source", "value")


_COUNTS = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 5 END AS who, CASE event_id % 4 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'many' WHEN 2 THEN '-3' END AS mssp,
  CASE WHEN event_id % 7 = 0 THEN 3 END AS info, CASE WHEN event_id % 11 = 0 THEN 2 END AS banner, event_id % 2 = 0 AS offered, event_id % 13 = 0 AS prompt FROM events"""


@query(f"""WITH c AS ({_COUNTS}) SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 5 WHEN event_id % 4 = 0 THEN 12 WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 2 END AS INT) AS cnt,
  CASE WHEN event_id % 5 = 0 THEN 'who' WHEN event_id % 4 = 0 THEN 'mssp' WHEN event_id % 7 = 0 THEN 'info' WHEN event_id % 11 = 0 THEN 'banner' END AS source,
  CASE WHEN event_id % 5 = 0 OR event_id % 4 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'who_login_prompt'
       WHEN event_id % 4 IN (1, 2) THEN 'players_not_numeric' WHEN event_id % 2 = 0 THEN 'who_unparseable' ELSE 'who_not_offered' END AS reason FROM c""")
def presence_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = _view(spark, d, _COUNTS)
    return c.select("event_id", policy.presence_choice(*map(F.col, ["who", "mssp", "info", "banner", "offered", "prompt"])).alias("c")).select("event_id", "c.*")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'degraded' ELSE 'unreachable' END AS state,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'handshake_stalled' WHEN event_type = 'error' THEN 'timeout' ELSE 'refused' END AS cause FROM events""")
def failure_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'refused' END AS cause", "CASE WHEN event_id % 2 = 0 THEN array('GMCP') ELSE array() END AS offered")
    return rows.select("event_id", policy.failure_state(F.col("cause"), F.col("offered")).alias("r")).select("event_id", "r.*")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'rate_limited' WHEN event_id % 3 = 0 THEN 'malformed' WHEN event_id % 5 = 0 THEN 'already_listed'
  WHEN event_id % 7 = 0 THEN 'already_queued' WHEN event_id % 11 = 0 THEN 'out_of_scope' WHEN event_id % 13 = 0 THEN 'opted_out' ELSE 'accepted' END AS verdict FROM events""")
def submission_outcomes(spark: SparkSession, d: str) -> DataFrame:
    by = lambda n: F.col("event_id") % n == 0
    return C.table(spark, d, "events").select("event_id", policy.submission_verdict(by(2), ~by(3), by(5), by(7), ~by(11), by(13)).alias("verdict"))


@query(_SPANS + """ SELECT game_id, state, cause, from_at, CASE WHEN to_at IS NULL AND from_at <= TIMESTAMP '2024-01-29 12:00:00'
  THEN TIMESTAMP '2024-01-29 12:00:00' ELSE to_at END AS to_at FROM availability""")
def gap_closing(spark: SparkSession, d: str) -> DataFrame:
    """The crawler was silent from the 29th to the 31st."""
    return policy.close_after_gap(spans(spark, d), "timestamp_ntz'2024-01-29 12:00:00'", C.NOW)


@query("SELECT o_orderkey, concat('host', o_custkey, '.example') AS host, CAST(unnest([23, 4000, o_orderkey % 100 + 5000]) AS INT) AS port FROM orders")
def parallel_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and ports that stand side by side in two arrays, as rows."""
    sides = C.table(spark, d, "orders").selectExpr("o_orderkey", "array_repeat(concat('host', o_custkey, '.example'), 3) AS hosts", "array(23, 4000, CAST(o_orderkey % 100 + 5000 AS INT)) AS ports")
    return sides.selectExpr("o_orderkey", "inline(arrays_zip(hosts, ports))").toDF("o_orderkey", "host", "port")


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN concat('caf', chr(195), chr(169), ' ', event_id) WHEN user_id % 4 = 1 THEN concat('caf', chr(233), ' ', event_id)
  ELSE concat('plain ', event_id) END AS text FROM events""")
def wire_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Sessions in UTF-8, and sessions in which one payload is not valid in it: all of theirs is read as Latin-1."""
    raw = """CASE WHEN user_id % 4 < 2 THEN encode(concat('caf', chr(233), ' ', event_id), 'UTF-8')
      ELSE encode(concat('plain', decode(unhex('00'), 'UTF-8'), ' ', event_id), 'UTF-8') END AS payload"""
    rows = C.table(spark, d, "events").selectExpr("event_id", "user_id", raw)
    bad = rows.where("user_id % 4 = 0").groupBy("user_id").agg(F.lit(-1).cast("long").alias("event_id")).select("event_id", "user_id", F.unhex(F.lit("E9")).alias("payload"))
    return R.decoded(rows.unionByName(bad), "user_id", "payload").where("event_id >= 0").select("event_id", "text")


_LISTS = "SELECT event_id, concat('a', user_id, '.example 4000', chr(10), 'b', user_id, '.example:', event_id % 60000 + 1, ' | nonsense; ', 'c', user_id, '.example:99999') AS entries FROM events"


@query(f"""WITH l AS ({_LISTS}) SELECT event_id, regexp_extract(entries, '^(a[0-9]+\\.example)', 1) AS host, 4000 AS port FROM l
UNION ALL SELECT event_id, regexp_extract(entries, '(b[0-9]+\\.example)', 1), CAST(event_id % 60000 + 1 AS INT) FROM l
UNION ALL SELECT event_id, 'nonsense', NULL FROM l""")
def referral_entries(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, _LISTS).select("event_id", F.inline(text.referrals(F.col("entries"))))


@query("""WITH f AS (SELECT DISTINCT user_id AS game_id, upper(event_type) AS protocol FROM events WHERE event_id % 3 = 0 AND event_id % 4 > 0)
SELECT game_id, string_agg(protocol, ',' ORDER BY protocol) AS protocols FROM f GROUP BY game_id""")
def measured_protocols(spark: SparkSession, d: str) -> DataFrame:
    field = "concat('capability.', event_type, CASE WHEN event_id % 3 = 0 THEN '.measured' ELSE '.declared' END) AS field"
    facts = C.table(spark, d, "events").selectExpr("user_id AS game_id", field, "CASE WHEN event_id % 4 > 0 THEN 'true' ELSE 'false' END AS value")
    return FD.measured_protocols(facts).withColumn("protocols", F.array_join("protocols", ","))


@query("SELECT o_custkey AS game_id, max(o_orderdate) AS changed_at FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey")
def latest_change(spark: SparkSession, d: str) -> DataFrame:
    return FD.latest_change(C.table(spark, d, "orders").selectExpr("o_custkey AS game_id", "o_orderpriority AS field", "o_orderdate AS changed_at"), "2-high")
