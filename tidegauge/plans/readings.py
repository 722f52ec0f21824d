"""Queries that read texts. What the twins expect is known from how each text is put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import text
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

# Both engines read these: a listing, and what it says.
_LISTINGS = """SELECT event_id, user_id % 90 AS n, CASE event_id % 9
  WHEN 0 THEN concat('Welcome to the harbour', chr(10), 'There are ', user_id % 90, ' players connected.')
  WHEN 1 THEN concat('12 guests', chr(10), user_id % 90, ' of 200 users are online right now')
  WHEN 2 THEN concat('Nobody is connected.', chr(10), '---')
  WHEN 3 THEN concat('No players logged in.', chr(10), 'Password:')
  WHEN 4 THEN concat('Player Name   On for  Idle', chr(10), '-----------', chr(10), 'Anders  1h  3m', chr(10), 'Berta   2h  0s')
  WHEN 5 THEN 'By what name do you wish to be known?'
  WHEN 6 THEN concat(chr(27), '[1mSeven people active', chr(27), '[0m', chr(13), chr(10), 'Maximum 90 players online: never reached')
  WHEN 7 THEN concat('Players online: ', user_id % 90)
  ELSE NULL END AS listing FROM events"""


@query(f"""WITH l AS ({_LISTINGS})
SELECT event_id, CASE event_id % 9 WHEN 3 THEN 'login_prompt' WHEN 4 THEN 'per_player' WHEN 5 THEN 'unreadable' WHEN 8 THEN 'unreadable' ELSE 'count' END AS confidence,
  CAST(CASE event_id % 9 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN 0 WHEN 4 THEN 2 WHEN 6 THEN 7 WHEN 7 THEN n END AS INT) AS cnt FROM l""")
def who_parse(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_LISTINGS.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events")).select("event_id", text.who_reading(F.col("listing")).alias("r")).select("event_id", "r.confidence", "r.cnt")


_BANNERS = """SELECT event_id, user_id % 90 AS n, CASE event_id % 7
  WHEN 0 THEN concat('Staff online: 3', chr(10), user_id % 90, ' players are playing')
  WHEN 1 THEN concat(user_id % 90, ' players connected', chr(10), user_id % 90 + 1, ' users online')
  WHEN 2 THEN '99999 players connected'
  WHEN 3 THEN concat('Users: ', user_id % 90)
  WHEN 4 THEN concat('2 wizards and ', user_id % 90, ' mortals are connected')
  WHEN 5 THEN 'A record of 40 players online was set'
  ELSE 'Founded 1992' END AS banner FROM events"""


@query(f"""WITH b AS ({_BANNERS})
SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN n WHEN 3 THEN n END AS INT) AS cnt FROM b WHERE event_id % 7 <> 4
UNION ALL SELECT event_id, CASE WHEN n = 2 THEN 2 END FROM b WHERE event_id % 7 = 4""")
def banner_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_BANNERS.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events")).select("event_id", text.banner_count(F.col("banner")).alias("cnt"))


@query("""SELECT event_id, concat('There are ', user_id % 90, ' players connected.', chr(10), 'Xxxxx ', regexp_replace(CAST(user_id AS VARCHAR), '[0-9]', '9', 'g'), ' xxxx ', 'Xx.') AS masked FROM events""")
def payload_redaction(spark: SparkSession, d: str) -> DataFrame:
    rows = C.table(spark, d, "events").selectExpr("event_id", "concat('There are ', user_id % 90, ' players connected.', chr(10), 'Berta ', user_id, ' from ', 'Ul.') AS listing")
    return rows.select("event_id", text.redacted(F.col("listing")).alias("masked"))


@query("""SELECT p_partkey, trim(substr(trim(regexp_replace(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64)) AS slug FROM part""")
def slug_mint(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '.example' AS host, CAST(s_suppkey % 60000 + 1 AS INT) AS port FROM supplier""")
def canonical_host(spark: SparkSession, d: str) -> DataFrame:
    written = C.table(spark, d, "supplier").selectExpr("s_suppkey", "concat(' ', regexp_replace(s_name, '[^A-Za-z0-9]', ''), '.Example.', ':', s_suppkey % 60000 + 1) AS written")
    return written.select("s_suppkey", text.address(F.col("written")).alias("a")).select("s_suppkey", "a.host", "a.port")


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), '^https?://[^/@?#\\s]+([/?#]\\S*)?$') AND length(trim(url)) <= 500 THEN trim(url) END AS address FROM pages""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("address"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '<!?/?[A-Za-z][^<>\x1b]*>', '', 'g') AS f FROM documents),
e AS (SELECT doc_id, regexp_replace(f, '\x1b\[[^@-~]*[@-~]?|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?|\x1b(?:.|)', '', 'g') AS f FROM t),
w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(f, '[ \t\n\x0b\f\r]+', ' ', 'g'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS f FROM e)
SELECT doc_id, CASE WHEN length(f) >= 40 THEN sha256(f) END AS fingerprint FROM w""")
def sha256_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
