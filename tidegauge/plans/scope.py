"""Queries on opt-outs and on the scope of addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import net
from tidegauge.operators import scope as S
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

# Both engines read these.
_TARGETS = "SELECT o_orderkey AS id, concat('h', CAST(o_custkey % 400 AS STRING)) AS host, CAST(4000 + o_orderkey % 6 AS INT) AS port FROM orders"
_OPT_OUTS = """SELECT concat('h', CAST(c_custkey % 500 AS STRING)) AS host, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(4000 + c_custkey % 7 AS INT) END AS port,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'mssp' WHEN 'MACHINERY' THEN 'request' ELSE 'dns_txt' END AS source, TIMESTAMP '2024-01-01 00:00:00' + c_custkey % 97 * INTERVAL '1' HOUR AS recorded_at,
  CASE WHEN c_nationkey % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS withdrawn_at FROM customer"""
_ANSWERS = """SELECT concat('h', CAST(c_custkey AS STRING)) AS host, c_custkey % 5 <> 0 AS answered, CASE c_custkey % 9 WHEN 0 THEN 'v=spf1 -all' WHEN 1 THEN 'opt-out' WHEN 2 THEN 'v=one; OPT-OUT=4001'
  WHEN 3 THEN ' optout:4002,4003 ' WHEN 4 THEN 'opt-out=all' WHEN 5 THEN 'opt-outs are nice' WHEN 6 THEN 'x opt-out=4000, more' WHEN 7 THEN '' ELSE 'noopt-out' END AS record FROM customer WHERE c_custkey < 400"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, customer = C.table(spark, d, "orders"), C.table(spark, d, "customer")
    read = lambda text, name, rows: spark.sql(text.replace("FROM " + name, "FROM {rows}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), rows=rows)
    answers = read(_ANSWERS, "customer", customer).select("host", "answered", F.array("record", F.lit("unrelated")).alias("records"))
    return read(_TARGETS, "orders", orders), read(_OPT_OUTS, "customer", customer), answers


_STANDING = f"""WITH target AS ({_TARGETS}), opt_out AS ({_OPT_OUTS}), answer AS ({_ANSWERS}),
first AS (SELECT t.id, t.host, t.port, o.source, o.port AS asked_port, o.recorded_at FROM target t LEFT JOIN opt_out o ON o.host = t.host AND (o.port IS NULL OR o.port = t.port) AND o.withdrawn_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY o.recorded_at, o.port NULLS FIRST, o.source) = 1)"""


@query(_STANDING + " SELECT * FROM first")
def opt_out_standing(spark: SparkSession, d: str) -> DataFrame:
    targets, opt_outs, _ = _tables(spark, d)
    return S.standing(targets, opt_outs).select("id", "host", "port", "opt_out.source", F.col("opt_out.port").alias("asked_port"), "opt_out.recorded_at")


@query(_STANDING + """, heard AS (SELECT f.*, coalesce(a.answered, false) AS answered, CASE
    WHEN a.record IN ('opt-out', 'opt-out=all') THEN true WHEN a.record LIKE '%=4001' THEN port = 4001 WHEN a.record LIKE '%4002,4003%' THEN port IN (4002, 4003)
    WHEN a.record LIKE 'x opt-out%' THEN port = 4000 ELSE false END AS asks,
  EXISTS (SELECT 1 FROM opt_out o WHERE o.host = f.host AND (o.port IS NULL OR o.port = f.port) AND o.withdrawn_at IS NULL AND o.source <> 'dns_txt') AS other
  FROM first f LEFT JOIN answer a ON a.host = f.host)
SELECT id, host, port, CASE WHEN source <> 'dns_txt' THEN 'standing' WHEN NOT answered THEN CASE WHEN source IS NULL THEN 'unanswered_free' ELSE 'unanswered_standing' END
  WHEN asks THEN CASE WHEN source IS NULL THEN 'recorded' ELSE 'confirmed' END WHEN source IS NULL THEN 'free' WHEN other THEN 'withdrawn_other_stands' ELSE 'withdrawn' END AS ruling,
  CASE WHEN source <> 'dns_txt' THEN false WHEN NOT answered THEN source IS NULL ELSE NOT asks AND (source IS NULL OR NOT other) END AS may_dial FROM heard""")
def opt_out_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.gate(*_tables(spark, d))


# Each customer has two addresses of nine forms, made from its number.
_FORMS = """CASE {k} WHEN 0 THEN concat('8.8.', CAST(n % 250 AS STRING), '.1') WHEN 1 THEN concat('2a00:1450:', CAST(n % 9999 AS STRING), '::1') WHEN 2 THEN concat('::ffff:9.9.9.', CAST(n % 250 AS STRING))
  WHEN 3 THEN '2001:db8:0:0:0:0:0:9' WHEN 4 THEN concat('1:2:3:4:5:6:', CAST(n % 250 AS STRING), '.7.7.7') WHEN 5 THEN concat('10.1.1.', CAST(n % 250 AS STRING))
  WHEN 6 THEN concat('fe9', CAST(n % 9 AS STRING), '::1') WHEN 7 THEN concat('::ffff:127.0.0.', CAST(n % 250 AS STRING)) ELSE concat('fd', CAST(10 + n % 80 AS STRING), ':1::') END"""
_HOSTS = f"""SELECT n, n % 10 = 0 AS seed, n % 8 = 0 AS silent, {_FORMS.format(k="n % 5")} AS one, {_FORMS.format(k="CAST(floor(n / 5) AS BIGINT) % 9")} AS two
FROM (SELECT c_custkey AS n FROM customer) x"""


@query(f"""WITH h AS ({_HOSTS}) SELECT n, CASE WHEN seed THEN 'allowed' WHEN silent THEN 'unresolvable' WHEN CAST(floor(n / 5) AS BIGINT) % 9 >= 5 THEN 'refused_non_global' ELSE 'allowed' END AS ruling FROM h""")
def scope_ruling(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by all their addresses, of both families and several spellings; a seed is not asked about, and one without addresses is not dialled."""
    hosts = spark.sql(_HOSTS.replace("FROM customer", "FROM {customer}"), customer=C.table(spark, d, "customer"))
    addresses = F.when(~F.col("silent"), F.array("one", "two"))
    return hosts.select("n", S.scope_ruling(F.col("seed"), addresses).alias("ruling"))


_BLOCKS = ["8.8.0.0/16", "8.8.0.0/17", "9.0.0.0/8", "2a00::/12", "2a00:1450::/32", "fe80::/10", "fd00::/8", "10.1.1.64/26", "0.0.0.0/0"]


@query(f"""WITH h AS ({_HOSTS}), a AS (SELECT n, CAST(floor(n / 5) AS BIGINT) % 9 AS k, two AS address FROM h)
SELECT n, address, CASE k WHEN 0 THEN CASE WHEN n % 250 < 128 THEN '8.8.0.0/17' ELSE '8.8.0.0/16' END WHEN 1 THEN '2a00:1450::/32' WHEN 2 THEN '9.0.0.0/8'
  WHEN 5 THEN CASE WHEN n % 250 BETWEEN 64 AND 127 THEN '10.1.1.64/26' ELSE '0.0.0.0/0' END WHEN 6 THEN 'fe80::/10' WHEN 7 THEN '0.0.0.0/0' WHEN 8 THEN 'fd00::/8' END AS block FROM a""")
def address_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The longest block that an address lies in, by equality on prefixes."""
    hosts = spark.sql(_HOSTS.replace("FROM customer", "FROM {customer}"), customer=C.table(spark, d, "customer")).select("n", F.col("two").alias("address"))
    blocks = spark.createDataFrame([(str(ipaddress.ip_network(b)), *r) for b, r in zip(_BLOCKS, net.block_rows(_BLOCKS))], "block string, family int, length int, hi long, lo long")
    return S.in_blocks(hosts, blocks)
