"""Queries on a cycle of the inter-service gateway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import gateway as G
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

_ENTRIES = """SELECT concat('M', CAST(c_custkey AS STRING)) AS name, CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE concat('h', CAST(c_custkey % 90 AS STRING)) END AS host,
  CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(4000 + c_custkey % 4 AS INT) END AS port, c_custkey AS place,
  CASE c_custkey % 5 WHEN 0 THEN 'FluffOS' WHEN 1 THEN ' LDMud ' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'DGD' END AS driver, CASE c_custkey % 4 WHEN 0 THEN 'ldmud' WHEN 1 THEN 'TMI-2' WHEN 2 THEN '' END AS mudlib,
  CASE c_custkey % 3 WHEN 0 THEN 'LPMud' WHEN 1 THEN 'n/a' END AS mud_type FROM customer"""
_TARGETS = "SELECT concat('h', CAST(s_suppkey % 70 AS STRING)) AS host, CAST(4000 + s_suppkey % 4 AS INT) AS port, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 25 END AS game_id FROM supplier"
_BOUND = "SELECT concat('M', CAST(n_nationkey * 6 AS STRING)) AS name, n_nationkey AS game_id FROM nation WHERE n_nationkey % 5 = 0"


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda text, name: spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=C.table(spark, d, name))
    return read(_ENTRIES, "customer"), read(_TARGETS, "supplier"), read(_BOUND, "nation")


_CYCLE = f"""WITH e AS ({_ENTRIES}), t AS (SELECT host, port, min(game_id) AS game_id FROM ({_TARGETS}) x GROUP BY host, port), b AS ({_BOUND}),
j AS (SELECT e.*, trim(e.host) <> '' AND coalesce(e.port, 0) > 0 AS sound, t.host IS NOT NULL AS known, t.game_id, b.game_id AS old FROM e LEFT JOIN t ON t.host = e.host AND t.port = e.port LEFT JOIN b ON b.name = e.name),
k AS (SELECT *, sound AND game_id IS NOT NULL AND old IS NULL AND game_id NOT IN (SELECT game_id FROM b) AS free FROM j),
n AS (SELECT *, free AND row_number() OVER (PARTITION BY game_id, free ORDER BY place, name) = 1 AS won FROM k),
cycle AS (SELECT name, host, port, CASE WHEN NOT sound THEN 'unlistable' WHEN NOT known THEN 'seeded' WHEN game_id IS NULL THEN 'unlisted' WHEN old IS NOT NULL THEN 'kept' WHEN won THEN 'bound' ELSE 'refused' END AS verdict,
  game_id, coalesce(old, CASE WHEN won THEN game_id END) AS bound_to FROM n)"""


@query(_CYCLE + " SELECT * FROM cycle")
def gateway_bindings(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each entry of the gateway's list, and which listing it is."""
    return G.cycle(*_tables(spark, d))


@query(f"""WITH e AS ({_ENTRIES}), p AS (SELECT name, CASE WHEN driver <> 'Unknown' THEN trim(driver) END AS d, CASE WHEN mudlib <> '' THEN mudlib END AS l, CASE WHEN mud_type <> 'n/a' THEN mud_type END AS t FROM e)
SELECT name, 'CODEBASE' AS field, d AS value FROM p WHERE d IS NOT NULL UNION ALL SELECT name, 'MUDLIB', l FROM p WHERE l IS NOT NULL AND (d IS NULL OR lower(d) <> lower(l)) UNION ALL SELECT name, 'FAMILY', t FROM p WHERE t IS NOT NULL""")
def gateway_facts(spark: SparkSession, d: str) -> DataFrame:
    return G.observations(_tables(spark, d)[0])


@query(_CYCLE + """, r AS (SELECT name, bound_to, CAST(substr(name, 2) AS BIGINT) AS k FROM cycle WHERE bound_to IS NOT NULL)
SELECT CASE WHEN k % 3 = 0 THEN 'i3_no_reply' ELSE 'counted' END AS outcome, count(*) AS readings, CAST(sum(CASE WHEN k % 3 <> 0 THEN k % 4 END) AS BIGINT) AS people FROM r GROUP BY 1""")
def gateway_summary(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the bound entries: what replied was counted, also as none."""
    entries, targets, bound = _tables(spark, d)
    asked = G.cycle(entries, targets, bound).where("bound_to IS NOT NULL").select("name", F.col("bound_to").alias("game_id"))
    k = F.substring("name", 2, 20).cast("long")
    replies = asked.select("name", (k % 3 != 0).alias("replied"), F.when(k % 4 > 0, F.array_repeat(F.lit("someone"), (k % 4).cast("int"))).alias("users")).where("replied OR name = 'M0'")
    return G.summary(G.readings(asked, replies))
