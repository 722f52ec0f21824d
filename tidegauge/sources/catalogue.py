"""The catalogue's relations, as views over the star-schema tables.

A real deployment reads them from Parquet of the same columns; here ``events`` stand in for
samples and probes, ``customer`` for listings, ``orders`` for sourced facts, ``part`` for facet
rows and ``nation`` for referrals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "timestamp_ntz'2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def presence(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Samples: ``cnt`` is null where players could not be counted; a missing row is unmeasured."""
    return table(spark, sf_dir, "events").selectExpr(
        ("user_id % 10" if dense else "user_id") + " AS game_id",
        "ts AS sampled_at",
        "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt",
        "event_type AS source",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe outcomes, in order of ``(observed_at, event_id)``."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS game_id",
        "ts AS observed_at",
        "event_id",
        "CASE WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'view' THEN 'degraded' ELSE 'reachable' END AS state",
        "CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' THEN 'handshake_stalled' ELSE 'none' END AS cause",
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "lower(replace(c_name, '#', '-')) AS slug",
        "c_name AS name",
        """CASE WHEN c_custkey % 13 = 0 THEN 'excluded' WHEN c_custkey % 17 = 0 THEN 'unlisted'
                WHEN c_mktsegment = 'AUTOMOBILE' THEN 'archived' WHEN c_mktsegment = 'FURNITURE' THEN 'quiet'
                WHEN c_mktsegment = 'HOUSEHOLD' THEN 'dark' ELSE 'active' END AS state""",
        "c_acctbal > 5000 AS is_claimed",
        "c_custkey % 7 = 0 AS is_submitted",
        "c_custkey % 14 = 0 AS is_corroborated",
        f"{NOW} - make_dt_interval(CAST(c_custkey % 60 AS INT)) AS first_seen_at",
    )


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 11 = 0 AND c_custkey > 0").selectExpr("c_custkey AS from_game_id", "c_custkey - 1 AS into_game_id")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sourced facts; ``source_rank`` 0 would be the strongest source."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS game_id",
        "o_orderpriority AS field",
        "CASE o_orderstatus WHEN 'F' THEN 'handshake' WHEN 'O' THEN 'mssp' ELSE 'banner' END AS source",
        "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 8 END AS source_rank",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END AS value",
        "o_orderdate AS last_confirmed_at",
        "o_orderkey AS tie",
    )


def facet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS codebase",
        "p_type AS family",
        """CASE WHEN p_size > 40 THEN 'playersNow' WHEN p_size > 25 THEN 'activeThisWeek' WHEN p_size > 10 THEN 'quiet'
                ELSE 'dark' END AS band""",
        "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS players",
        "CAST(p_retailprice AS INT) % 100 AS samples",
        "CAST(p_retailprice AS INT) % 37 AS median",
    )


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols that a facet row was seen to offer."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", "concat(l_returnflag, l_linestatus) AS protocol").distinct()


def referral_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    one = n.selectExpr("n_nationkey AS from_id", "(n_nationkey * 3 + 1) % 25 AS to_id")
    return one.unionAll(n.selectExpr("n_nationkey AS from_id", "(n_nationkey * 2) % 25 AS to_id"))


def due_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS game_id", "o_orderdate AS next_probe_at", "CAST(o_orderkey % 8 AS INT) AS failures",
        "o_orderpriority = '1-URGENT' AS busy", "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 400 AS DOUBLE) END AS delay_hours",
    )


def public(games: DataFrame, merges: DataFrame) -> DataFrame:
    """Listings anyone may see: not a stranger's unconfirmed proposal, and not merged into another."""
    shown = games.where("NOT is_submitted OR is_claimed OR is_corroborated")
    return shown.join(merges.select(F.col("from_game_id").alias("id")).distinct(), "id", "left_anti")


def listed(games: DataFrame) -> DataFrame:
    return games.where("state NOT IN ('archived', 'excluded', 'unlisted')")


#: The same relations for DuckDB, to put behind WITH.
SQL = {
    "presence": """presence AS (
  SELECT user_id AS game_id, ts AS sampled_at,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt, event_type AS source FROM events)""",
    "dense": """presence AS (
  SELECT user_id % 10 AS game_id, ts AS sampled_at,
         CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INT) END AS cnt, event_type AS source FROM events)""",
    "observation": """observation AS (
  SELECT user_id AS game_id, ts AS observed_at, event_id,
         CASE WHEN event_type = 'error' THEN 'unreachable' WHEN event_type = 'view' THEN 'degraded' ELSE 'reachable' END AS state,
         CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' THEN 'handshake_stalled' ELSE 'none' END AS cause
  FROM events)""",
    "interval": """changed AS (
  SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS opens FROM observation
  WINDOW w AS (PARTITION BY game_id ORDER BY observed_at, event_id)),
island AS (SELECT *, sum(opens) OVER (PARTITION BY game_id ORDER BY observed_at, event_id) AS nth FROM changed),
span AS (SELECT game_id, nth, min(state) AS state, min(cause) AS cause, min(observed_at) AS from_at FROM island GROUP BY game_id, nth),
availability AS (
  SELECT game_id, state, cause, from_at, lead(from_at) OVER (PARTITION BY game_id ORDER BY nth) AS to_at FROM span)""",
    "game": """game AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS slug, c_name AS name,
         CASE WHEN c_custkey % 13 = 0 THEN 'excluded' WHEN c_custkey % 17 = 0 THEN 'unlisted'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'archived' WHEN c_mktsegment = 'FURNITURE' THEN 'quiet'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'dark' ELSE 'active' END AS state,
         c_acctbal > 5000 AS is_claimed, c_custkey % 7 = 0 AS is_submitted, c_custkey % 14 = 0 AS is_corroborated,
         TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 60 AS INT)) AS first_seen_at FROM customer),
merge_log AS (SELECT c_custkey AS from_game_id, c_custkey - 1 AS into_game_id FROM customer WHERE c_custkey % 11 = 0 AND c_custkey > 0),
public_game AS (
  SELECT * FROM game g WHERE (NOT is_submitted OR is_claimed OR is_corroborated)
     AND NOT EXISTS (SELECT 1 FROM merge_log m WHERE m.from_game_id = g.id)),
listed_game AS (SELECT * FROM public_game WHERE state NOT IN ('archived', 'excluded', 'unlisted'))""",
    "field": """game_field AS (
  SELECT o_custkey AS game_id, o_orderpriority AS field,
         CASE o_orderstatus WHEN 'F' THEN 'handshake' WHEN 'O' THEN 'mssp' ELSE 'banner' END AS source,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 8 END AS source_rank,
         CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END AS value,
         o_orderdate AS last_confirmed_at, o_orderkey AS tie FROM orders)""",
    "facet": """facet_row AS (
  SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS codebase, p_type AS family,
         CASE WHEN p_size > 40 THEN 'playersNow' WHEN p_size > 25 THEN 'activeThisWeek' WHEN p_size > 10 THEN 'quiet' ELSE 'dark' END AS band,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS players,
         CAST(trunc(p_retailprice) AS INT) % 100 AS samples, CAST(trunc(p_retailprice) AS INT) % 37 AS median FROM part)""",
    "edge": """referral_edge AS (
  SELECT n_nationkey AS from_id, (n_nationkey * 3 + 1) % 25 AS to_id FROM nation
  UNION ALL SELECT n_nationkey AS from_id, (n_nationkey * 2) % 25 AS to_id FROM nation)""",
    "target": """target AS (
  SELECT o_orderkey AS id, o_custkey AS game_id, o_orderdate AS next_probe_at, CAST(o_orderkey % 8 AS INT) AS failures,
         o_orderpriority = '1-URGENT' AS busy, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 400 AS DOUBLE) END AS delay_hours FROM orders)""",
}


def sql(*names: str) -> str:
    """WITH and the named relations, a recursive one allowed."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
