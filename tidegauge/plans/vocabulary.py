"""Queries that match texts with vocabularies. What the twins expect is known from how each text is put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import vocabulary as V
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

_BASES = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'PennMUSH 1.8.8p2' WHEN 1 THEN 'penn-based TinyMUSH/MUX hybrid' WHEN 2 THEN 'Circle' WHEN 3 THEN 'heavily modified ROM24' WHEN 4 THEN 'ROM/LPMud mix'
  WHEN 5 THEN 'Dead Souls 3.9' WHEN 6 THEN 'smaug-fuss SMAUG' WHEN 7 THEN 'Evennia 1.3' WHEN 8 THEN 'galaxy engine' WHEN 9 THEN '' WHEN 10 THEN 'LambdaMOO v1.8' ELSE NULL END AS codebase,
CASE p_partkey % 7 WHEN 0 THEN 'PennMUSH' WHEN 1 THEN ' Corvid ' WHEN 2 THEN 'your mud name' WHEN 3 THEN 'Circle' WHEN 4 THEN 'localhost' WHEN 5 THEN p_name END AS name FROM part"""


@query(f"""WITH b AS ({_BASES}) SELECT id, CASE id % 12 WHEN 0 THEN 'MUSH' WHEN 1 THEN 'MUSH' WHEN 3 THEN 'DikuMUD' WHEN 5 THEN 'LPMud' WHEN 6 THEN 'DikuMUD' WHEN 8 THEN 'DikuMUD' WHEN 10 THEN 'MOO' END AS lineage,
CASE WHEN id % 7 = 1 THEN 'Corvid' WHEN id % 7 = 5 THEN trim(name) WHEN id % 7 = 3 AND id % 12 <> 2 THEN 'Circle' END AS name FROM b""")
def codebase_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Lineages of code bases, and names that are a listing's own."""
    rows = spark.sql(_BASES.replace("FROM part", "FROM {part}"), part=C.table(spark, d, "part"))
    return rows.select("id", V.lineage(F.col("codebase")).alias("lineage"), V.meaningful_name(F.col("name"), F.col("codebase")).alias("name"))


_SCREENS = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN concat('Welcome! This game is powered by Evennia', CAST(event_id % 4 AS STRING), '. Enjoy.') WHEN 1 THEN 'Our tavern is the MudOS inn. Copyright 1999 by us.'
  WHEN 2 THEN 'Based on CircleMUD by Jeremy Elson, a derivative of DikuMUD.' WHEN 3 THEN 'Original code by Hans Henrik Staerfeldt and others' WHEN 4 THEN 'Running Circle MUD 3.1. Code by smaugling and friends.'
  WHEN 5 THEN concat('Derived', chr(10), 'from   the LPmud') WHEN 6 THEN 'Hosted with love; the Mudlib is ours' WHEN 7 THEN 'Thanks to Thoric!' WHEN 8 THEN '(c) the tinymuckers; running DGD' END AS screen FROM events"""


@query(f"""WITH s AS ({_SCREENS}) SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'Evennia' WHEN 2 THEN 'CircleMUD' WHEN 3 THEN 'DikuMUD' WHEN 4 THEN 'CircleMUD' WHEN 5 THEN 'LPMud' WHEN 7 THEN 'SMAUG' WHEN 8 THEN 'DGD' END AS family
FROM s WHERE event_id % 10 NOT IN (1, 6, 9)""")
def codebase_credits(spark: SparkSession, d: str) -> DataFrame:
    """Engines that screens credit, sentence by sentence."""
    rows = spark.sql(_SCREENS.replace("FROM events", "FROM {events}"), events=C.table(spark, d, "events"))
    return V.credits(rows, "event_id", "screen")
