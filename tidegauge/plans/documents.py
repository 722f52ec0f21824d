"""Queries that assemble nested documents and dump them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import availability as A
from tidegauge.operators import documents as D
from tidegauge.operators import identity
from tidegauge.plans.registry import query
from tidegauge.session import shared_folder
from tidegauge.sources import catalogue as C

NOW, SINCE = C.NOW, "timestamp_ntz'2024-01-10 00:00:00'"
_DOCUMENT = C.sql("presence", "observation", "interval", "game", "field", "edge") + """,
told AS (SELECT * FROM game_field WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY game_id, field ORDER BY source_rank, last_confirmed_at DESC, tie) = 1),
declared AS (SELECT game_id, list({'field': lower(field), 'value': value, 'source': source} ORDER BY lower(field), value, source) AS l FROM told GROUP BY game_id),
side AS (SELECT *, source IN ('handshake', 'who', 'i3', 'banner') AS m FROM game_field),
best AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY game_id, field, m ORDER BY source_rank, last_confirmed_at DESC, tie) = 1),
both_sides AS (SELECT game_id, field, bool_or(value = 'true') FILTER (WHERE m) AS measured, bool_or(value = 'true') FILTER (WHERE NOT m) AS declared FROM best GROUP BY game_id, field),
capability AS (SELECT game_id, list({'field': field, 'measured': measured, 'declared': declared, 'disagrees': coalesce(measured <> declared, false)} ORDER BY field) AS l,
  count(*) FILTER (WHERE measured <> declared) AS n FROM both_sides GROUP BY game_id),
seen AS (SELECT *, lag(value) OVER (PARTITION BY game_id, field, source ORDER BY last_confirmed_at, tie) AS old_value FROM game_field),
late AS (SELECT * FROM seen WHERE old_value IS NOT NULL AND trim(regexp_replace(old_value, '\\s+', ' ', 'g')) <> trim(regexp_replace(value, '\\s+', ' ', 'g'))
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY last_confirmed_at DESC, tie DESC) <= 3),
change AS (SELECT game_id, list({'at': strftime(last_confirmed_at, '%Y-%m-%d %H:%M:%S'), 'field': field, 'sentence': 'changed from ' || old_value || ' to ' || value} ORDER BY last_confirmed_at DESC, tie DESC) AS l
  FROM late GROUP BY game_id),
stretch AS (SELECT game_id, strftime(from_at, '%Y-%m-%d %H:%M:%S') AS f, strftime(to_at, '%Y-%m-%d %H:%M:%S') AS t, state, cause FROM availability),
stretches AS (SELECT game_id, list({'from': f, 'to': t, 'state': state, 'cause': cause} ORDER BY f, t NULLS FIRST, state, cause) AS l FROM stretch GROUP BY game_id),
part AS (SELECT *, epoch_us(least(coalesce(to_at, TIMESTAMP '2024-01-31'), TIMESTAMP '2024-01-31')) - epoch_us(greatest(from_at, TIMESTAMP '2024-01-10')) AS len FROM availability),
reach AS (SELECT game_id, {'reachable_us': CAST(sum(CASE WHEN state = 'reachable' THEN len ELSE 0 END) AS BIGINT), 'observed_us': CAST(sum(len) AS BIGINT),
  'outage_us': max(len) FILTER (WHERE state = 'unreachable')} AS s FROM part WHERE len > 0 GROUP BY game_id),
cell AS (SELECT game_id, CAST(extract(dow FROM sampled_at) AS INT) AS dow, CAST(extract(hour FROM sampled_at) AS INT) AS hod, count(*) AS samples, count(cnt) AS counted, CAST(sum(cnt) AS BIGINT) AS total
  FROM presence WHERE sampled_at >= TIMESTAMP '2024-01-10' GROUP BY ALL),
activity AS (SELECT game_id, list({'dow': dow, 'hod': hod, 'samples': samples, 'counted': counted, 'total': total} ORDER BY dow, hod) AS l FROM cell GROUP BY game_id),
way AS (SELECT from_id AS node, 'lists' AS direction, to_id AS other FROM referral_edge UNION SELECT to_id, 'listed_by', from_id FROM referral_edge),
referral AS (SELECT node AS game_id, list({'direction': direction, 'slug': slug} ORDER BY direction, slug) AS l FROM way JOIN game ON game.id = other GROUP BY node),
document AS (
  SELECT g.id AS game_id, {'id': g.id, 'slug': g.slug, 'name': g.name, 'state': g.state, 'archived': g.state = 'archived', 'claimed': g.is_claimed, 'reachability': reach.s, 'disagreements': coalesce(capability.n, 0),
    'declared': coalesce(declared.l, []), 'capabilities': coalesce(capability.l, []), 'presence': {'shape': 'dayOfWeekHour', 'zone': 'UTC', 'cells': coalesce(activity.l, [])},
    'availability': coalesce(stretches.l, []), 'changes': coalesce(change.l, []), 'referrals': coalesce(referral.l, [])} AS d
  FROM public_game g LEFT JOIN reach ON reach.game_id = g.id LEFT JOIN capability ON capability.game_id = g.id LEFT JOIN declared ON declared.game_id = g.id LEFT JOIN activity ON activity.game_id = g.id
  LEFT JOIN stretches ON stretches.game_id = g.id LEFT JOIN change ON change.game_id = g.id LEFT JOIN referral ON referral.game_id = g.id)"""


@query(_DOCUMENT + " SELECT game_id, CAST(to_json(d) AS VARCHAR) AS document FROM document")
def game_document(spark: SparkSession, d: str) -> DataFrame:
    """Every public listing with its facts, capabilities, availability, activity, changes and referrals, as JSON."""
    spans = A.intervals(C.observations(spark, d))
    children = D.game_children(C.fields(spark, d), spans, C.presence(spark, d), identity.neighbours(C.referral_edges(spark, d), C.games(spark, d)), SINCE, NOW)
    return D.game_documents(C.public(C.games(spark, d), C.merges(spark, d)), children)


@query(_DOCUMENT + """ SELECT game_id AS id, d.slug AS slug, len(d.declared) AS declared, len(d.availability) AS spells, len(d.presence.cells) AS cells, len(d.referrals) AS referrals,
d.reachability.reachable_us AS reachable_us FROM document""")
def game_dump(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as lines of JSON, and what a reader of the dump finds in it."""
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    D.dump(game_document(spark, d), path)
    schema = """id long, slug string, reachability struct<reachable_us: long>, declared array<struct<field: string>>, availability array<struct<state: string>>,
                presence struct<cells: array<struct<dow: int>>>, referrals array<struct<slug: string>>"""
    size = lambda c: F.size(c).cast("long")
    return spark.read.schema(schema).json(path).select("id", "slug", size("declared").alias("declared"), size("availability").alias("spells"), size("presence.cells").alias("cells"), size("referrals").alias("referrals"), "reachability.reachable_us")
