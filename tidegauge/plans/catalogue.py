"""Queries over listings, facts, search, identity, writes and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import ecosystem, fields, identity, policy, search, writes
from tidegauge.plans.registry import query
from tidegauge.sources import catalogue as C

NOW = C.NOW
_WIN = """, winner AS (SELECT * FROM game_field QUALIFY row_number() OVER (PARTITION BY game_id, field ORDER BY source_rank, last_confirmed_at DESC, tie) = 1)"""
_SIDES = """, side AS (SELECT *, CASE WHEN source IN ('handshake', 'who', 'i3', 'banner') THEN 'measured' ELSE 'declared' END AS side FROM game_field),
best AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY game_id, field, side ORDER BY source_rank, last_confirmed_at DESC, tie) = 1)"""


@query(C.sql("game") + " SELECT id, slug, state FROM public_game")
def public_games(spark: SparkSession, d: str) -> DataFrame:
    return C.public(C.games(spark, d), C.merges(spark, d)).select("id", "slug", "state")


@query(C.sql("game") + " SELECT id, slug, state FROM listed_game")
def listed_games(spark: SparkSession, d: str) -> DataFrame:
    return C.listed(C.public(C.games(spark, d), C.merges(spark, d))).select("id", "slug", "state")


@query(C.sql("field") + _WIN + " SELECT * FROM winner")
def field_winner(spark: SparkSession, d: str) -> DataFrame:
    return fields.winners(C.fields(spark, d), "game_id", "field")


@query(C.sql("field") + _WIN + ", f AS (SELECT * FROM winner WHERE value <> '') SELECT game_id, string_agg(lower(field) || '=' || value, ',' ORDER BY lower(field)) AS declared, count(*) AS n FROM f GROUP BY game_id")
def declared_map(spark: SparkSession, d: str) -> DataFrame:
    out = fields.declared_map(C.fields(spark, d))
    pairs = F.transform(F.map_entries("declared"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("game_id", F.array_join(F.array_sort(pairs), ",").alias("declared"), F.size("declared").cast("long").alias("n"))


@query(C.sql("field") + _WIN + """ SELECT game_id, field, value, source, source IN ('handshake', 'who', 'i3', 'banner') AS measured,
CAST(greatest(0, epoch(TIMESTAMP '2001-09-01') - epoch(last_confirmed_at)) AS BIGINT) AS age_seconds,
greatest(0, epoch(TIMESTAMP '2001-09-01') - epoch(last_confirmed_at)) > CAST(86400 AS BIGINT) * CASE field WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 365 ELSE 100000 END AS stale FROM winner""")
def stale_fields(spark: SparkSession, d: str) -> DataFrame:
    best = fields.winners(C.fields(spark, d), "game_id", "field")
    return fields.provenance(best, "timestamp_ntz'2001-09-01 00:00:00'", {"1-URGENT": 30, "2-HIGH": 365})


_LEDGER = """, seen AS (SELECT *, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS folded FROM game_field),
ledger AS (SELECT game_id, field, source, tie, lag(value) OVER w AS old_value, value AS new_value, last_confirmed_at AS changed_at,
  CASE WHEN lag(folded) OVER w IS NULL THEN 'added' WHEN lag(folded) OVER w = folded THEN 'confirmed' ELSE 'changed' END AS verdict
  FROM seen WINDOW w AS (PARTITION BY game_id, field, source ORDER BY last_confirmed_at, tie))"""


@query(C.sql("field") + _LEDGER + " SELECT * FROM ledger")
def field_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return fields.reconcile(C.fields(spark, d))


@query(C.sql("field", "game") + _LEDGER + """, few AS (
  SELECT slug, field, source, old_value, new_value, changed_at, tie FROM ledger JOIN listed_game g ON g.id = game_id
  WHERE verdict = 'changed' AND changed_at >= TIMESTAMP '1998-01-01' AND field <> '5-LOW'
  QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY changed_at DESC, tie DESC) <= 3)
SELECT *, 'changed from ' || old_value || ' to ' || new_value AS sentence FROM few ORDER BY changed_at DESC, tie DESC LIMIT 20""")
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    shown = C.listed(C.public(C.games(spark, d), C.merges(spark, d)))
    return fields.recent_changes(fields.reconcile(C.fields(spark, d)), shown, "timestamp_ntz'1998-01-01 00:00:00'", internal=("5-LOW",))


@query(C.sql("field") + _SIDES + """ SELECT game_id, field, bool_or(value = 'true') FILTER (WHERE side = 'measured') AS measured,
bool_or(value = 'true') FILTER (WHERE side = 'declared') AS declared, max(last_confirmed_at) AS confirmed_at,
coalesce(bool_or(value = 'true') FILTER (WHERE side = 'measured') <> bool_or(value = 'true') FILTER (WHERE side = 'declared'), false) AS disagrees
FROM best GROUP BY game_id, field""")
def capability_matrix(spark: SparkSession, d: str) -> DataFrame:
    return fields.capability_matrix(C.fields(spark, d))


_ADOPTION = _SIDES + """, adoption AS (SELECT field,
  CASE WHEN count(*) FILTER (WHERE side = 'measured') > 0 THEN count(*) FILTER (WHERE side = 'measured' AND value = 'true') END AS offered,
  CASE WHEN count(*) FILTER (WHERE side = 'measured') > 0 THEN count(*) FILTER (WHERE side = 'measured' AND value <> 'true') END AS declined,
  count(*) FILTER (WHERE side = 'declared' AND value = 'true') AS declared FROM best GROUP BY field)"""


@query(C.sql("field") + _ADOPTION + " SELECT * FROM adoption")
def protocol_adoption(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.protocol_adoption(C.fields(spark, d))


@query(C.sql("field") + _ADOPTION + " SELECT DATE '2024-01-31' AS on_date, 'protocol' AS metric, field AS key, offered, declined, declared FROM adoption")
def ecosystem_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.snapshot(protocol_adoption(spark, d), "2024-01-31")


@query(C.sql("field", "game") + """ SELECT (SELECT count(*) FROM listed_game) AS listed,
count(DISTINCT game_id) FILTER (WHERE source = 'handshake') AS handshakes, count(DISTINCT game_id) FILTER (WHERE source = 'mssp') AS mssp_reports,
min(last_confirmed_at) FILTER (WHERE source = 'handshake') AS oldest_handshake FROM game_field WHERE game_id IN (SELECT id FROM listed_game)""")
def ecosystem_totals(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.totals(C.listed(C.public(C.games(spark, d), C.merges(spark, d))), C.fields(spark, d))


_SPELT = """, spelt AS (SELECT lower(x) AS folded, x AS spelling, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL),
common AS (SELECT folded, min_by(spelling, (-n, spelling)) AS spelling, CAST(sum(n) AS BIGINT) AS n FROM spelt GROUP BY folded)"""


@query("WITH v AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_type END AS x FROM part)" + _SPELT + " SELECT * FROM common")
def commonest_spelling(spark: SparkSession, d: str) -> DataFrame:
    spelt = C.table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_type END AS x")
    return search.commonest(spelt, "x")


@query(C.sql("facet") + ", v AS (SELECT codebase AS x FROM facet_row)" + _SPELT + " SELECT spelling, n, round(n / (SELECT sum(n) FROM common), 6) AS share, n = 1 AS sole FROM common")
def codebase_usage(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.usage(C.facet_rows(spark, d), "codebase").withColumn("share", F.round("share", 6))


@query(C.sql("facet") + " SELECT id, name, band FROM facet_row WHERE contains(lower(name), '1') OR contains(lower(coalesce(codebase, '')), '1')")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return search.search(C.facet_rows(spark, d), {}, " 1 ").select("id", "name", "band")


@query(C.sql("facet") + " SELECT id, name, codebase FROM facet_row WHERE lower(codebase) = 'brand#3'")
def search_choice(spark: SparkSession, d: str) -> DataFrame:
    return search.search(C.facet_rows(spark, d), {"codebase": search.Choice.parse("BRAND#3")}).select("id", "name", "codebase")


@query(C.sql("facet") + " SELECT id, name, codebase FROM facet_row WHERE codebase IS NULL OR lower(codebase) <> 'brand#3'")
def search_exclude(spark: SparkSession, d: str) -> DataFrame:
    return search.search(C.facet_rows(spark, d), {"codebase": search.Choice.parse("!Brand#3")}).select("id", "name", "codebase")


@query(C.sql("facet") + " SELECT id, name, band FROM facet_row WHERE codebase IS NULL AND band = 'quiet'")
def search_unknown(spark: SparkSession, d: str) -> DataFrame:
    return search.search(C.facet_rows(spark, d), {"codebase": search.Choice.parse("~unknown"), "band": search.Choice("quiet")}).select("id", "name", "band")


@query("""SELECT l_partkey AS id FROM (SELECT DISTINCT l_partkey, lower(concat(l_returnflag, l_linestatus)) AS p FROM lineitem) WHERE p IN ('af', 'no', 'rf')
GROUP BY l_partkey HAVING count(*) = 3""")
def search_protocols(spark: SparkSession, d: str) -> DataFrame:
    offered = C.protocols(spark, d).groupBy("id").agg(F.collect_set("protocol").alias("protocols"))
    return offered.where(search.offers_all(F.col("protocols"), ["AF", "no", "RF"])).select("id")


_FACETS = {"codebase": search.Choice("Brand#3", exclude=True), "band": search.Choice("quiet")}
_ONE = """, t AS (SELECT *, coalesce(lower(codebase) <> 'brand#3', true) AS ok_codebase, coalesce(lower(band) = 'quiet', false) AS ok_band FROM facet_row),
counts AS (
  SELECT 'codebase' AS facet, codebase AS value, count(*) FILTER (WHERE ok_band) AS n FROM t WHERE ok_band OR ok_codebase GROUP BY codebase
  UNION ALL SELECT 'band', band, count(*) FILTER (WHERE ok_codebase) FROM t WHERE ok_band OR ok_codebase GROUP BY band
  UNION ALL SELECT 'family', family, count(*) FILTER (WHERE ok_codebase AND ok_band) FROM t WHERE ok_band OR ok_codebase GROUP BY family)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return search.facet_counts(C.facet_rows(spark, d), ["codebase", "band", "family"], _FACETS)


@query(C.sql("facet") + _ONE + " SELECT * FROM counts")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


_THREE = {"codebase": search.Choice("Brand#3"), "band": search.Choice("dark"), "family": search.Choice("promo")}


@query(C.sql("facet") + """, t AS (SELECT coalesce(lower(codebase) = 'brand#3', false) AS a, coalesce(lower(band) = 'dark', false) AS b, coalesce(lower(family) = 'promo', false) AS c FROM facet_row),
m AS (SELECT count(*) FILTER (WHERE a AND b AND c) AS matching, count(*) FILTER (WHERE b AND c) AS codebase, count(*) FILTER (WHERE a AND c) AS band, count(*) FILTER (WHERE a AND b) AS family FROM t),
u AS (UNPIVOT m ON codebase, band, family INTO NAME facet VALUE without)
SELECT facet, matching, without FROM u WHERE matching < 1000 AND without > matching ORDER BY without DESC, facet LIMIT 1""")
def loosen_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """The selection whose removal would give most results."""
    return search.loosened(C.facet_rows(spark, d), _THREE, 1000)


@query(C.sql("facet") + _ONE + """, top AS (SELECT * FROM counts WHERE facet = 'family' AND n > 0 AND value IS NOT NULL ORDER BY n DESC, value LIMIT 20)
SELECT facet, value, n, false AS selected FROM top UNION ALL SELECT facet, value, n, false FROM counts WHERE facet = 'family' AND n > 0 AND value IS NULL""")
def facet_counts_open(spark: SparkSession, d: str) -> DataFrame:
    return search.open_vocabulary(_counts(spark, d), "family")


@query(C.sql("facet") + _ONE + """ SELECT CAST(place AS INT) AS place, v.value, coalesce(n, 0) AS n
FROM (VALUES (0, 'playersNow'), (1, 'activeThisWeek'), (2, 'quiet'), (3, 'dark'), (4, 'archived')) AS v(place, value)
LEFT JOIN counts c ON c.facet = 'band' AND c.value = v.value WHERE v.value IN (SELECT band FROM facet_row)""")
def facet_counts_bounded(spark: SparkSession, d: str) -> DataFrame:
    return search.bounded_vocabulary(_counts(spark, d), C.facet_rows(spark, d), "band", ["playersNow", "activeThisWeek", "quiet", "dark", "archived"])


@query(C.sql("facet") + """ SELECT lower(concat(l_returnflag, l_linestatus)) AS value, count(DISTINCT l_partkey) AS n FROM lineitem
WHERE l_partkey IN (SELECT id FROM facet_row WHERE band = 'quiet') GROUP BY 1""")
def facet_counts_presence(spark: SparkSession, d: str) -> DataFrame:
    return search.presence_counts(C.facet_rows(spark, d).where("band = 'quiet'"), C.protocols(spark, d))


_SORT = """ SELECT id, name, metric, CAST(row_number() OVER (ORDER BY metric IS NULL, metric DESC, lower(name), id) AS INT) AS place FROM m
ORDER BY metric IS NULL, metric DESC, lower(name), id LIMIT {} OFFSET {}"""


@query(C.sql("facet") + ", m AS (SELECT id, name, players AS metric FROM facet_row)" + _SORT.format(100, 0))
def sort_players(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(C.facet_rows(spark, d), F.col("players"), F.lit(True), *search.page_bounds(None, None)).select("id", "name", "metric", "place")


@query(C.sql("facet") + ", m AS (SELECT id, name, CASE WHEN samples >= 24 THEN median END AS metric FROM facet_row)" + _SORT.format(100, 0))
def sort_median_week(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(C.facet_rows(spark, d), F.col("median"), F.col("samples") >= 24, *search.page_bounds(None, None)).select("id", "name", "metric", "place")


@query(C.sql("facet") + ", m AS (SELECT id, name, players AS metric FROM facet_row)" + _SORT.format(50, 150))
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(C.facet_rows(spark, d), F.col("players"), F.lit(True), *search.page_bounds(50, 150)).select("id", "name", "metric", "place")


_NEXT = """, step AS (SELECT *, CASE WHEN failures <= 0 THEN CASE WHEN busy THEN 7200 ELSE 21600 END WHEN failures = 1 THEN 600
  ELSE least(21600 * pow(2, least(greatest(failures - 2, 0), 20)), 604800) END AS base FROM target)"""


@query(C.sql("target") + _NEXT + " SELECT id, CAST(greatest(CAST(base AS BIGINT), CASE WHEN delay_hours IS NOT NULL THEN CAST(least(delay_hours, 2160) * 3600 AS BIGINT) END) AS BIGINT) AS seconds FROM step")
def next_probe(spark: SparkSession, d: str) -> DataFrame:
    return C.due_targets(spark, d).select("id", policy.next_interval(F.col("failures"), F.col("busy"), F.col("delay_hours")).alias("seconds"))


@query(C.sql("target") + " SELECT id, next_probe_at FROM target WHERE next_probe_at <= TIMESTAMP '1996-01-01' ORDER BY next_probe_at, id LIMIT 200")
def due_targets(spark: SparkSession, d: str) -> DataFrame:
    return policy.due(C.due_targets(spark, d), "timestamp_ntz'1996-01-01 00:00:00'").select("id", "next_probe_at")


@query(C.sql("target") + """ SELECT id, next_probe_at FROM target WHERE busy AND (delay_hours IS NULL OR next_probe_at < TIMESTAMP '1997-01-01')
ORDER BY delay_hours NULLS FIRST, next_probe_at, id LIMIT 50""")
def askable(spark: SparkSession, d: str) -> DataFrame:
    rows = C.due_targets(spark, d).where("busy AND (delay_hours IS NULL OR next_probe_at < timestamp_ntz'1997-01-01 00:00:00')")
    return rows.orderBy(F.col("delay_hours").asc_nulls_first(), "next_probe_at", "id").limit(50).select("id", "next_probe_at")


@query(C.sql("edge") + """, walk(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT CAST(to_id AS BIGINT) FROM walk JOIN referral_edge ON from_id = node)
SELECT node FROM walk""")
def referral_reach(spark: SparkSession, d: str) -> DataFrame:
    return identity.reachable_from(C.referral_edges(spark, d), 0).select("node")


@query(C.sql("edge", "game") + """, both_ways AS (SELECT from_id AS node, 'lists' AS direction, to_id AS other FROM referral_edge
  UNION SELECT to_id, 'listed_by', from_id FROM referral_edge) SELECT node, direction, other, slug FROM both_ways JOIN game ON id = other""")
def referral_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return identity.neighbours(C.referral_edges(spark, d), C.games(spark, d))


@query(C.sql("edge", "game") + """, proposed AS (SELECT from_id, to_id, from_id * 100 + to_id AS tie, from_id % 6 AS depth, to_id % 9 <> 0 AS routable FROM (SELECT DISTINCT * FROM referral_edge)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY tie) AS nth FROM proposed)
SELECT from_id, to_id, tie, CASE WHEN from_id = to_id THEN 'self' WHEN NOT routable THEN 'not_routable' WHEN nth > 1 THEN 'fan_out' WHEN depth > 4 THEN 'too_deep'
  WHEN to_id IN (SELECT id FROM listed_game) THEN 'known' ELSE 'added' END AS verdict FROM numbered""")
def referral_verdicts(spark: SparkSession, d: str) -> DataFrame:
    edges = C.referral_edges(spark, d).distinct().selectExpr("from_id", "to_id", "from_id * 100 + to_id AS tie", "from_id % 6 AS depth", "to_id % 9 <> 0 AS routable")
    return identity.referral_verdicts(edges, C.listed(C.public(C.games(spark, d), C.merges(spark, d))), fan_out=1)


@query(C.sql("game") + """ SELECT a.slug AS from_slug, b.slug AS to_slug FROM merge_log m JOIN game a ON a.id = from_game_id JOIN game b ON b.id = into_game_id
WHERE into_game_id NOT IN (SELECT from_game_id FROM merge_log)""")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    return identity.redirects(C.merges(spark, d), C.games(spark, d))


_REQUESTS = "SELECT o_custkey AS from_id, o_orderkey % 1600 AS into_id FROM orders"


@query(C.sql("game") + f""", request AS ({_REQUESTS})
SELECT from_id, into_id, CASE WHEN from_id = into_id THEN 'self' WHEN from_id NOT IN (SELECT id FROM game) OR into_id NOT IN (SELECT id FROM game) THEN 'unknown'
  WHEN from_id IN (SELECT from_game_id FROM merge_log) THEN 'already_absorbed'
  WHEN into_id IN (SELECT from_game_id FROM merge_log) OR from_id IN (SELECT into_game_id FROM merge_log) THEN 'chain' ELSE 'merged' END AS verdict FROM request""")
def merge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    requests = C.table(spark, d, "orders").selectExpr("o_custkey AS from_id", "o_orderkey % 1600 AS into_id")
    return identity.merge_verdicts(requests, C.games(spark, d), C.merges(spark, d))


_PROBES = """probe AS (SELECT s_suppkey AS probe_id, s_nationkey AS nation, CAST(floor(s_acctbal / 50) AS BIGINT) AS balance, s_suppkey % 97 AS bucket FROM supplier),
known AS (SELECT c_custkey AS game_id, c_nationkey AS nation, CAST(floor(c_acctbal / 50) AS BIGINT) AS balance, c_custkey % 97 AS bucket FROM customer)"""
_SCORED = f"""WITH {_PROBES}, scored AS (
  SELECT probe_id, game_id, round(CASE WHEN p.nation = k.nation THEN 0.3 ELSE 0 END + CASE WHEN p.balance = k.balance THEN 0.5 ELSE 0 END + CASE WHEN p.bucket = k.bucket THEN 0.25 ELSE 0 END, 6) AS score
  FROM probe p, known k WHERE p.balance = k.balance OR p.bucket = k.bucket)"""


_KEYS, _WEIGHTS = ["balance", "bucket"], {"nation": 0.3, "balance": 0.5, "bucket": 0.25}


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    probes = C.table(spark, d, "supplier").selectExpr("s_suppkey AS probe_id", "s_nationkey AS nation", "CAST(floor(s_acctbal / 50) AS BIGINT) AS balance", "s_suppkey % 97 AS bucket")
    known = C.table(spark, d, "customer").selectExpr("c_custkey AS game_id", "c_nationkey AS nation", "CAST(floor(c_acctbal / 50) AS BIGINT) AS balance", "c_custkey % 97 AS bucket")
    return probes, known


@query(_SCORED + " SELECT probe_id, game_id, CAST(score AS DOUBLE) AS score FROM scored")
def identity_scores(spark: SparkSession, d: str) -> DataFrame:
    return identity.blocked_scores(*_sides(spark, d), _KEYS, _WEIGHTS)


@query(_SCORED + """, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, game_id) = 1)
SELECT probe_id, game_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 1.0 THEN 'merge' WHEN score >= 0.4 THEN 'review' ELSE 'fresh' END AS verdict FROM best""")
def identity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return identity.verdicts(*_sides(spark, d), _KEYS, _WEIGHTS)


@query("""WITH old AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
new AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.event_type = n.event_type)""")
def upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = C.table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"]
    empty = rows.limit(0)
    old = writes.first_wins(empty, rows.where("event_id % 4 = 0"), keys, "event_id")
    return writes.first_wins(old, rows.where("event_id % 4 <> 0"), keys, "event_id").select("user_id", "event_type", "event_id", "value")


@query(C.sql("field") + " SELECT game_id, field, source, min(last_confirmed_at) AS first_at, max(last_confirmed_at) AS last_at, max_by(value, (last_confirmed_at, tie)) AS value FROM game_field GROUP BY ALL")
def upsert_greatest(spark: SparkSession, d: str) -> DataFrame:
    return writes.greatest_last(C.fields(spark, d), ["game_id", "field", "source"], "value", "last_confirmed_at", "last_confirmed_at", "tie")


@query(C.sql("edge") + " SELECT from_id, to_id, to_id % 3 = 0 AND from_id % 2 = 0 AS present FROM referral_edge")
def tombstone_absent(spark: SparkSession, d: str) -> DataFrame:
    edges = C.referral_edges(spark, d)
    return writes.tombstoned(edges, edges.where("to_id % 3 = 0 AND from_id % 2 = 0"), ["from_id", "to_id"]).select("from_id", "to_id", "present")


@query(C.sql("presence") + ", r AS (SELECT game_id, date_trunc('day', sampled_at) AS bucket, count(*) AS n FROM presence GROUP BY ALL) SELECT game_id, bucket, n FROM r")
def rollup_rerun(spark: SparkSession, d: str) -> DataFrame:
    """A range rolled up again in the place of what was there."""
    rolled = C.presence(spark, d).groupBy("game_id", F.date_trunc("day", "sampled_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    stale = rolled.withColumn("n", F.when(F.col("bucket") >= F.expr("timestamp_ntz'2024-01-10'"), F.lit(0)).otherwise(F.col("n")))
    return writes.replace_range(stale, rolled, "timestamp_ntz'2024-01-10'", "timestamp_ntz'2024-02-01'")


@query("""SELECT event_id, count(*) OVER w AS trailing, count(*) OVER w > 5 AS refused FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return policy.over_rate(C.table(spark, d, "events"), "user_id", "ts", 5, 86_400).select("event_id", "trailing", "refused")


_VOCABULARY = [("1-URGENT", True, "boolean"), ("2-HIGH", True, "boolean"), ("3-MEDIUM", False, "boolean"), ("9-NEW", False, "text")]


@query(C.sql("field") + _WIN + """, v(field, required, kind) AS (VALUES ('1-URGENT', true, 'boolean'), ('2-HIGH', true, 'boolean'), ('3-MEDIUM', false, 'boolean'), ('9-NEW', false, 'text')),
every AS (SELECT * FROM (SELECT DISTINCT game_id FROM game_field), v),
judged AS (SELECT coalesce(e.game_id, w.game_id) AS game_id, CASE WHEN e.field IS NULL THEN 'non_standard' WHEN w.value IS NULL AND required THEN 'missing' WHEN w.value IS NULL THEN 'not_carried' ELSE 'answered' END AS f
  FROM every e FULL JOIN winner w ON w.game_id = e.game_id AND w.field = e.field)
SELECT game_id, count(*) FILTER (WHERE f = 'missing') AS missing, CAST(0 AS BIGINT) AS unanswered, CAST(0 AS BIGINT) AS wrong_type, count(*) FILTER (WHERE f = 'non_standard') AS non_standard,
  count(*) FILTER (WHERE f = 'answered') AS answered, count(*) FILTER (WHERE f = 'missing') = 0 AS meets_standard FROM judged GROUP BY game_id""")
def lint_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return fields.lint(C.fields(spark, d), spark.createDataFrame(_VOCABULARY, "field string, required boolean, kind string"))


@query(C.sql("target") + " SELECT min(next_probe_at) AS next_due, max(next_probe_at) AS last_due, count(*) FILTER (WHERE next_probe_at <= TIMESTAMP '1997-01-01') AS due_now, count(*) AS known FROM target")
def crawl_pulse(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.pulse(C.due_targets(spark, d), "timestamp_ntz'1997-01-01 00:00:00'")


@query("""SELECT 'games' AS relation, count(*) AS n FROM customer UNION ALL SELECT 'fields', count(*) FROM orders UNION ALL SELECT 'samples', count(*) FROM events""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.catalogue_totals(games=C.games(spark, d), fields=C.fields(spark, d), samples=C.presence(spark, d))


@query(C.sql("presence", "field", "game") + """, page AS (SELECT * FROM game ORDER BY slug LIMIT 50 OFFSET 10)
SELECT slug, state, (SELECT count(*) FROM game_field f WHERE f.game_id = page.id) AS n_fields, (SELECT count(*) FROM presence p WHERE p.game_id = page.id) AS n_samples,
  (SELECT max_by(cnt, sampled_at) FROM presence p WHERE p.game_id = page.id AND cnt IS NOT NULL) AS latest FROM page""")
def summary_page(spark: SparkSession, d: str) -> DataFrame:
    return ecosystem.summary_page(C.games(spark, d), C.fields(spark, d), C.presence(spark, d), 10, 50)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
