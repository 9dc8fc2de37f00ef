"""Queries over catalogues, federation, ledgers and stored tables."""

from pyspark.sql import functions as F

from awardlake.checks.base import NOW, joined, query, r6
from awardlake.checks.plan_checks import VERDICTS_CTE, request_quotes
from awardlake.checks.verify_checks import VERIFIED_AWARDS_SQL, verified_awards
from awardlake.operators import ledger, ranking
from awardlake.sources import catalogue, sinks

KEYED_FARES = """(SELECT 'A' || cast(o_custkey AS varchar(20)) || '-B' || cast(o_orderkey AS varchar(20)) || '-economy' AS key,
  cast(floor(o_totalprice) AS bigint) AS cents FROM @orders)"""


@query("read_fares", f"""
SELECT key AS route_key, split_part(key, '-', 1) AS origin, split_part(key, '-', 2) AS dest, split_part(key, '-', 3) AS cabin,
       cents AS cash_cents, 'cached fares' AS source_name, 0.6E0 AS trust, 'cached_fare' AS flags FROM {KEYED_FARES} k
UNION ALL
SELECT key, split_part(key, '-', 1), split_part(key, '-', 2), split_part(key, '-', 3), cents, 'curated fallback fares', 0.3E0, 'hardcoded_fallback' FROM {KEYED_FARES} k
""")
def _fares(d):
    raw = d.sql(f"SELECT * FROM {KEYED_FARES} k")
    both = catalogue.read_fares(raw, "cached").unionByName(catalogue.read_fares(raw, "floor"))
    return both.withColumn("flags", joined(F.col("flags"))).drop("confidence")


@query("build_dimensions", """
SELECT 'airport' AS dim, code AS k, region AS v, round(lat, 3) AS lat, round(lon, 3) AS lon FROM @@airports a WHERE region IS NOT NULL OR lat IS NOT NULL
UNION ALL SELECT 'zone', program || ':' || code, cast(zone AS varchar), NULL, NULL FROM @@zones z
""")
def _dims(d):
    places = d.view("airports")
    near = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    regions = places.where("region IS NOT NULL").select(F.create_map(F.lower("code"), "region").alias("region_map"))
    coords = places.select(F.create_map("code", F.array(near("lat"), near("lon"))).alias("coords"))
    zones = d.view("zones").select(
        F.create_map(F.upper("program"), F.create_map(F.lower("code"), F.col("zone").cast("string"))).alias("program_zones")
    )
    spec = regions.unionByName(coords, allowMissingColumns=True).unionByName(zones, allowMissingColumns=True)
    airport, zone = catalogue.build_dimensions(spec)
    return airport.select(
        F.lit("airport").alias("dim"), F.col("code").alias("k"), F.col("region").alias("v"),
        F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"),
    ).unionByName(
        zone.select(
            F.lit("zone").alias("dim"), F.concat("program", F.lit(":"), "code").alias("k"), F.col("zone").cast("string").alias("v"),
            F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        )
    )


@query("validate_targets_catalog", """
SELECT name, format, provides, CASE WHEN lower(trim(role)) IN ('primary', 'fallback') THEN lower(trim(role)) ELSE 'primary' END AS role,
       lower(trim(program)) AS program, upper(hub) AS hub, trust
FROM @@targets t WHERE format <> 'docx' AND provides <> 'seat'
""")
def _targets(d):
    out = catalogue.validate_targets_catalog(d.view("targets"))
    return out.select("name", "format", "provides", "role", "program", "hub", "trust")


CREATORS = """(SELECT 'creator ' || cast(s_suppkey AS varchar(20)) AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://c' || cast(s_suppkey AS varchar(20)) || '.example/feed' WHEN s_suppkey % 3 = 1 THEN '' END AS blog_rss,
  CASE s_suppkey % 4 WHEN 0 THEN 'TODO' WHEN 1 THEN 'UC' || cast(s_suppkey AS varchar(20)) WHEN 2 THEN 'HC9' END AS channel_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 0.25E0 WHEN s_suppkey % 5 = 1 THEN 0.8E0 END AS trust FROM @supplier)"""


@query("creators_catalog", f"""
SELECT name, nullif(blog_rss, '') AS blog_rss, nullif(channel_id, 'TODO') AS channel_id, coalesce(trust, 0.45) AS trust,
       coalesce(blog_rss, '') <> '' AS has_blog, coalesce(channel_id LIKE 'UC%', false) AS has_youtube FROM {CREATORS} c
""")
def _creators(d):
    return catalogue.creators_catalog(d.sql(f"SELECT * FROM {CREATORS} c"))


DISCOVERY_ROW = """concat('{"program":" P', cast(p_partkey % 3 AS varchar(20)), ' ","region_a":"reg', cast(p_partkey % 5 AS varchar(20)),
  '",', CASE WHEN p_size % 10 = 0 THEN '' ELSE '"region_b":"Reg1",' END, '"cabin":"Business","miles":', CASE WHEN p_size % 7 = 0 THEN '"many"' ELSE cast(p_size * 1000 AS varchar(20)) END,
  ',"roundtrip":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN p_size % 3 = 0 THEN ',"source_name":"blog:x","trust":0.2' ELSE '' END, '}')"""


@query("read_discovered_rows", """
SELECT 'p' || cast(p_partkey % 3 AS varchar) AS program, 'reg' || cast(p_partkey % 5 AS varchar) AS region_a, 'reg1' AS region_b, 'business' AS cabin,
       cast(p_size * 1000 AS bigint) AS miles, p_size % 2 = 0 AS roundtrip, CASE WHEN p_size % 3 = 0 THEN 'blog:x' ELSE 'discovery' END AS source_name,
       CASE WHEN p_size % 3 = 0 THEN 0.2E0 ELSE 0.3E0 END AS trust FROM @part WHERE p_size % 10 <> 0 AND p_size % 7 <> 0
""")
def _discovered(d):
    docs = d.sql(
        f"""SELECT concat('{{"updated_at":"x","stale_programs":[" P1 "],"rows":[', {DISCOVERY_ROW}, ']}}') AS doc FROM @part"""
    )
    return catalogue.read_discovered_rows(docs)[0].drop("source_url", "updated_at")


@query("read_stale_programs", """
SELECT DISTINCT 'p' || cast(p_partkey % 3 AS varchar) AS program FROM @part WHERE p_size = 7
""")
def _stale(d):
    docs = d.sql(
        """SELECT concat('{"stale_programs":[', CASE WHEN p_size = 7 THEN concat('" P', cast(p_partkey % 3 AS varchar(20)), ' ",') ELSE '' END, '""],"rows":[]}') AS doc FROM @part"""
    )
    return catalogue.read_discovered_rows(docs)[1]


@query("offers_to_fares", """
SELECT 'C' || cast(o_custkey % 300 AS varchar) || '-X-economy' AS route_key, cast(round_even(min(o_totalprice) * 100, 0) AS bigint) AS cash_cents, 0.9E0 AS trust
FROM @orders WHERE o_orderkey % 3 <> 0 GROUP BY 1
""")
def _offers(d):
    offers = d.table("orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 300).cast("string")).alias("origin"), F.lit("x").alias("dest"),
        F.lit("economy").alias("cabin"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("grand_total"),
    )
    return catalogue.offers_to_fares(offers).select("route_key", "cash_cents", "trust")


def providers(d):
    return d.view("providers").select(
        "name", "trust", "monthly_quota", F.split("layers", ",").alias("layers"),
        F.map_filter(F.create_map(F.lit("award"), "award_trust"), lambda k, v: v.isNotNull()).alias("layer_trust"),
        "health", "disabled", "reg_ord",
    )


LEDGER_SQL = """
led AS (SELECT provider, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM @@fetch_events e WHERE NOT cache_hit AND NOT skipped GROUP BY ALL)
"""


@query("quota_ledger", f"""
WITH {LEDGER_SQL}
SELECT provider, month, used, cast(monthly_quota AS bigint) AS monthly_quota,
       CASE WHEN monthly_quota IS NOT NULL THEN cast(greatest(0, monthly_quota - used) AS bigint) END AS remaining,
       monthly_quota IS NOT NULL AND greatest(0, monthly_quota - used) < monthly_quota * 0.2 AS low
FROM led LEFT JOIN @@providers p ON p.name = provider
""")
def _ledger(d):
    return ledger.quota_ledger(d.view("fetch_events"), providers(d))


@query("federation_stats", """
SELECT provider, layer, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE NOT cache_hit AND NOT skipped) AS cache_misses,
       count(*) FILTER (WHERE skip_reason = 'quota') AS quota_skips, 0 AS rate_skips, 0 AS lock_skips,
       count(*) FILTER (WHERE skip_reason = 'error') AS errors, cast(sum(quotes) AS bigint) AS quotes
FROM @@fetch_events e GROUP BY ALL
""")
def _stats(d):
    return ledger.federation_stats(d.view("fetch_events"))


RANKING_SQL = """
rk AS (SELECT l.layer, p.name, CASE WHEN l.layer = 'award' THEN coalesce(award_trust, trust) ELSE trust END AS effective_trust, health, monthly_quota, reg_ord
       FROM @@providers p, unnest(string_split(layers, ',')) AS l(layer) WHERE NOT disabled AND health <> 'down'),
rank AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY effective_trust DESC, reg_ord) AS position FROM rk)
"""


@query("provider_ranking", f"""
WITH {LEDGER_SQL}, {RANKING_SQL}
SELECT layer, position, name, effective_trust, health, monthly_quota, coalesce(used, 0) AS used,
       CASE WHEN monthly_quota IS NOT NULL THEN cast(greatest(0, monthly_quota - coalesce(used, 0)) AS bigint) END AS remaining
FROM rank LEFT JOIN led ON led.provider = rank.name
""")
def _ranking(d):
    used = ledger.quota_ledger(d.view("fetch_events"), providers(d)).select("provider", "used")
    return ranking.provider_ranking(providers(d), used)


QUOTE_POOL = """(SELECT o_custkey AS request_id, 'prov' || cast(o_orderkey % 8 AS varchar(20)) AS provider, o_orderkey AS quote FROM @orders)"""


@query("federate_fallback", f"""
WITH {RANKING_SQL}
SELECT request_id, provider, quote FROM {QUOTE_POOL} q JOIN rank ON rank.name = q.provider AND rank.layer = 'fares'
QUALIFY dense_rank() OVER (PARTITION BY request_id ORDER BY position) = 1
""")
def _fallback(d):
    pool = d.sql(f"SELECT * FROM {QUOTE_POOL} q")
    return ranking.federate_fallback(pool, ranking.provider_ranking(providers(d)), "fares")


@query("federate_pool", f"""
WITH {RANKING_SQL}
SELECT request_id, provider, quote FROM {QUOTE_POOL} q WHERE provider IN (SELECT name FROM rank WHERE layer = 'award')
""")
def _pool(d):
    pool = d.sql(f"SELECT * FROM {QUOTE_POOL} q")
    return ranking.federate_pool(pool, ranking.provider_ranking(providers(d)), "award")


@query("source_group_health", """
SELECT user_id AS provider, CASE WHEN NOT bool_or(event_type <> 'error') THEN 'down'
  WHEN bool_and(event_type <> 'error') THEN 'healthy' ELSE 'degraded' END AS health
FROM @events GROUP BY ALL
""")
def _group_health(d):
    rows = d.table("events").select(F.col("user_id").alias("provider"), (F.col("event_type") != "error").alias("healthy"))
    return ranking.source_group_health(rows)


@query("write_discovered", """
SELECT program, source_name, cabin, miles, '1999-12-31' AS updated FROM @@chart_rows c
UNION ALL SELECT DISTINCT program, 'stale', NULL, NULL, NULL FROM @@chart_rows c WHERE roundtrip
""")
def _write_discovered(d):
    rows = d.view("chart_rows").select("program", "source_name", "cabin", "miles")
    path = sinks.new_table_path(d.spark, "discovered")
    sinks.write_discovered(rows, d.view("chart_rows").where("roundtrip").select("program"), path, "1999-12-31")
    back, stale = sinks.read_discovered(d.spark, path)
    at = d.spark.read.parquet(f"{path}/current").first()["updated_at"]
    none = lambda t: F.lit(None).cast(t)
    return back.withColumn("updated", F.lit(at)).unionByName(
        stale.select("program", F.lit("stale").alias("source_name"), none("string").alias("cabin"), none("bigint").alias("miles"), none("string").alias("updated"))
    )


@query("append_history", f"""
WITH {VERDICTS_CTE}
SELECT 'run' AS kind, route_key || '/' || q.request_id AS k, coalesce(v.label, 'no_fare') AS v, '1999-12-30' AS day FROM @@requests q LEFT JOIN verdicts v ON v.request_id = q.request_id
UNION ALL SELECT 'edge', route_key || '/' || program, cast(miles AS varchar), d FROM va CROSS JOIN (VALUES ('1999-12-30'), ('1999-12-31')) t(d)
UNION ALL SELECT 'run', route_key || '/' || q.request_id, coalesce(v.label, 'no_fare'), '1999-12-31' FROM @@requests q LEFT JOIN verdicts v ON v.request_id = q.request_id
""")
def _history(d):
    path = sinks.new_table_path(d.spark, "history")
    awards = sinks.materialize(verified_awards(d), "awards")
    verdicts = sinks.materialize(request_quotes(d, awards).verdicts, "verdicts")
    for day in ("1999-12-30", "1999-12-31"):
        sinks.append_history(verdicts, awards, path, f"{day} 10:00:00")
    runs, edges = d.spark.read.parquet(f"{path}/runs"), d.spark.read.parquet(f"{path}/edges")
    return runs.select(
        F.lit("run").alias("kind"), F.concat("route_key", F.lit("/"), "request_id").alias("k"), F.col("label").alias("v"),
        F.col("day").cast("string").alias("day"),
    ).unionByName(
        edges.select(
            F.lit("edge").alias("kind"), F.concat("route_key", F.lit("/"), "program").alias("k"), F.col("miles").cast("string").alias("v"),
            F.col("day").cast("string").alias("day"),
        )
    )


@query("upsert_latest", """
SELECT user_id, event_id, event_type FROM @events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")
def _upsert(d):
    rows = d.table("events").select("user_id", "event_id", "event_type")
    return sinks.upsert_latest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("increment_counters", "SELECT user_id, cast(sum(1 + event_id % 3) AS bigint) AS used FROM @events GROUP BY ALL")
def _increment(d):
    rows = d.table("events").select("user_id", "event_id", (F.lit(1) + F.col("event_id") % 3).alias("used"))
    base = rows.where("event_id < 5000").groupBy("user_id").agg(F.sum("used").alias("used"))
    return sinks.increment_counters(base, rows.where("event_id >= 5000"), ["user_id"], "used")


@query("delete_keys", """
SELECT c_custkey FROM @customer WHERE c_custkey NOT IN (SELECT o_custkey FROM @orders WHERE o_orderstatus = 'F')
""")
def _delete(d):
    gone = d.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.delete_keys(d.table("customer").select("c_custkey"), gone, ["c_custkey"])


@query("snapshot_latest_and_history", """
SELECT 'latest' AS kind, event_id, NULL AS day FROM @events QUALIFY row_number() OVER (ORDER BY ts DESC) = 1
UNION ALL
SELECT 'day', event_id, strftime(ts, '%Y-%m-%d') FROM @events WHERE ts >= timestamp '2024-01-13' AND ts < timestamp '2024-01-21'
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC) = 1
""")
def _snapshots(d):
    rows = d.table("events").select(F.col("ts").cast("timestamp").alias("completed_at"), "event_id")
    latest, history = sinks.snapshot_latest_and_history(rows, "2024-01-20", 8)
    return latest.select(F.lit("latest").alias("kind"), "event_id", F.lit(None).cast("string").alias("day")).unionByName(
        history.select(F.lit("day").alias("kind"), "event_id", F.col("day").cast("string").alias("day"))
    )


@query("recent_by_key", """
SELECT user_id, event_id FROM @events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50
""")
def _recent(d):
    return sinks.recent_by_key(d.table("events").select("user_id", "event_id", "ts"), "user_id", "ts", 50, ["event_id"]).drop("ts")
