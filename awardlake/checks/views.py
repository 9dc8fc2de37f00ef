"""Views that bind the operators to the driver tables."""

from awardlake.checks.base import view

CABIN = "CASE {k} % 4 WHEN 0 THEN 'economy' WHEN 1 THEN 'premium_economy' WHEN 2 THEN 'business' ELSE 'first' END"
CURRENCY = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AFRICA' WHEN 'BUILDING' THEN 'AMERICA' "
    "WHEN 'FURNITURE' THEN 'ASIA' WHEN 'HOUSEHOLD' THEN 'EUROPE' ELSE 'MIDDLE EAST' END"
)

#: Codes of airports, one per supplier, and any number folded onto them or onto the parts that have award prices.
AIRPORT = "'A' || lpad(cast({k} AS varchar(20)), 9, '0')"
ANY_AIRPORT = AIRPORT.format(k="({k}) % (SELECT count(*) FROM @supplier)")
ANY_PART = "'R' || cast(({k}) % (SELECT count(*) FROM @part) AS varchar(20))"

# Trust values are sixteenths, so sums of them are exact in any order.
view("award_quotes", f"""
SELECT 'R' || cast(l_partkey AS varchar(20)) AS route_key,
       'p' || cast(l_suppkey % 5 AS varchar(20)) AS program,
       {CABIN.format(k='l_partkey')} AS cabin,
       cast(floor(l_extendedprice) AS bigint) AS miles,
       CASE WHEN l_linestatus = 'O' AND l_partkey % 3 = 0
            THEN cast(floor(l_quantity) AS bigint) END AS seats,
       CASE WHEN l_linenumber = 7 THEN 'unknown'
            ELSE 's' || cast(l_linenumber % 4 AS varchar(20)) END AS source_name,
       (4 + floor(l_discount * 100 + 0.5)) / 16.0E0 AS trust,
       (4 + floor(l_discount * 100 + 0.5)) / 16.0E0 AS confidence,
       cast(l_shipdate AS timestamp) AS source_updated_at,
       timestamp '1999-06-01 00:00:00' AS fetched_at,
       (l_linestatus = 'O' AND l_partkey % 3 = 0) AS is_live,
       (l_suppkey % 7 = 0) AS is_rt,
       l_orderkey * 10 + l_linenumber AS ord
FROM @lineitem
""")

view("fare_quotes", f"""
SELECT {ANY_PART.format(k='o_orderkey')} AS route_key,
       cast(floor(o_totalprice * 100 + 0.5) AS bigint) AS cash_cents,
       'f' || substring(o_orderpriority, 1, 1) AS source_name,
       (2 + o_orderkey % 8) / 10.0E0 AS confidence,
       cast(o_orderdate AS timestamp) AS source_updated_at,
       timestamp '1999-06-01 00:00:00' AS fetched_at,
       (o_orderkey % 5 = 0) AS is_cached,
       o_orderkey AS ord
FROM @orders
""")

view("requests", f"""
SELECT c_custkey AS request_id,
       {ANY_PART.format(k='c_custkey')} AS route_key,
       {CURRENCY} AS currency,
       greatest(0, cast(floor(c_acctbal * 400) AS bigint)) AS balance,
       CASE c_custkey % 3 WHEN 0 THEN 'venture' WHEN 1 THEN 'venture_x' ELSE 'other' END AS card
FROM @customer
""")

# One row per currency and partner programme, with time-boxed bonuses and absences.
view("partners", """
SELECT r.r_name AS from_currency,
       'p' || cast(cast(floor(n.n_nationkey / 5) AS int) AS varchar(20)) AS partner,
       0.5E0 + 0.25E0 * (n.n_nationkey % 4) AS ratio,
       CASE WHEN n.n_nationkey % 3 = 0 THEN 1.25E0 WHEN n.n_nationkey % 3 = 1 THEN 1.0E0 END AS bonus,
       CASE WHEN n.n_nationkey % 2 = 0 THEN '1999-11-01' END AS valid_from,
       CASE WHEN n.n_nationkey % 4 = 0 THEN '1999-12-01'
            WHEN n.n_nationkey % 4 = 2 THEN '2000-02-01' END AS valid_until,
       CASE WHEN n.n_nationkey % 6 = 0 THEN 'winter offer' END AS label,
       0.9E0 AS trust,
       cast(n.n_nationkey AS bigint) AS ord
FROM @nation n JOIN @region r ON n.n_regionkey = r.r_regionkey
""")

# The flattened rows of "partners" on 2000-01-01, for operators that start from ratios.
view("ratios", """
SELECT from_currency, partner AS to_program, ratio, 1.0E0 AS bonus_multiplier,
       ratio AS effective_ratio, cast(NULL AS varchar(40)) AS bonus_label,
       trust AS confidence, 2 * ord AS ord, false AS is_bonus
FROM @@partners a
UNION ALL
SELECT from_currency, partner, ratio, bonus, ratio * bonus,
       coalesce(label, '+25% transfer bonus'), trust, 2 * ord + 1, true
FROM @@partners b
WHERE bonus IS NOT NULL AND bonus <> 1.0E0
  AND coalesce(valid_from, '0000') <= '2000-01-01' AND coalesce(valid_until, '9999') >= '2000-01-01'
""")

view("program_ratios", """
SELECT 'p' || cast(n_nationkey AS varchar(20)) AS from_currency,
       'p' || cast(n_nationkey + 1 AS varchar(20)) AS to_program,
       0.8E0 AS ratio, 1.0E0 AS bonus_multiplier, 0.8E0 AS effective_ratio,
       cast(NULL AS varchar(40)) AS bonus_label, 0.8E0 AS confidence,
       cast(1000 + n_nationkey AS bigint) AS ord, false AS is_bonus
FROM @nation
""")

view("airports", f"""
SELECT {AIRPORT.format(k='s_suppkey')} AS code,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'reg' || cast(s_suppkey % 5 AS varchar(20)) END AS region,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE (s_suppkey * 37) % 140 - 70.0E0 END AS lat,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE (s_suppkey * 53) % 340 - 170.0E0 END AS lon
FROM @supplier
""")

view("zones", f"""
SELECT 'p0' AS program, {AIRPORT.format(k='s_suppkey')} AS code, cast(s_suppkey % 4 AS int) AS zone
FROM @supplier WHERE s_suppkey % 3 <> 2
UNION ALL
SELECT 'p1', {AIRPORT.format(k='s_suppkey')}, cast((s_suppkey + 1) % 4 AS int)
FROM @supplier WHERE s_suppkey % 3 <> 2
""")

view("routes", f"""
SELECT DISTINCT origin || '-' || dest || '-' || cabin AS route_key, origin, dest, cabin
FROM (SELECT {ANY_AIRPORT.format(k='o_custkey')} AS origin,
             {ANY_AIRPORT.format(k='o_orderkey')} AS dest,
             {CABIN.format(k='o_orderkey')} AS cabin
      FROM @orders) o
WHERE origin <> dest
""")

# Chart rows of three shapes: airport pairs, zone/region pairs, distance-banded pairs.
view("chart_rows", f"""
SELECT 'p' || cast(p_partkey % 3 AS varchar(20)) AS program,
       'src' || cast(p_partkey % 4 AS varchar(20)) AS source_name,
       CASE WHEN p_size % 5 = 0 THEN NULL
            WHEN p_partkey % 3 < 2 AND p_size % 2 = 0
            THEN 'p' || cast(p_partkey % 3 AS varchar(20)) || '_zone_' || cast(p_partkey % 4 AS varchar(20))
            ELSE 'reg' || cast(p_partkey % 5 AS varchar(20)) END AS region_a,
       CASE WHEN p_size % 5 = 0 THEN NULL
            WHEN p_partkey % 3 < 2 AND p_size % 2 = 0
            THEN 'p' || cast(p_partkey % 3 AS varchar(20)) || '_zone_' || cast(p_size % 4 AS varchar(20))
            ELSE 'reg' || cast(p_size % 4 AS varchar(20)) END AS region_b,
       CASE WHEN p_size % 5 = 0 THEN {ANY_AIRPORT.format(k='p_partkey')} END AS origin_airport,
       CASE WHEN p_size % 5 = 0 THEN {ANY_AIRPORT.format(k='p_partkey * 7 + 1')} END AS dest_airport,
       {CABIN.format(k='p_size')} AS cabin,
       cast(floor(p_retailprice * 20) AS bigint) + p_size * 100 AS miles,
       (p_size % 6 = 1) AS roundtrip,
       CASE WHEN p_size % 5 <> 0 AND p_size % 7 = 3 THEN cast((p_size % 3) * 3000 AS bigint) END AS distance_min,
       CASE WHEN p_size % 5 <> 0 AND p_size % 7 = 3 THEN cast((p_size % 3) * 3000 + 2900 AS bigint) END AS distance_max,
       CASE WHEN p_partkey % 2 = 0 THEN '1999-10-05' END AS updated_at,
       p_partkey AS band_ord
FROM @part
""")

view("award_rows", f"""
SELECT 'p' || cast(l_suppkey % 5 AS varchar(20)) AS program,
       'live' || cast(l_linenumber % 3 AS varchar(20)) AS source_name,
       {ANY_AIRPORT.format(k='l_partkey')} AS origin,
       {ANY_AIRPORT.format(k='l_orderkey')} AS dest,
       {CABIN.format(k='l_orderkey')} AS cabin,
       cast(floor(l_extendedprice) AS bigint) AS miles,
       CASE WHEN l_linenumber % 2 = 0 THEN cast(floor(l_quantity) AS bigint) END AS seats,
       (l_suppkey % 7 = 0) AS roundtrip,
       CASE WHEN l_linenumber = 5 THEN 'soon' ELSE substring(cast(l_shipdate AS varchar(40)), 1, 10) END AS updated_at,
       ((l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000) * 1000000 + cast(floor(l_extendedprice) AS bigint) AS ord
FROM @lineitem
""")

view("targets", """
SELECT 'src' || cast(s_suppkey AS varchar(20)) AS name,
       'https://site' || cast(s_suppkey AS varchar(20)) || '.example/chart' AS url,
       CASE s_suppkey % 9 WHEN 0 THEN 'html_table' WHEN 1 THEN 'html_table_wide'
            WHEN 2 THEN 'html_table_destination' WHEN 3 THEN 'html_table_zone_matrix'
            WHEN 4 THEN 'html_table_seasonal_zones' WHEN 5 THEN 'json' WHEN 6 THEN 'rss'
            WHEN 7 THEN 'pdf' ELSE 'docx' END AS format,
       CASE s_suppkey % 5 WHEN 3 THEN 'award' WHEN 4 THEN 'seat' ELSE 'chart' END AS provides,
       CASE s_suppkey % 4 WHEN 0 THEN ' Fallback ' WHEN 1 THEN 'mirror' WHEN 2 THEN 'primary' END AS role,
       CASE WHEN s_suppkey % 6 <> 5 THEN ' P' || cast(s_suppkey % 3 AS varchar(20)) || ' ' END AS program,
       CASE WHEN s_suppkey % 2 = 0 THEN 'ist' END AS hub,
       (10 - s_suppkey % 10) / 10.0E0 AS trust,
       CASE WHEN s_suppkey % 3 = 0 THEN '1999-09-01' END AS updated_at,
       s_suppkey AS ord
FROM @supplier
""")

view("fetch_events", """
SELECT 'prov' || cast(user_id % 27 AS varchar(20)) AS provider,
       CASE user_id % 4 WHEN 0 THEN 'fares' WHEN 1 THEN 'award' WHEN 2 THEN 'charts' ELSE 'schedules' END AS layer,
       (event_type = 'view') AS cache_hit,
       (event_type = 'error' OR event_type = 'signup') AS skipped,
       CASE WHEN event_type = 'error' THEN 'error'
            WHEN event_type = 'signup' THEN 'quota' END AS skip_reason,
       cast(floor(value) AS bigint) % 5 AS quotes,
       cast(ts AS timestamp) AS ts, event_id
FROM @events
""")

view("providers", """
SELECT 'prov' || cast(n_nationkey AS varchar(20)) AS name,
       (1 + (n_nationkey * 7) % 5) / 5.0E0 AS trust,
       CASE n_nationkey % 5 WHEN 0 THEN 400 WHEN 1 THEN 50 WHEN 2 THEN 100000 END AS monthly_quota,
       CASE n_nationkey % 3 WHEN 0 THEN 'fares,award' WHEN 1 THEN 'charts,award,fares' ELSE 'schedules,fares' END AS layers,
       CASE WHEN n_nationkey % 4 = 1 THEN 0.95E0 END AS award_trust,
       CASE WHEN n_nationkey = 4 THEN 'down' WHEN n_nationkey = 3 THEN 'degraded' ELSE 'healthy' END AS health,
       (n_nationkey = 5) AS disabled, n_nationkey AS reg_ord
FROM @nation
""")

view("probe_log", """
SELECT 't' || cast(user_id % 40 AS varchar(20)) AS name, ts AS checked_at, event_id AS seq,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 404
            WHEN event_type = 'error' THEN 0 WHEN event_id % 29 = 0 THEN 410 ELSE 200 END AS status,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(floor(value) AS bigint) % 3 END AS parsed_rows
FROM @events
""")

view("responses", """
SELECT 'd' || cast(user_id AS varchar(20)) AS domain, event_id AS seq, cast(ts AS timestamp) AS ts,
       CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 0 END ELSE 200 END AS status
FROM @events
""")
