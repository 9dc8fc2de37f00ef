"""Queries over the verification operators."""

from pyspark.sql import functions as F

from awardlake.checks.base import NOW, NOW_SQL, joined, query, r6
from awardlake.operators import verify

HALF, STALE = 600.0, 900.0


def quote_flags(df):
    """Flag arrays of the quote view."""
    return df.withColumn(
        "flags",
        F.concat(
            F.when(F.col("is_live"), F.array(F.lit("live_award_space")))
            .otherwise(F.array(F.lit("no_live_space"))),
            F.when(F.col("is_rt"), F.array(F.lit("rt_to_ow_normalized")))
            .otherwise(F.array().cast("array<string>")),
        ),
    ).drop("is_live", "is_rt")


def award_quotes(d):
    return quote_flags(d.view("award_quotes"))


def fare_quotes(d):
    return d.view("fare_quotes").withColumn(
        "flags",
        F.when(F.col("is_cached"), F.array(F.lit("cached_fare")))
        .otherwise(F.array().cast("array<string>")),
    )


def verified_awards(d):
    return verify.verify_awards(award_quotes(d), NOW, HALF, STALE)


def verified_fares(d):
    return verify.verify_fares(fare_quotes(d), NOW, HALF, STALE)


USABLE = f"""
SELECT *, greatest(0, (epoch_us({NOW_SQL}) - epoch_us(source_updated_at)) / 86400e6) AS age,
       greatest(0, least(1, confidence * pow(0.5, greatest(0, (epoch_us({NOW_SQL}) - epoch_us(source_updated_at)) / 86400e6) / {HALF}))) AS dec
FROM @@award_quotes q
WHERE source_name <> 'unknown'
  AND CASE cabin WHEN 'economy' THEN miles BETWEEN 3000 AND 200000
                 WHEN 'premium_economy' THEN miles BETWEEN 5000 AND 250000
                 WHEN 'business' THEN miles BETWEEN 10000 AND 400000
                 ELSE miles BETWEEN 15000 AND 700000 END
"""

VERIFIED_AWARDS_SQL = f"""
WITH u AS ({USABLE}),
kept AS (SELECT * FROM (SELECT *, bool_or(is_live) OVER (PARTITION BY route_key, program) AS any_live FROM u)
         WHERE is_live = any_live),
run AS (SELECT *, sum(trust) OVER w AS cum, sum(trust) OVER (PARTITION BY route_key, program) AS tot,
               row_number() OVER w AS rn, count(*) OVER (PARTITION BY route_key, program) AS n
        FROM kept WINDOW w AS (PARTITION BY route_key, program ORDER BY miles ROWS UNBOUNDED PRECEDING)),
g AS (SELECT route_key, program, count(DISTINCT source_name) AS ns, max(n) AS n,
             min(miles) FILTER (WHERE cum >= tot / 2) AS med,
             min(miles) FILTER (WHERE rn = n // 2 + 1) AS upper_med,
             max(miles) - min(miles) AS width, max(dec) AS conf, max(seats) AS seats,
             arg_min(miles, (-dec, ord, miles)) AS best, bool_or(age > {STALE}) AS stale,
             bool_or(is_live) AS live, bool_or(is_rt) AS rt
      FROM run GROUP BY ALL),
s AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE width / abs(CASE WHEN upper_med = 0 THEN 1 ELSE upper_med END) END AS sp FROM g)
SELECT route_key, program, CASE WHEN ns >= 2 THEN med ELSE best END AS miles,
       round_even(CASE WHEN ns >= 2 AND sp > 0.10 THEN conf * 0.6 WHEN ns >= 2 THEN conf ELSE least(conf, 0.7) END, 3) AS confidence,
       seats,
       array_to_string(list_sort(list_filter([
          CASE WHEN live THEN 'live_award_space' ELSE 'no_live_space' END,
          CASE WHEN rt THEN 'rt_to_ow_normalized' END,
          CASE WHEN stale THEN 'stale' END,
          CASE WHEN ns >= 2 AND sp > 0.10 THEN 'sources_disagree_' || cast(cast(round_even(sp * 100, 0) AS bigint) AS varchar) || '%' END,
          CASE WHEN ns < 2 THEN 'single_source' END], lambda x: x IS NOT NULL)), '|') AS flags
FROM s
"""


@query("verify_awards", VERIFIED_AWARDS_SQL)
def _verify_awards(d):
    return verified_awards(d).withColumn("flags", joined(F.col("flags")))


@query("award_provenance", f"""
WITH u AS ({USABLE})
SELECT route_key, program, miles, source_name, trust, round(dec, 6) AS decayed_confidence, age > {STALE} AS stale
FROM (SELECT *, bool_or(is_live) OVER (PARTITION BY route_key, program) AS any_live FROM u)
WHERE is_live = any_live
""")
def _award_provenance(d):
    out = verify.award_provenance(award_quotes(d), NOW, HALF, STALE)
    return out.select(
        "route_key", "program", "miles", "source_name", "trust",
        r6(F.col("decayed_confidence")).alias("decayed_confidence"), "stale",
    )


VERIFIED_FARES_SQL = f"""
WITH u AS (
  SELECT *, greatest(0, (epoch_us({NOW_SQL}) - epoch_us(source_updated_at)) / 86400e6) AS age
  FROM @@fare_quotes q WHERE cash_cents BETWEEN 1000 AND 5000000),
d AS (SELECT *, greatest(0, least(1, confidence * pow(0.5, age / {HALF}))) AS dec FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY route_key ORDER BY dec DESC, ord) AS rn FROM d)
SELECT route_key, cash_cents, round_even(dec, 3) AS confidence,
       array_to_string(list_filter([CASE WHEN is_cached THEN 'cached_fare' END, CASE WHEN age > {STALE} THEN 'stale' END], lambda x: x IS NOT NULL), '|') AS flags,
       source_name
FROM r WHERE rn = 1
"""


@query("verify_fares", VERIFIED_FARES_SQL)
def _verify_fares(d):
    return verified_fares(d).withColumn("flags", joined(F.col("flags")))


@query("trust_weighted_median", """
WITH run AS (SELECT l_suppkey, floor(l_extendedprice) AS v,
                    sum(w) OVER (PARTITION BY l_suppkey ORDER BY floor(l_extendedprice) ROWS UNBOUNDED PRECEDING) AS cum,
                    sum(w) OVER (PARTITION BY l_suppkey) AS tot
             FROM (SELECT *, l_linenumber / 8.0E0 AS w FROM @lineitem) t)
SELECT l_suppkey, min(v) FILTER (WHERE cum >= tot / 2) AS weighted_median FROM run GROUP BY ALL
""")
def _median(d):
    df = d.table("lineitem").select(
        "l_suppkey", F.floor("l_extendedprice").cast("double").alias("value"),
        (F.col("l_linenumber") / 8.0).alias("weight"),
    )
    return verify.trust_weighted_median(df, ["l_suppkey"])


@query("relative_spread", """
WITH r AS (SELECT l_partkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) AS rn,
                  count(*) OVER (PARTITION BY l_partkey) AS n FROM @lineitem)
SELECT l_partkey, round(CASE WHEN max(n) <= 1 THEN 0 ELSE (max(v) - min(v)) / abs(min(v) FILTER (WHERE rn = n // 2 + 1)) END, 6) AS relative_spread
FROM r GROUP BY ALL
""")
def _spread(d):
    df = d.table("lineitem").withColumn("value", F.col("l_extendedprice"))
    return verify.relative_spread(df, ["l_partkey"]).select(
        "l_partkey", r6(F.col("relative_spread")).alias("relative_spread")
    )


@query("independent_source_count", """
SELECT route_key, program, count(DISTINCT source_name) AS sources FROM @@award_quotes q GROUP BY ALL
""")
def _sources(d):
    return verify.independent_source_count(d.view("award_quotes"))
