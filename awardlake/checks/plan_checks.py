"""Queries over paths, options and verdicts."""

from pyspark.sql import functions as F

from awardlake.checks.base import NOW, joined, query, r6
from awardlake.checks.verify_checks import (
    HALF, STALE, VERIFIED_AWARDS_SQL, VERIFIED_FARES_SQL, award_quotes, fare_quotes, verified_awards,
    verified_fares,
)
from awardlake.operators import ranking
from awardlake.plans import paths, quotes
from awardlake.sources import catalogue, sinks


def ratios(d):
    return catalogue.flatten_transfer_ratios(d.view("partners"), "2000-01-01")


def all_ratios(d):
    """Currency rows plus programme-to-programme rows."""
    own = d.view("ratios").withColumn("ord", F.col("ord").cast("bigint"))
    return own.unionByName(d.view("program_ratios"))


@query("flatten_transfer_ratios", """
SELECT from_currency, to_program, ratio, bonus_multiplier, effective_ratio, bonus_label,
       CASE WHEN is_bonus THEN 'transfer_bonus' ELSE '' END AS flags, confidence, is_bonus, ord
FROM @@ratios r
""")
def _ratios(d):
    return ratios(d).select(
        "from_currency", "to_program", "ratio", "bonus_multiplier", "effective_ratio", "bonus_label",
        joined(F.col("flags")).alias("flags"), "confidence", "is_bonus", "ord",
    )


@query("best_ratio_per_program", """
SELECT from_currency, to_program, effective_ratio, bonus_label FROM (
  SELECT *, row_number() OVER (PARTITION BY from_currency, to_program ORDER BY confidence DESC, effective_ratio DESC, ord) AS rn
  FROM @@ratios r) WHERE rn = 1
""")
def _best_ratio(d):
    return ranking.best_ratio_per_program(ratios(d)).select(
        "from_currency", "to_program", "effective_ratio", "bonus_label"
    )


@query("best_ratio_by_program", """
SELECT to_program, from_currency, effective_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY to_program ORDER BY confidence DESC, effective_ratio DESC, ord) AS rn
  FROM @@ratios r) WHERE rn = 1
""")
def _best_ratio_program(d):
    return ranking.best_ratio_per_program(ratios(d), ["to_program"]).select(
        "to_program", "from_currency", "effective_ratio"
    )


@query("partner_programs", "SELECT DISTINCT from_currency, to_program AS program FROM @@ratios r")
def _partners(d):
    return catalogue.partner_programs(ratios(d))


EDGES_SQL = f"""
va AS ({VERIFIED_AWARDS_SQL}),
e AS (SELECT from_currency AS src, to_program AS dst,
             CASE WHEN is_bonus THEN 'bonus:' || bonus_label ELSE 'base' END AS edge_key,
             effective_ratio AS ratio, confidence, is_bonus, ord,
             upper(to_program) || CASE WHEN bonus_label IS NULL THEN '' ELSE ' (' || bonus_label || ')' END AS hop
      FROM @@ratios r)
"""


@query("build_edges", f"""
WITH {EDGES_SQL},
t AS (SELECT q.request_id, q.route_key, e.* FROM @@requests q JOIN e ON e.src = q.currency)
SELECT request_id, src, dst, edge_key, ratio, NULL::bigint AS miles, NULL::bigint AS seats, confidence,
       CASE WHEN is_bonus THEN 'transfer_bonus' ELSE '' END AS flags FROM t
UNION ALL
SELECT request_id, program, '__SEAT__', 'award', NULL, miles, seats, va.confidence, va.flags
FROM (SELECT DISTINCT request_id, route_key, dst FROM t) t JOIN va ON va.route_key = t.route_key AND va.program = t.dst
""")
def _edges(d):
    out = paths.build_edges(d.view("requests"), ratios(d), verified_awards(d))
    return out.select(
        "request_id", "src", "dst", "edge_key", "ratio", "miles", "seats", "confidence",
        joined(F.col("flags")).alias("flags"),
    )


# Independent formulation: a recursive walk over one edge table with a cycle guard.
PATHS_SQL = f"""
WITH RECURSIVE {EDGES_SQL.replace('FROM @@ratios r)', '''FROM (SELECT * FROM @@ratios r UNION ALL
      SELECT from_currency, to_program, ratio, bonus_multiplier, effective_ratio, bonus_label, confidence, ord, is_bonus FROM @@program_ratios p) r)''')},
walk AS (
  SELECT q.request_id, q.route_key, q.currency, e.dst, e.ratio, e.confidence, e.hop AS hops, [q.currency, e.dst] AS seen,
         1 AS transfers, e.is_bonus AS bonus, [e.ord] AS path_ord
  FROM @@requests q JOIN e ON e.src = q.currency
  UNION ALL
  SELECT w.request_id, w.route_key, w.currency, e.dst, w.ratio * e.ratio, w.confidence * e.confidence,
         w.hops || ' -> ' || e.hop, list_append(w.seen, e.dst), w.transfers + 1, w.bonus OR e.is_bonus,
         list_append(w.path_ord, e.ord)
  FROM walk w JOIN e ON e.src = w.dst WHERE NOT list_contains(w.seen, e.dst) AND w.transfers < 3)
SELECT request_id, program, hops, transfers, round(w.ratio, 6) AS ratio, miles, seats,
       round(w.confidence * va.confidence, 6) AS confidence,
       array_to_string(list_sort(list_distinct(list_filter(
         string_split(va.flags, '|') || [CASE WHEN bonus THEN 'transfer_bonus' END,
           CASE WHEN seats IS NOT NULL THEN seats || ' seats' END, CASE WHEN transfers > 1 THEN 'multi_hop' END],
         lambda x: x IS NOT NULL))), '|') AS flags
FROM walk w JOIN va ON va.route_key = w.route_key AND va.program = w.dst
"""


@query("enumerate_paths", PATHS_SQL)
def _paths(d):
    edges = sinks.materialize(paths.build_edges(d.view("requests"), all_ratios(d), verified_awards(d), True), "edges")
    return paths.enumerate_paths(edges).select(
        "request_id", "program", "hops", "transfers", r6(F.col("ratio")).alias("ratio"), "miles", "seats",
        r6(F.col("confidence")).alias("confidence"), joined(F.col("flags")).alias("flags"),
    )


CARD_RATE = "CASE card WHEN 'venture_x' THEN 1.25E0 ELSE 1.0E0 END"
TITLE = "array_to_string(list_transform(string_split(lower(currency), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

OPTIONS_CTE = f"""
{EDGES_SQL},
vf AS ({VERIFIED_FARES_SQL}),
base AS (SELECT q.*, vf.cash_cents, vf.confidence AS fconf, vf.flags AS fflags, {CARD_RATE} AS rate, {TITLE} AS title
         FROM @@requests q JOIN vf ON vf.route_key = q.route_key),
tr AS (SELECT b.request_id, title || ' -> ' || e.hop AS label, 'transfer' AS kind, va.program,
              cast(ceil(va.miles / e.ratio) AS bigint) AS source_points, b.cash_cents, balance,
              round_even(e.confidence * va.confidence * fconf, 3) AS confidence,
              array_to_string(list_sort(list_distinct(list_filter(
                string_split(va.flags, '|') || string_split(fflags, '|') || [CASE WHEN is_bonus THEN 'transfer_bonus' END,
                  CASE WHEN seats IS NOT NULL THEN seats || ' seats' END], lambda x: x IS NOT NULL AND x <> ''))), '|') AS flags,
              e.ord AS o
       FROM base b JOIN e ON e.src = b.currency JOIN va ON va.route_key = b.route_key AND va.program = e.dst),
opts AS (SELECT request_id, label, kind, program, round_even(cash_cents / source_points, 4) AS cpp, source_points, cash_cents,
                balance >= source_points AS affordable, confidence, flags, o FROM tr
         UNION ALL
         SELECT request_id, title || ' portal', 'portal', NULL, rate, cast(ceil(cash_cents / rate) AS bigint), cash_cents,
                balance >= ceil(cash_cents / rate), round_even(fconf, 3), fflags, -1 FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cpp DESC, o) AS rank FROM opts)
"""

OPTION_COLUMNS = [
    "request_id", "label", "kind", "program", "cpp", "source_points", "cash_cents", "affordable",
    "confidence", "flags", "rank",
]


def market(d, verified=None):
    return quotes.build_market(award_quotes(d), fare_quotes(d), ratios(d), NOW, HALF, STALE, requests=d.view("requests"), verified=verified)


def request_quotes(d, verified=None):
    return quotes.quote_requests(d.view("requests"), market(d, verified))


def shown(options):
    return options.withColumn("flags", joined(F.col("flags"))).select(
        [F.col(c).cast("bigint") if c == "rank" else F.col(c) for c in OPTION_COLUMNS]
    )


VERDICTS_CTE = OPTIONS_CTE + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cpp DESC, o) AS rn
         FROM opts WHERE kind = 'transfer' AND affordable AND cpp > 0) WHERE rn = 1),
portal AS (SELECT * FROM opts WHERE kind = 'portal'),
two AS (SELECT p.request_id, p.cpp AS pc, p.flags AS pflags, b.cpp AS bc, b.cpp / p.cpp AS ratio, b.label AS bl, b.program AS bp, b.flags AS bflags,
               cast(cast(round_even(p.cpp, 2) AS decimal(18,2)) AS varchar) AS ptxt, cast(cast(round_even(b.cpp, 2) AS decimal(18,2)) AS varchar) AS btxt
        FROM portal p LEFT JOIN best b ON b.request_id = p.request_id),
verdicts AS (
SELECT request_id,
       CASE WHEN bc IS NULL THEN 'portal_only'
            WHEN ratio >= 1.2 THEN CASE WHEN regexp_matches(bflags, '(^|\\|)(stale|bounds_violation|sources_disagree[^|]*)(\\||$)') THEN 'tentative_best' ELSE 'best' END
            WHEN ratio >= 0.8 THEN 'comparable' ELSE 'portal_only' END AS label,
       bp AS best_program, bl AS best_label, bc AS best_cpp, pc AS portal_cpp,
       CASE WHEN bc IS NULL THEN 'No verified transfer beats the portal floor (' || ptxt || 'c/pt).'
            WHEN ratio >= 1.2 THEN bl || ' returns ' || btxt || 'c/pt against the portal floor of ' || ptxt || 'c/pt (' || cast(cast(round_even((ratio - 1) * 100, 0) AS bigint) AS varchar) || '% better).'
            WHEN ratio >= 0.8 THEN bl || ' (' || btxt || 'c/pt) is within 20% of the portal floor (' || ptxt || 'c/pt).'
            ELSE 'Best transfer (' || btxt || 'c/pt) is well below the portal floor (' || ptxt || 'c/pt).' END AS rationale,
       coalesce(bflags, pflags) AS flags
FROM two)
"""


QUOTED_SQL = f"""
WITH {VERDICTS_CTE}
SELECT q.request_id, q.route_key, q.currency, q.balance, q.card, coalesce(v.label, 'no_fare') AS label, best_program, best_label,
       best_cpp, portal_cpp, rationale, v.flags
FROM @@requests q LEFT JOIN verdicts v ON v.request_id = q.request_id
"""


@query("quote_requests", QUOTED_SQL)
def _quote_requests(d):
    return request_quotes(d).verdicts.withColumn("flags", joined(F.col("flags")))


@query("quote_stored_market", QUOTED_SQL)
def _quote_stored(d):
    """The same requests against a market stored in buckets of its routes."""
    got = quotes.quote_requests(d.view("requests"), quotes.stored_market(market(d)))
    return got.verdicts.withColumn("flags", joined(F.col("flags")))


@query("rank_options", f"WITH {OPTIONS_CTE} SELECT {', '.join(OPTION_COLUMNS)} FROM ranked")
def _options(d):
    return shown(request_quotes(d).options)


def plain_options(d):
    """Options built by the stepwise operators P1-P4 and W5 instead of the batch plan."""
    asked, fares = d.view("requests"), verified_fares(d)
    edges = sinks.materialize(paths.build_edges(asked, ratios(d), verified_awards(d)), "edges")
    moved = paths.transfer_options(paths.enumerate_paths(edges), fares, asked)
    floor = paths.portal_option(asked, fares).withColumn("path_ord", F.array().cast("array<bigint>"))
    return paths.rank_options(moved.unionByName(floor))


@query("rank_options_stepwise", f"WITH {OPTIONS_CTE} SELECT {', '.join(OPTION_COLUMNS)} FROM ranked")
def _plain_options(d):
    return shown(plain_options(d))


@query("transfer_options", f"WITH {OPTIONS_CTE} SELECT {', '.join(OPTION_COLUMNS[:-1])} FROM opts WHERE kind = 'transfer'")
def _transfer_options(d):
    asked, fares = d.view("requests"), verified_fares(d)
    edges = sinks.materialize(paths.build_edges(asked, ratios(d), verified_awards(d)), "edges")
    out = paths.transfer_options(paths.enumerate_paths(edges), fares, asked)
    return out.withColumn("flags", joined(F.col("flags"))).select(OPTION_COLUMNS[:-1])


@query("portal_option", f"WITH {OPTIONS_CTE} SELECT {', '.join(OPTION_COLUMNS[:-1])} FROM opts WHERE kind = 'portal'")
def _portal_option(d):
    out = paths.portal_option(d.view("requests"), verified_fares(d))
    return out.withColumn("flags", joined(F.col("flags"))).select(OPTION_COLUMNS[:-1])


@query("conclude_verdicts", f"WITH {VERDICTS_CTE} SELECT * FROM verdicts")
def _conclude(d):
    return paths.conclude_verdicts(request_quotes(d).options).withColumn("flags", joined(F.col("flags")))


@query("filter_options", f"""
WITH {VERDICTS_CTE}
SELECT o.request_id, o.label, o.cpp, CASE WHEN v.label IN ('best', 'tentative_best') THEN v.best_cpp ELSE v.portal_cpp END AS headline_cpp
FROM opts o JOIN verdicts v ON v.request_id = o.request_id
WHERE o.kind = 'portal' OR (o.flags LIKE '%bonus%' AND o.flags NOT LIKE '%multi_hop%')
""")
def _filter(d):
    got = request_quotes(d)
    out = paths.filter_options(got.options, got.verdicts, bonuses_only=True, show_multi_hop=False)
    return out.select("request_id", "label", "cpp", "headline_cpp")


@query("quote_portfolios", f"""
WITH {VERDICTS_CTE.replace('@@requests q', '''(SELECT q.request_id || '/' || c.r_name AS request_id, route_key, c.r_name AS currency,
   balance // (c.r_regionkey + 1) AS balance, card FROM @@requests q CROSS JOIN @region c WHERE c.r_regionkey < 2) q''')}
SELECT request_id, label, best_cpp FROM verdicts
UNION ALL
SELECT q.request_id || '/' || r_name, 'no_fare', NULL FROM @@requests q CROSS JOIN @region c
WHERE r_regionkey < 2 AND q.route_key NOT IN (SELECT route_key FROM vf)
""")
def _portfolios(d):
    base = d.view("requests")
    users = base.select(
        F.col("request_id").alias("user_id"), "card",
        F.create_map(
            F.lit("AFRICA"), F.col("balance"), F.lit("AMERICA"), F.expr("balance div 2")
        ).alias("balances"),
    )
    routes = base.select(F.col("request_id").alias("user_id"), "route_key")
    got = quotes.quote_portfolios(users, routes, market(d)).verdicts
    return got.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "currency").alias("request_id"), "label", "best_cpp"
    )


@query("reachable_awards", f"""
WITH va AS ({VERIFIED_AWARDS_SQL})
SELECT route_key, program, miles FROM va WHERE program IN (SELECT to_program FROM @@ratios r WHERE from_currency = 'AFRICA')
""")
def _reachable(d):
    return ranking.reachable_awards(verified_awards(d), ratios(d), "AFRICA").select("route_key", "program", "miles")


@query("unreachable_awards", f"""
WITH va AS ({VERIFIED_AWARDS_SQL})
SELECT route_key, program, miles FROM va WHERE program NOT IN (SELECT to_program FROM @@ratios r WHERE from_currency = 'AFRICA')
""")
def _unreachable(d):
    return ranking.unreachable_awards(verified_awards(d), ratios(d), "AFRICA").select("route_key", "program", "miles")
