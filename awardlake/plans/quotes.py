"""Batches of requests answered against market tables."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from awardlake import vocab
from awardlake.functions import points
from awardlake.functions.rows import explode_rows
from awardlake.operators import verify
from awardlake.plans import paths
from awardlake.sources import sinks


class Market(NamedTuple):
    """Verified prices and the transfer paths that lead to them; shared by all requests."""

    awards: DataFrame
    fares: DataFrame
    paths: DataFrame


class Quotes(NamedTuple):
    verdicts: DataFrame
    options: DataFrame


def build_market(
    quotes, fares, ratios, now, half_life_days=vocab.HALF_LIFE_DAYS,
    stale_after_days=vocab.STALE_AFTER_DAYS, include_program_edges=False,
    max_transfer_hops=vocab.MAX_TRANSFER_HOPS, requests: DataFrame = None, verified: DataFrame = None,
) -> Market:
    """Verify both sides of the market once, whatever the number of requests.

    Only programmes some currency reaches are verified and, where ``requests`` is given, only routes
    that are asked for. Programmes are few, so a join by them would move all quotes to a few tasks: the reached
    ones, bounded by the catalogue, are one array that every row is held against where it is read. Routes
    are a semi-join. A caller that needs all verified awards anyway passes them, written once, as ``verified``
    (of the same quotes and settings): they are narrowed by the same limits, and no quote is verified twice.
    """
    reach = paths.transfer_paths(ratios, max_transfer_hops, include_program_edges)
    awards = quotes if verified is None else verified
    awards = awards.where(F.array_contains(reach.agg(F.collect_set("program")).scalar(), F.col("program")))
    if requests is not None:
        asked = requests.select("route_key").distinct()
        awards, fares = awards.join(asked, "route_key", "left_semi"), fares.join(asked, "route_key", "left_semi")
    return Market(
        verify.verify_awards(awards, now, half_life_days, stale_after_days) if verified is None else awards.select(verified.columns),
        verify.verify_fares(fares, now, half_life_days, stale_after_days),
        reach,
    )


def stored_market(market: Market, buckets=None) -> Market:
    """The market written once, both sides in buckets of their route: batches of requests are then dealt to it, it stays in place."""
    return Market(
        sinks.bucketed(market.awards, "route_key", "awards", buckets), sinks.bucketed(market.fares, "route_key", "fares", buckets),
        sinks.materialize(market.paths, "paths"))


def market_options(market: Market) -> DataFrame:
    """Per (route, currency) the priced transfer options, best first, as one array.

    An option's price does not depend on who asks, so it is computed once per route and currency.
    The array is as long as the currency's transfer paths: the ratio catalogue bounds it, not
    the number of requests or quotes. It also bounds the map of a programme's paths that awards are looked up in.
    """
    fares = market.fares.select(
        "route_key", "cash_cents", F.col("confidence").alias("_fare_conf"),
        F.col("flags").alias("_fare_flags"),
    )
    awards = market.awards.select(
        "route_key", "program", "miles", "seats", F.col("confidence").alias("_conf"),
        F.col("flags").alias("_flags"),
    )
    need = points.source_points_for_award(F.col("miles"), F.col("ratio"))
    # programmes are few: a join by them would give all awards to one task a programme
    way = F.struct("program", F.struct("start", "hops", "transfers", "ratio", "confidence", "flags", "path_ord").alias("way"))
    listed = market.paths.where(F.col("program").isNotNull()).agg(F.collect_list(way).alias("all"), F.collect_set("program").alias("programs"))
    ways = F.transform("programs", lambda p: F.transform(F.filter("all", lambda w: w["program"] == p), lambda w: w["way"]))
    by_program = listed.select(F.map_from_arrays("programs", ways)).scalar()
    priced = awards.join(fares, "route_key")
    rows = explode_rows(priced, priced.columns, F.try_element_at(by_program, F.col("program")), "_pos", "_way")
    rows = rows.select(*priced.columns, "_way.*").withColumn("source_points", need)
    cpp = points.half_even(
        F.coalesce(points.cents_per_point(F.col("cash_cents"), F.col("source_points")), F.lit(0.0)), 4
    )
    flags = points.sorted_union(
        F.col("flags"), F.col("_flags"), F.col("_fare_flags"),
        points.optional_flag(F.col("seats").isNotNull(), F.concat(F.col("seats").cast("string"), F.lit(" seats"))),
        points.optional_flag(F.col("transfers") > 1, "multi_hop"),
    )
    option = F.struct(
        (-cpp).alias("neg"), F.lit(1).alias("kind_rank"), "path_ord",
        F.concat(paths.title(F.col("start")), F.lit(" -> "), F.col("hops")).alias("label"),
        F.lit("transfer").alias("kind"), "program", cpp.alias("cpp"), "source_points", "cash_cents",
        points.half_even(F.col("confidence") * F.col("_conf") * F.col("_fare_conf"), 3).alias("confidence"),
        flags.alias("flags"),
    )
    return rows.groupBy("route_key", F.col("start").alias("currency")).agg(
        F.array_sort(F.collect_list(option)).alias("offers")
    )


def _priced_requests(requests, market):
    fares = market.fares.select(
        "route_key", "cash_cents", F.col("confidence").alias("_fare_conf"),
        F.col("flags").alias("_fare_flags"),
    )
    # joined by the route alone, which is how a stored market lies: the currencies of a route are few
    offers = F.map_from_entries(F.collect_list(F.struct("currency", "offers")))
    by_route = market_options(market).where(F.col("currency").isNotNull()).groupBy("route_key").agg(offers.alias("_by_currency"))
    priced = requests.join(fares, "route_key", "left").join(by_route, "route_key", "left")
    return priced.withColumn("offers", F.try_element_at("_by_currency", F.col("currency"))).drop("_by_currency")


def quote_requests(
    requests: DataFrame, market: Market, threshold=vocab.VERDICT_THRESHOLD,
    warning_flags=vocab.WARNING_FLAGS,
) -> Quotes:
    """Verdict and ranked options of every request; ``no_fare`` where no fare was verified."""
    priced = _priced_requests(requests, market)
    affordable = F.filter(
        F.col("offers"), lambda o: (o["source_points"] <= F.col("balance")) & (o["cpp"] > 0)
    )
    rate = points.portal_cpp_of(F.col("card"))
    fields = paths.verdict_fields(
        F.col("best"), F.col("_rate"), F.col("_fare_flags"), threshold, warning_flags
    )
    priceless = F.col("cash_cents").isNull()
    asked = requests.columns
    verdicts = priced.select(
        *asked, "cash_cents", "_fare_flags", rate.alias("_rate"),
        F.try_element_at(affordable, F.lit(1)).alias("best"),
    ).select(
        *asked,
        *[
            (F.when(priceless, F.lit("no_fare")).otherwise(v) if k == "label" else F.when(~priceless, v)).alias(k)
            for k, v in fields.items()
        ],
    )
    portal = paths.portal_fields(
        F.col("currency"), F.col("balance"), F.col("card"), F.col("cash_cents"),
        F.col("_fare_conf"), F.col("_fare_flags"),
    )
    floor = F.struct(
        (-portal["cpp"]).alias("neg"), F.lit(0).alias("kind_rank"),
        F.array().cast("array<bigint>").alias("path_ord"), portal["label"].alias("label"),
        portal["kind"].alias("kind"), portal["program"].alias("program"), portal["cpp"].alias("cpp"),
        portal["source_points"].alias("source_points"), portal["cash_cents"].alias("cash_cents"),
        portal["confidence"].alias("confidence"), portal["flags"].alias("flags"),
    )
    merged = F.array_sort(F.when(F.col("offers").isNull(), F.array(floor)).otherwise(
        F.array_append(F.col("offers"), floor)
    ))
    offered = priced.where(F.col("cash_cents").isNotNull())
    options = (
        explode_rows(offered, ["request_id", "balance"], merged, "pos", "o")
        .select(
            "request_id", (F.col("pos") + 1).alias("rank"), "o.label", "o.kind", "o.program", "o.cpp",
            "o.source_points", "o.cash_cents",
            F.coalesce(F.col("balance") >= F.col("o.source_points"), F.lit(False)).alias("affordable"),
            "o.confidence", "o.flags", "o.path_ord",
        )
    )
    return Quotes(verdicts, options)


def portfolio_requests(users: DataFrame, routes: DataFrame) -> DataFrame:
    """One request per user, currency held and route the user asks for.

    ``users``: user_id, card, balances map<currency, points>; ``routes``: user_id, route_key.
    """
    held = users.select("user_id", "card", F.explode("balances").alias("currency", "balance"))
    return held.join(routes, "user_id").withColumn(
        "request_id", F.concat_ws("/", F.col("user_id").cast("string"), "currency", "route_key")
    )


def quote_portfolios(users, routes, market, threshold=vocab.VERDICT_THRESHOLD) -> Quotes:
    """Verdicts for every balance of every user against one shared market."""
    return quote_requests(portfolio_requests(users, routes), market, threshold)
