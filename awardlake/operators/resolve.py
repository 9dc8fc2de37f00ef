"""Resolve routes against chart rows and live rows.

A route asks for its airport pair and for every pair of geography tokens of its ends; a chart row
answers for a pair, and a distance band for the fixed bins of miles that it covers. Both sides meet in
one equi-join on (kind of pair, pair, cabin, bin), and one aggregate takes the first answer per
programme and source. Chart rows are reduced before the join. Keys of region pairs are few, so the
route side is salted.
"""

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions import points
from awardlake.functions.labels import parse_source_date
from awardlake.functions.rows import explode_rows, inline_rows
from awardlake.operators.ranking import dedupe_freshest

CHART = ["program", "source_name"]
SALTS = 8
#: Miles of a bin of distance bands, and the longest way on the globe.
BIN_MILES, FARTHEST = 500, 12_450
#: Kinds of pairs, in the order in which their answers count; distance bands come between the two.
AIRPORTS, REGIONS = 0, 2
PAIR = ["kind", "pair_lo", "pair_hi", "cabin", "bin"]


def salted_join(left: DataFrame, right: DataFrame, keys, row_id, salts=SALTS) -> DataFrame:
    """Inner equi-join whose hot keys are spread: ``left`` by a hash of ``row_id``, ``right`` copied."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def _bin(miles):
    return F.floor(F.greatest(F.least(miles, F.lit(FARTHEST)), F.lit(0)) / BIN_MILES).cast("int")


def _answers(chart_rows):
    """Chart rows reduced to one per (programme, source, pair, cabin, band), repeated for the bins of a band.

    ``first`` orders the answers of a pair: by band where a distance or an airport pair chose it, else by miles.
    """
    airports = F.col("origin_airport").isNotNull() & F.col("dest_airport").isNotNull()
    regions = F.col("origin_airport").isNull() & F.col("region_a").isNotNull() & F.col("region_b").isNotNull()
    a = F.when(airports, F.upper("origin_airport")).otherwise(F.lower("region_a"))
    b = F.when(airports, F.upper("dest_airport")).otherwise(F.lower("region_b"))
    measured = ~airports & F.col("distance_min").isNotNull() & F.col("distance_max").isNotNull()
    rows = chart_rows.where(airports | regions).select(
        *CHART, F.when(airports, AIRPORTS).otherwise(REGIONS).alias("kind"), F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi"),
        "cabin", F.when(measured, F.col("distance_min")).alias("distance_min"), F.when(measured, F.col("distance_max")).alias("distance_max"),
        points.normalize_one_way(F.col("miles"), F.col("roundtrip")).alias("_p"), "band_ord")
    by_miles = (F.col("kind") == REGIONS) & F.col("distance_min").isNull()
    first = F.struct(
        F.when(by_miles, F.col("_p.miles")).otherwise(F.col("band_ord")).alias("a"),
        F.when(by_miles, F.col("band_ord")).otherwise(F.col("_p.miles")).alias("b"), F.col("_p.flags").alias("flags"))
    group = [*CHART, "kind", "pair_lo", "pair_hi", "cabin", "distance_min", "distance_max"]
    reduced = rows.groupBy(*group).agg(F.min(first).alias("first"))
    covered = F.when(F.col("distance_min") <= F.col("distance_max"), F.sequence(_bin(F.col("distance_min")), _bin(F.col("distance_max"))))
    bins = F.when(F.col("distance_min").isNull(), F.array(F.lit(-1))).otherwise(covered)
    return explode_rows(reduced, [*group, "first"], bins, "_at", "bin").drop("_at")


def _located(routes, dim_airport, dim_zone) -> DataFrame:
    """Routes with region, coordinates and zone tokens of both ends; an airport's tokens are one row.

    The dimension is built once and joined twice: Spark reuses what it sends.
    """
    token = F.concat_ws("_", "program", F.lit("zone"), F.col("zone").cast("string"))
    zones = dim_zone.groupBy("code").agg(F.collect_set(F.struct("program", token.alias("token"))).alias("zones"))
    places = dim_airport.select("code", "region", "lat", "lon").join(zones, "code", "full")
    out = routes.select("route_key", "cabin", F.upper("origin").alias("origin"), F.upper("dest").alias("dest"))
    for side in ("origin", "dest"):
        end = places.select(F.col("code").alias(side), F.struct("region", "lat", "lon", "zones").alias(f"{side}_at"))
        out = out.join(end, side, "left")
    return out


_NO_TOKENS = "array<struct<program:string,token:string>>"


def _token_pairs():
    """Pairs of geography tokens of a located route: array of (program, pair_ord, a, b)."""
    region = {side: F.col(f"{side}_at.region") for side in ("origin", "dest")}
    zones = {side: F.coalesce(F.col(f"{side}_at.zones"), F.array().cast(_NO_TOKENS)) for side in ("origin", "dest")}

    def token(side, program):
        own = F.filter(zones[side], lambda z: z["program"] == program)
        return F.coalesce(F.array_max(F.transform(own, lambda z: z["token"])), region[side])

    def pair(program, order, a, b):
        return F.struct(program.cast("string").alias("program"), F.lit(order).alias("pair_ord"), a.alias("a"), b.alias("b"))

    programs = F.array_distinct(F.transform(F.concat(zones["origin"], zones["dest"]), lambda z: z["program"]))
    zoned = F.transform(programs, lambda p: pair(p, 0, token("origin", p), token("dest", p)))
    plain = F.array(pair(F.lit(None), 1, region["origin"], region["dest"]))
    return F.filter(F.concat(zoned, plain), lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def _distance():
    ends = [F.col(f"{side}_at.{c}") for side in ("origin", "dest") for c in ("lat", "lon")]
    return points.great_circle_miles(*ends)


def _question(kind, a, b, bin_, program, order):
    pair = {"pair_lo": F.least(a, b), "pair_hi": F.greatest(a, b)}
    return F.struct(
        F.lit(kind).alias("kind"), *(v.alias(k) for k, v in pair.items()), bin_.cast("int").alias("bin"),
        program.cast("string").alias("only_program"), order.cast("int").alias("pair_ord"))


def _bins_asked(distance):
    """The bin of plain bands, and that of the route's distance where it is known."""
    return F.when(distance.isNull(), F.array(F.lit(-1))).otherwise(F.array(F.lit(-1), _bin(distance)))


def _answered(asked, answers):
    """Answers to questions, one row per (route, programme, source): the first by kind, then by the order of that kind."""
    hit = salted_join(asked, answers, PAIR, "route_key")
    fits = F.col("only_program").isNull() | (F.col("only_program") == F.col("program"))
    holds = F.col("distance_min").isNull() | F.col("distance").between(F.col("distance_min"), F.col("distance_max"))
    measured = F.col("distance_min").isNotNull()
    region = (F.col("kind") == REGIONS) & ~measured
    low, mid = F.col("pair_ord").cast("bigint"), F.col("first.a")
    h = F.struct(
        F.when(measured, 1).otherwise(F.col("kind")).alias("step"), F.when(region, mid).otherwise(low).alias("x"),
        F.when(region, low).otherwise(mid).alias("y"), F.col("first.b").alias("z"), F.col("first.flags").alias("flags"))
    best = hit.where(fits & holds).groupBy("route_key", "cabin", *CHART).agg(F.min(h).alias("h"))
    plain = F.col("h.step") == REGIONS
    return best.select(
        "route_key", "cabin", *CHART, F.col("h.step").alias("step"), F.when(plain, F.col("h.y")).otherwise(F.col("h.x")).cast("int").alias("pair_ord"),
        F.when(plain, F.col("h.z")).otherwise(F.col("h.y")).alias("band_ord"), F.when(plain, F.col("h.x")).otherwise(F.col("h.z")).alias("miles"),
        F.col("h.flags").alias("flags"))


_ASKED = ["route_key", "cabin", "distance"]


def join_airport_pair(routes: DataFrame, chart_rows: DataFrame) -> DataFrame:
    """Exact airport-pair prices in either direction; the first band in order wins."""
    question = _question(AIRPORTS, F.upper("origin"), F.upper("dest"), F.lit(-1), F.lit(None), F.lit(0))
    asked = routes.select("route_key", "cabin", F.lit(None).cast("double").alias("distance"), F.inline(F.array(question)))
    pairs = chart_rows.where(F.col("origin_airport").isNotNull())
    return _answered(asked, _answers(pairs)).select("route_key", *CHART, "band_ord", "miles", "flags")


def route_tokens(routes: DataFrame, dim_airport: DataFrame, dim_zone: DataFrame) -> DataFrame:
    """Geography tokens of each route: (route_key, cabin, program, pair_ord, a, b).

    ``program`` NULL stands for every programme: the plain region pair. A programme that lists an
    airport as one of its zones gets its own pair, tried before the region pair.
    """
    return inline_rows(_located(routes, dim_airport, dim_zone), ["route_key", "cabin"], _token_pairs(), "a")


def route_distances(routes: DataFrame, dim_airport: DataFrame) -> DataFrame:
    """Great-circle distance of every route whose two airports have coordinates."""
    spot = dim_airport.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at = lambda side: spot.select(F.col("code").alias(side), F.struct("lat", "lon").alias(f"{side}_at"))
    base = routes.select("route_key", F.upper("origin").alias("origin"), F.upper("dest").alias("dest"))
    return base.join(at("origin"), "origin").join(at("dest"), "dest").select("route_key", _distance().alias("distance"))


def _by_tokens(tokens, bin_):
    question = _question(REGIONS, F.col("a"), F.col("b"), bin_, F.col("program"), F.col("pair_ord"))
    return tokens.select("route_key", "cabin", "distance", F.inline(F.array(question)))


def join_region_pair(tokens: DataFrame, chart_rows: DataFrame) -> DataFrame:
    """Cheapest plain band over all of a route's token pairs, per programme and source."""
    asked = _by_tokens(tokens.withColumn("distance", F.lit(None).cast("double")), F.lit(-1))
    return _answered(asked, _answers(chart_rows)).select("route_key", *CHART, "miles", "pair_ord", "band_ord", "flags")


def join_distance_band(tokens: DataFrame, chart_rows: DataFrame, distances: DataFrame) -> DataFrame:
    """First distance band, by token pair then band order, that holds the route's distance."""
    asked = _by_tokens(tokens.join(distances, "route_key"), _bin(F.col("distance")))
    return _answered(asked, _answers(chart_rows)).select("route_key", *CHART, "pair_ord", "band_ord", "miles", "flags")


def resolve_award_miles(routes, chart_rows, dim_airport, dim_zone) -> DataFrame:
    """One price per (route, programme, source): airport pair, else distance band, else region pair.

    (route_key, cabin, program, source_name, miles, flags, how). Every input is read once.
    """
    located = _located(routes, dim_airport, dim_zone).withColumn("distance", _distance())
    airports = F.array(_question(AIRPORTS, F.col("origin"), F.col("dest"), F.lit(-1), F.lit(None), F.lit(0)))
    by_tokens = F.transform(_token_pairs(), lambda p: F.transform(
        _bins_asked(F.col("distance")), lambda b: _question(REGIONS, p["a"], p["b"], b, p["program"], p["pair_ord"])))
    asked = inline_rows(located, _ASKED, F.concat(airports, F.flatten(by_tokens)), "kind")
    how = F.when(F.col("step") == AIRPORTS, "airport").when(F.col("step") == REGIONS, "region").otherwise("distance")
    best = _answered(asked, _answers(chart_rows))
    return best.select("route_key", "cabin", *CHART, "miles", "flags", how.alias("how"))


def _quote_frame(df, flags):
    return df.select(
        "route_key", "program", "cabin", F.col("miles").cast("bigint").alias("miles"), "seats", "source_name",
        "source_url", "trust", F.col("trust").alias("confidence"), "fetched_at",
        "source_updated_at", flags.alias("flags"),
    )


def chart_quotes(resolved: DataFrame, chart_rows: DataFrame, targets: DataFrame, fetched_at) -> DataFrame:
    """Resolved chart prices with their source's provenance, flagged as without live space.

    ``targets``: name, url, trust, updated_at and optionally via (``wayback`` adds a flag).
    """
    dated = chart_rows.where(F.col("updated_at").isNotNull()).groupBy(*CHART).agg(
        F.min_by("updated_at", "band_ord").alias("row_date")
    )
    source = targets.select(
        F.col("name").alias("source_name"), F.col("url").alias("source_url"), F.col("trust").cast("double").alias("trust"),
        F.col("updated_at").alias("target_date"),
        (F.col("via") if "via" in targets.columns else F.lit(None).cast("string")).alias("via"),
    )
    rows = (
        resolved.join(source, "source_name").join(dated, CHART, "left")
        .withColumns(
            {
                "seats": F.lit(None).cast("bigint"),
                "fetched_at": points.instant(fetched_at),
                "source_updated_at": parse_source_date(F.coalesce("row_date", "target_date")),
            }
        )
    )
    return _quote_frame(
        rows,
        F.concat(
            F.array(F.lit("no_live_space")), "flags",
            points.optional_flag(F.coalesce(F.col("via") == "wayback", F.lit(False)), "from_wayback"),
        ),
    )


def discovered_quotes(resolved: DataFrame, discovered: DataFrame, fetched_at) -> DataFrame:
    """Resolved discovery rows, grouped by (programme, source), with the last row's provenance."""
    meta = discovered.groupBy(*CHART).agg(
        F.max(F.struct("band_ord", "source_url", "source_updated_at", "trust")).alias("m"),
        F.min_by("updated_at", F.when(F.col("updated_at").isNotNull(), F.col("band_ord"))).alias("row_date"),
    )
    rows = (
        resolved.join(meta, CHART)
        .withColumns(
            {
                "source_url": F.col("m.source_url"),
                "trust": F.coalesce(F.nullif(F.col("m.trust"), F.lit(0.0)), F.lit(0.3)),
                "seats": F.lit(None).cast("bigint"),
                "fetched_at": points.instant(fetched_at),
                "source_updated_at": parse_source_date(F.coalesce(F.col("m.source_updated_at"), "row_date")),
            }
        )
    )
    return _quote_frame(rows, F.concat(F.array(F.lit("no_live_space"), F.lit("llm_extracted")), "flags"))


def live_award_quotes(
    routes: DataFrame, award_rows: DataFrame, targets: DataFrame, fetched_at, programs: DataFrame = None,
) -> DataFrame:
    """Freshest live row per source for each asked route, as quotes with seats."""
    rows = award_rows
    if programs is not None:
        rows = rows.join(programs.select("program"), "program", "left_semi")
    ends = ["origin", "dest", "cabin"]
    asked = routes.select("route_key", *ends)
    wanted = rows.join(asked.select(*ends), ends, "left_semi")
    source = targets.select(
        F.col("name").alias("source_name"), F.col("url").alias("source_url"),
        F.col("trust").cast("double").alias("trust"), F.col("updated_at").alias("target_date"),
        (F.col("via") if "via" in targets.columns else F.lit(None).cast("string")).alias("via"),
    )
    fresh = dedupe_freshest(wanted).withColumn(
        "_p", points.normalize_one_way(F.col("miles"), F.col("roundtrip"))
    )
    quoted = fresh.join(asked, ends).join(source, "source_name").withColumns(
        {
            "miles": F.col("_p.miles"),
            "fetched_at": points.instant(fetched_at),
            "source_updated_at": parse_source_date(F.coalesce("updated_at", "target_date")),
        }
    )
    archived = points.optional_flag(F.coalesce(F.col("via") == "wayback", F.lit(False)), "from_wayback")
    return _quote_frame(quoted, F.concat(F.array(F.lit("live_award_space")), "_p.flags", archived))


def cap_stale_programs(quotes: DataFrame, stale_programs: DataFrame, now, cap_days=vocab.STALE_CAP_DAYS) -> DataFrame:
    """Quotes of stale programmes get flag ``stale`` and a source date at most ``now - cap_days``."""
    cap = points.instant(now) - F.make_dt_interval(days=F.lit(cap_days))
    marked = quotes.join(
        stale_programs.select("program").distinct().withColumn("_stale", F.lit(True)), "program", "left"
    )
    stale = F.col("_stale").isNotNull()
    return marked.withColumns(
        {
            "flags": F.when(stale & ~F.array_contains("flags", "stale"), F.array_append("flags", F.lit("stale")))
            .otherwise(F.col("flags")),
            "source_updated_at": F.when(stale, F.least(F.col("source_updated_at"), cap)).otherwise(F.col("source_updated_at")),
        }
    ).drop("_stale").select(quotes.columns)


PIECE = 3


def _named(places):
    return places.select("code", F.upper("code").alias("id"), F.upper("city").alias("city"), F.upper("name").alias("name"))


def _pieces(named, sizes):
    """One row per place and distinct piece of its code, city and name."""
    def pieces(text):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        found = F.flatten(F.transform(starts, lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in sizes))))
        return F.coalesce(found, F.array().cast("array<string>"))

    held = F.array_distinct(F.concat(*(pieces(F.col(c)) for c in ("id", "city", "name"))))
    return explode_rows(named, ["code", "id", "city", "name"], held, "at", "piece").drop("at")


def _place_score(q):
    return (
        F.when(F.col("id") == q, 1000).when(F.startswith("id", q), 900 - (F.length("id") - F.length(q)))
        .when(F.startswith("city", q), 800).when(F.contains("city", q), 700).when(F.contains("name", q), 600))


def _top_places(scored, key, k):
    """First ``k`` per key; each task keeps no more than ``k`` of a key before the shuffle."""
    best = scored.where(F.col("score").isNotNull()).groupBy(key, "code").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def place_index(places: DataFrame, k, wanted: DataFrame = None) -> DataFrame:
    """(piece, code, score, rank): the ``k`` best places of every piece of one to three letters, or of those ``wanted``.

    Worth storing: a text of up to three letters then reads ``k`` rows, however many places hold it.
    """
    held = _pieces(_named(places), range(1, PIECE + 1)).where(F.col("piece") != "")
    if wanted is not None:
        held = held.join(wanted, "piece", "left_semi")
    return _top_places(held.select("piece", "code", _place_score(F.col("piece")).alias("score")), "piece", k)


def place_search(queries: DataFrame, places: DataFrame, k, index: DataFrame = None) -> DataFrame:
    """Top-k places per typed text: code, code prefix, city prefix, then parts of city and name.

    Texts of up to three letters are looked up in ``index`` (see :func:`place_index`; made for them where it is not
    given). A longer text meets the places that hold its first three letters; how it stands in them is checked
    afterwards.
    """
    asked = queries.select(F.upper(F.trim("query")).alias("q")).where(F.col("q") != "").distinct()
    brief = asked.where(F.length("q") <= PIECE).select(F.col("q").alias("piece"))
    ranked = (place_index(places, k, brief) if index is None else index.where(F.col("rank") <= k)).join(brief, "piece")
    met = _pieces(_named(places), [PIECE]).join(asked.where(F.length("q") > PIECE).withColumn("piece", F.substring("q", 1, PIECE)), "piece")
    longer = _top_places(met.select("q", "code", _place_score(F.col("q")).alias("score")), "q", k)
    return ranked.select(F.col("piece").alias("q"), "code", "score", "rank").unionAll(longer.select("q", "code", "score", "rank"))


def resolve_place(queries: DataFrame, places: DataFrame) -> DataFrame:
    """The one place a typed text stands for: best code match, else the only best-scored place."""
    top = place_search(queries, places, 2)  # the second only tells whether the first is alone
    best = top.groupBy("q").agg(
        F.min_by("code", "rank").alias("code"), F.max("score").alias("best"),
        F.collect_list("score").alias("scores"),
    )
    ties = F.size(F.filter("scores", lambda s: s == F.col("best")))
    keep = F.upper("code").startswith(F.col("q")) | (ties == 1)
    return best.where(keep).select("q", "code")
