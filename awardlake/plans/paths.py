"""Redemption paths: currency -> programme(s) -> seat, their options and verdicts."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from awardlake import vocab
from awardlake.functions import points

EMPTY_FLAGS = "cast(array() as array<string>)"
SEAT = "__SEAT__"
SEAT_ORD = 2**62


def title(name):
    """``capital_one`` -> ``Capital One``."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def transfer_edges(ratios: DataFrame) -> DataFrame:
    """Ratio rows as edges; of rows with the same ends and key the last (by ``ord``) counts."""
    key = (
        F.when(~F.col("is_bonus"), F.lit("base"))
        .when(F.col("bonus_label").isNull(), F.lit("bonus"))
        .otherwise(F.concat(F.lit("bonus:"), F.col("bonus_label")))
    )
    percent = points.half_even((F.col("bonus_multiplier") - 1) * 100, 0).cast("int").cast("string")
    hop = F.concat(
        title(F.col("to_program")),
        F.when(F.col("bonus_label").isNotNull(), F.concat(F.lit(" ("), F.col("bonus_label"), F.lit(")")))
        .when(F.col("bonus_multiplier") != 1, F.concat(F.lit(" (+"), percent, F.lit("% bonus)")))
        .otherwise(F.lit("")),
    )
    flags = points.optional_flag(F.col("is_bonus"), "transfer_bonus")
    edges = ratios.select(
        F.col("from_currency").alias("src"), F.col("to_program").alias("dst"),
        key.alias("edge_key"), F.col("effective_ratio").alias("ratio"),
        F.col("confidence").cast("double").alias("confidence"),
        (F.col("flags") if "flags" in ratios.columns else flags).alias("flags"),
        hop.alias("hop_label"), "ord",
    )
    payload = ["ratio", "confidence", "flags", "hop_label"]
    last = edges.groupBy("src", "dst", "edge_key").agg(
        F.max(F.struct("ord", *payload)).alias("e"), F.min("ord").alias("ord")
    )
    return last.select("src", "dst", "edge_key", *[f"e.{c}" for c in payload], "ord")


def build_edges(
    requests: DataFrame,
    ratios: DataFrame,
    verified_awards: DataFrame,
    include_program_edges=False,
    max_transfer_hops=vocab.MAX_TRANSFER_HOPS,
) -> DataFrame:
    """Edges per request: base and bonus transfers, and a seat edge per reachable programme."""
    transfers = transfer_edges(ratios)
    asked = requests.select("request_id", "route_key", F.col("currency").alias("start"))
    layers = [asked.join(transfers, F.col("start") == F.col("src"))]
    if include_program_edges:
        for _ in range(max_transfer_hops):
            reached = layers[-1].select(
                "request_id", "route_key", "start", F.col("dst").alias("src")
            ).distinct()
            layers.append(reached.join(transfers, "src").where(F.col("dst") != F.col("start")))
    columns = ["request_id", "start", "src", "dst", "edge_key", "ratio", "confidence", "flags",
               "hop_label", "ord", "route_key"]
    hops = reduce(DataFrame.unionByName, [x.select(columns) for x in layers])
    if include_program_edges:
        hops = hops.dropDuplicates(["request_id", "src", "dst", "edge_key"])
    reached = hops.select("request_id", "start", "route_key", F.col("dst").alias("program")).distinct()
    seats = reached.join(verified_awards, ["route_key", "program"]).select(
        "request_id", "start", F.col("program").alias("src"), F.lit(SEAT).alias("dst"),
        F.lit("award").alias("edge_key"), F.lit(None).cast("double").alias("ratio"),
        "confidence", "flags", F.lit(None).cast("string").alias("hop_label"),
        F.lit(SEAT_ORD).alias("ord"), "miles", "seats",
    )
    return hops.drop("route_key").withColumns(
        {"miles": F.lit(None).cast("bigint"), "seats": F.lit(None).cast("bigint")}
    ).unionByName(seats)


def walk_transfers(edges: DataFrame, key, max_transfer_hops) -> DataFrame:
    """Every simple chain of 1 .. max_transfer_hops + 1 transfers that starts at ``start``."""
    step = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], F.col("src").alias("_src"), "dst", "ratio",
        "confidence", "flags", "hop_label", "ord",
    )
    named = list(dict.fromkeys([*key, "start"]))
    first = edges.where(F.col("src") == F.col("start")).select(
        *named, F.col("dst").alias("program"),
        F.array("start", "dst").alias("visited"), "ratio", "confidence",
        "flags", F.col("hop_label").alias("hops"), F.array("ord").alias("path_ord"),
        F.lit(1).alias("transfers"),
    )
    found = [first]
    for _ in range(max_transfer_hops):
        p, e = found[-1].alias("p"), step.alias("e")
        same = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"e._k_{k}") for k in key],
                      F.col("p.program") == F.col("e._src"))
        found.append(
            p.join(e, same).where(~F.array_contains("p.visited", F.col("e.dst"))).select(
                *[F.col(f"p.{k}") for k in named], F.col("e.dst").alias("program"),
                F.concat("p.visited", F.array("e.dst")).alias("visited"),
                (F.col("p.ratio") * F.col("e.ratio")).alias("ratio"),
                (F.col("p.confidence") * F.col("e.confidence")).alias("confidence"),
                points.sorted_union(F.col("p.flags"), F.col("e.flags")).alias("flags"),
                F.concat("p.hops", F.lit(" -> "), "e.hop_label").alias("hops"),
                F.concat("p.path_ord", F.array("e.ord")).alias("path_ord"),
                (F.col("p.transfers") + 1).alias("transfers"),
            )
        )
    return reduce(DataFrame.unionByName, found).drop("visited")


def _with_seat(chains, confidence, flags, seats):
    """Columns of a whole path: confidence product and united flags."""
    return {
        "confidence": chains * confidence,
        "flags": points.sorted_union(
            flags,
            points.optional_flag(seats.isNotNull(), F.concat(seats.cast("string"), F.lit(" seats"))),
            points.optional_flag(F.col("transfers") > 1, "multi_hop"),
        ),
    }


def enumerate_paths(edges: DataFrame, max_transfer_hops=vocab.MAX_TRANSFER_HOPS) -> DataFrame:
    """All simple paths from the request's currency to the seat, at most hops + 2 edges long.

    The edges are read once per transfer; where they are costly to build, pass them as a written table
    (``sinks.materialize``). Where all requests share one catalogue, :func:`transfer_paths` walks the
    catalogue instead of every request's copy of it.
    """
    hops = edges.where(F.col("dst") != SEAT)
    seats = edges.where(F.col("dst") == SEAT).select(
        "request_id", F.col("src").alias("program"), "miles", "seats",
        F.col("confidence").alias("_conf"), F.col("flags").alias("_flags"),
    )
    chains = walk_transfers(hops, ["request_id"], max_transfer_hops)
    whole = _with_seat(
        F.col("confidence"), F.col("_conf"),
        F.concat(F.col("flags"), F.col("_flags")), F.col("seats"),
    )
    return chains.join(seats, ["request_id", "program"]).withColumns(whole).select(
        "request_id", "start", "program", "hops", "transfers", "ratio", "miles", "seats",
        "confidence", "flags", "path_ord",
    )


def transfer_paths(
    ratios: DataFrame, max_transfer_hops=vocab.MAX_TRANSFER_HOPS, include_program_edges=False
) -> DataFrame:
    """Paths currency -> programme of the ratio catalogue, independent of any request.

    Programme-to-programme rows only matter behind a currency, so they are attached to every
    currency that can start a path.
    """
    edges = transfer_edges(ratios)
    if not include_program_edges:
        starts = edges.withColumn("start", F.col("src"))
        return walk_transfers(starts, ["start"], 0)
    programs = edges.select(F.col("dst").alias("src")).distinct()
    currencies = edges.join(programs, "src", "left_anti").select(F.col("src").alias("start")).distinct()
    layer = edges.join(currencies, F.col("src") == F.col("start"))
    layers = [layer]
    for _ in range(max_transfer_hops):
        reached = layers[-1].select("start", F.col("dst").alias("src")).distinct()
        layers.append(reached.join(edges, "src").select(layer.columns))
    keyed = reduce(DataFrame.unionByName, layers).dropDuplicates(["start", "src", "dst", "edge_key"])
    return walk_transfers(keyed, ["start"], max_transfer_hops)


def portal_fields(currency, balance, card, cents, fare_confidence, fare_flags):
    """Columns of the portal option of one request."""
    rate = points.portal_cpp_of(card)
    need = points.portal_points_needed(cents, rate)
    return {
        "label": F.concat(title(currency), F.lit(" portal")),
        "kind": F.lit("portal"),
        "program": F.lit(None).cast("string"),
        "cpp": rate,
        "source_points": need,
        "cash_cents": cents,
        "affordable": F.coalesce(balance >= need, F.lit(False)),
        "confidence": points.half_even(fare_confidence, 3),
        "flags": F.array_sort(F.array_distinct(fare_flags)),
    }


def portal_option(requests: DataFrame, verified_fares: DataFrame) -> DataFrame:
    """The portal floor of every request that has a verified fare."""
    fares = verified_fares.select("route_key", "cash_cents", "confidence", "flags")
    fields = portal_fields(
        F.col("currency"), F.col("balance"), F.col("card"), F.col("cash_cents"),
        F.col("confidence"), F.col("flags"),
    )
    return requests.join(fares, "route_key").select(
        "request_id", *[v.alias(k) for k, v in fields.items()]
    )


def transfer_options(paths: DataFrame, verified_fares: DataFrame, requests: DataFrame) -> DataFrame:
    """Priced transfer options: source points, cents per point, affordability."""
    fares = verified_fares.select(
        "route_key", "cash_cents", F.col("confidence").alias("_fare_conf"),
        F.col("flags").alias("_fare_flags"),
    )
    asked = requests.select("request_id", "route_key", "balance")
    need = points.source_points_for_award(F.col("miles"), F.col("ratio"))
    return (
        paths.join(asked, "request_id").join(fares, "route_key")
        .withColumn("source_points", need)
        .select(
            "request_id",
            F.concat(title(F.col("start")), F.lit(" -> "), F.col("hops")).alias("label"),
            F.lit("transfer").alias("kind"), "program",
            points.half_even(
                F.coalesce(points.cents_per_point(F.col("cash_cents"), F.col("source_points")), F.lit(0.0)), 4
            ).alias("cpp"),
            "source_points", "cash_cents",
            F.coalesce(F.col("balance") >= F.col("source_points"), F.lit(False)).alias("affordable"),
            points.half_even(F.col("confidence") * F.col("_fare_conf"), 3).alias("confidence"),
            points.sorted_union(F.col("flags"), F.col("_fare_flags")).alias("flags"),
            "path_ord",
        )
    )


def rank_options(options: DataFrame) -> DataFrame:
    """Add ``rank`` per request: cents per point descending, portal first, then path order."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy(
        F.col("cpp").desc(), F.col("kind"), F.col("path_ord")
    )
    return options.withColumn("rank", F.row_number().over(w))


def two_decimals(value):
    return points.half_even(value, 2).cast("decimal(18,2)").cast("string")


def has_warning(flags, warning_flags=vocab.WARNING_FLAGS):
    return F.exists(flags, lambda f: f.isin(*warning_flags) | f.startswith("sources_disagree"))


def verdict_fields(best, portal_cpp, portal_flags, threshold, warning_flags):
    """Verdict columns from the best affordable transfer (struct or NULL) and the portal."""
    cpp = best.getField("cpp")
    ratio = F.when(portal_cpp > 0, cpp / portal_cpp).otherwise(F.lit(float("inf")))
    none = best.isNull() | cpp.isNull()
    better = points.half_even((ratio - 1) * 100, 0).cast("bigint").cast("string")
    near = str(int(round(threshold * 100)))
    label = (
        F.when(none, "portal_only")
        .when(
            ratio >= 1.0 + threshold,
            F.when(has_warning(best.getField("flags"), warning_flags), "tentative_best").otherwise("best"),
        )
        .when(ratio >= 1.0 - threshold, "comparable")
        .otherwise("portal_only")
    )
    b, p = two_decimals(cpp), two_decimals(portal_cpp)
    rationale = (
        F.when(none, F.concat(F.lit("No verified transfer beats the portal floor ("), p, F.lit("c/pt).")))
        .when(
            ratio >= 1.0 + threshold,
            F.concat(best.getField("label"), F.lit(" returns "), b, F.lit("c/pt against the portal floor of "),
                     p, F.lit("c/pt ("), better, F.lit("% better).")),
        )
        .when(
            ratio >= 1.0 - threshold,
            F.concat(best.getField("label"), F.lit(" ("), b, F.lit(f"c/pt) is within {near}% of the portal floor ("),
                     p, F.lit("c/pt).")),
        )
        .otherwise(F.concat(F.lit("Best transfer ("), b, F.lit("c/pt) is well below the portal floor ("), p, F.lit("c/pt).")))
    )
    return {
        "label": label,
        "best_program": best.getField("program"),
        "best_label": best.getField("label"),
        "best_cpp": cpp,
        "portal_cpp": portal_cpp,
        "rationale": rationale,
        "flags": F.array_sort(F.array_distinct(F.when(none, portal_flags).otherwise(best.getField("flags")))),
    }


def conclude_verdicts(
    options: DataFrame, threshold=vocab.VERDICT_THRESHOLD, warning_flags=vocab.WARNING_FLAGS
) -> DataFrame:
    """One verdict per request from its ranked or unranked options."""
    usable = (F.col("kind") == "transfer") & F.col("affordable") & (F.col("cpp") > 0)
    picked = F.struct((-F.col("cpp")).alias("neg"), "path_ord", "program", "label", "cpp", "flags")
    per = options.groupBy("request_id").agg(
        F.min(F.when(usable, picked)).alias("best"),
        F.max(F.when(F.col("kind") == "portal", F.col("cpp"))).alias("portal"),
        F.max_by("flags", (F.col("kind") == "portal").cast("int")).alias("portal_flags"),
    )
    fields = verdict_fields(F.col("best"), F.col("portal"), F.col("portal_flags"), threshold, warning_flags)
    return per.select("request_id", *[v.alias(k) for k, v in fields.items()])


def filter_options(
    options: DataFrame, verdicts: DataFrame, bonuses_only=False, show_multi_hop=True
) -> DataFrame:
    """Options left after the two display switches, with the headline rate of the request."""
    bonus = F.exists("flags", lambda f: F.contains(f, F.lit("bonus")))
    multi = F.array_contains("flags", "multi_hop")
    shown = F.lit(True) if show_multi_hop else ~multi
    keep = F.when(~bonus, F.col("kind") == "portal").otherwise(shown) if bonuses_only else shown
    head = verdicts.select(
        "request_id",
        F.when(
            F.col("label").isin("best", "tentative_best") & F.col("best_cpp").isNotNull(),
            F.col("best_cpp"),
        ).otherwise(F.coalesce("portal_cpp", F.lit(0.0))).alias("headline_cpp"),
    )
    return options.where(keep).join(head, "request_id")
