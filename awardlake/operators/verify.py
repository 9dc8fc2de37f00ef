"""Verification of quotes: bounds, freshness, live precedence, trust-weighted cross-check.

Groups may be arbitrarily hot, so every reduction is first done per (group, miles, flags) with map-side
partial aggregation; miles lie in fixed plausible bounds and flag arrays are few, which limits what one
group can hold before the ordered part of the median runs. Flags are a key and not a collected set, so
that this wide step needs no object aggregate. Trust weights are summed as whole millionths: the
sum is exact and does not depend on the order in which partitions arrive.
"""

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions import points

GROUP = ["route_key", "program"]
WEIGHT_UNITS = 1_000_000
MIN_WEIGHT = 1e-6


def _units(weight):
    return F.greatest(F.lit(1), F.round(weight * WEIGHT_UNITS)).cast("bigint")


def _median_columns(df, keys, value):
    """Add running weight/count and totals, ordered by value, to one row per (keys, value)."""
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return df.select(
        "*",
        F.sum("_w").over(run).alias("_cum_w"),
        F.sum("_w").over(whole).alias("_all_w"),
        F.sum("_n").over(run).alias("_cum_n"),
        F.sum("_n").over(whole).alias("_all_n"),
    )


def _per_value(df, keys, value, weight):
    """One row per (keys, value) with its weight and count; spreads a hot group over tasks."""
    return df.groupBy(*keys, value).agg(
        F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n")
    )


def _weighted_median(value):
    return F.min(F.when(F.col("_cum_w") * 2 >= F.col("_all_w"), F.col(value)))


def _spread(value):
    upper = F.min(F.when(F.col("_cum_n") * 2 > F.col("_all_n"), F.col(value)))
    middle = F.abs(F.when(upper == 0, F.lit(1.0)).otherwise(upper))
    return F.when(F.max("_all_n") <= 1, F.lit(0.0)).otherwise(
        (F.max(value) - F.min(value)) / middle
    )


def trust_weighted_median(df: DataFrame, keys, value="value", weight="weight") -> DataFrame:
    """Lower weighted median per key; weights at or below zero are ignored."""
    usable = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    per = _per_value(usable, keys, value, _units(F.col(weight)))
    return _median_columns(per, keys, value).groupBy(*keys).agg(
        _weighted_median(value).alias("weighted_median")
    )


def relative_spread(df: DataFrame, keys, value="value") -> DataFrame:
    """(max - min) / upper median per key; 0 for a single value."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    per = _per_value(usable, keys, value, F.lit(1))
    return _median_columns(per, keys, value).groupBy(*keys).agg(
        _spread(value).alias("relative_spread")
    )


def independent_source_count(quotes: DataFrame, keys=GROUP) -> DataFrame:
    """Number of different sources per group."""
    return (
        quotes.groupBy(*keys, "source_name").agg(F.count(F.lit(1)))
        .groupBy(*keys).agg(F.count("source_name").alias("sources"))
    )


def usable_quotes(quotes, now, half_life_days, stale_after_days):
    """Sourced, in-bounds quotes with decayed confidence, stale mark and live mark."""
    fresh = points.freshness(
        F.col("confidence"), F.col("source_updated_at"), F.col("fetched_at"), now,
        half_life_days, stale_after_days,
    )
    return (
        quotes.where(
            F.col("source_name").isNotNull()
            & (F.col("source_name") != "unknown")
            & points.within_bounds(F.col("cabin"), F.col("miles"))
        )
        .withColumn("_fresh", fresh)
        .withColumn("_live", ~F.array_contains("flags", "no_live_space"))
    )


def verify_awards(
    quotes: DataFrame,
    now,
    half_life_days=vocab.HALF_LIFE_DAYS,
    stale_after_days=vocab.STALE_AFTER_DAYS,
    spread_threshold=vocab.SPREAD_THRESHOLD,
) -> DataFrame:
    """One reconciled price per (route_key, program).

    Live quotes displace chart quotes; two or more sources give the trust-weighted median, a
    single source its most confident quote. The used quotes themselves are listed by
    :func:`award_provenance`, one row each, instead of in an array of unlimited length.
    """
    usable = usable_quotes(quotes, now, half_life_days, stale_after_days)
    keys = [*GROUP, "_live"]
    per_value = usable.groupBy(*keys, "miles", "flags").agg(
        F.sum(_units(F.col("trust"))).alias("_w"),
        F.count(F.lit(1)).alias("_n"),
        F.min("source_name").alias("_src_lo"),
        F.max("source_name").alias("_src_hi"),
        F.max("_fresh.confidence").alias("_conf"),
        F.min(F.struct(-F.col("_fresh.confidence"), F.col("ord"), F.col("miles"))).alias("_best"),
        F.max("seats").alias("_seats"),
        F.max("_fresh.stale").alias("_stale"),
    )
    by_group = per_value.repartition(*GROUP)
    merged = _median_columns(by_group, keys, "miles").groupBy(*keys).agg(
        _weighted_median("miles").alias("_median"),
        _spread("miles").alias("_spread"),
        F.min("_src_lo").alias("_src_lo"),
        F.max("_src_hi").alias("_src_hi"),
        F.max("_conf").alias("_conf"),
        F.min("_best").alias("_best"),
        F.max("_seats").alias("seats"),
        F.max("_stale").alias("_stale"),
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("_flags"),
    )
    winner = merged.groupBy(*GROUP).agg(
        F.max_by(F.struct(*[c for c in merged.columns if c not in GROUP]), "_live").alias("g")
    ).select(*GROUP, "g.*")
    several = F.col("_src_lo") != F.col("_src_hi")
    disagree = several & (F.col("_spread") > spread_threshold)
    percent = points.half_even(F.col("_spread") * 100, 0).cast("bigint").cast("string")
    confidence = (
        F.when(disagree, F.col("_conf") * 0.6)
        .when(several, F.col("_conf"))
        .otherwise(F.least(F.col("_conf"), F.lit(0.7)))
    )
    return winner.select(
        *GROUP,
        F.when(several, F.col("_median")).otherwise(F.col("_best.miles"))
        .cast("bigint").alias("miles"),
        points.half_even(confidence, 3).alias("confidence"),
        "seats",
        points.sorted_union(
            F.array_remove("_flags", "no_live_space"),
            points.optional_flag(~F.col("_live"), "no_live_space"),
            points.optional_flag(F.col("_stale"), "stale"),
            points.optional_flag(
                disagree, F.concat(F.lit("sources_disagree_"), percent, F.lit("%"))
            ),
            points.optional_flag(~several, "single_source"),
        ).alias("flags"),
    )


def award_provenance(
    quotes: DataFrame,
    now,
    half_life_days=vocab.HALF_LIFE_DAYS,
    stale_after_days=vocab.STALE_AFTER_DAYS,
) -> DataFrame:
    """The quotes each verified award rests on, one row per quote."""
    usable = usable_quotes(quotes, now, half_life_days, stale_after_days)
    live = usable.groupBy(*GROUP).agg(F.max("_live").alias("_any_live"))
    return (
        usable.join(live, GROUP)
        .where(F.col("_live") == F.col("_any_live"))
        .select(
            *GROUP, "miles", "source_name", "trust", "source_updated_at",
            F.col("_fresh.confidence").alias("decayed_confidence"),
            F.col("_fresh.stale").alias("stale"),
        )
    )


def verify_fares(
    fares: DataFrame,
    now,
    half_life_days=vocab.HALF_LIFE_DAYS,
    stale_after_days=vocab.STALE_AFTER_DAYS,
) -> DataFrame:
    """The most trustworthy plausible fare per route; no row where there is none."""
    fresh = points.freshness(
        F.col("confidence"), F.col("source_updated_at"), F.col("fetched_at"), now,
        half_life_days, stale_after_days,
    )
    usable = fares.where(
        F.col("source_name").isNotNull()
        & (F.col("source_name") != "unknown")
        & points.fare_within_bounds(F.col("cash_cents"))
    ).withColumn("_fresh", fresh)
    best = usable.groupBy("route_key").agg(
        F.min(
            F.struct(
                (-F.col("_fresh.confidence")).alias("neg"), F.col("ord"), F.col("cash_cents"),
                F.col("source_name"), F.col("flags"), F.col("_fresh.stale").alias("stale"),
            )
        ).alias("b")
    )
    return best.select(
        "route_key",
        "b.cash_cents",
        points.half_even(-F.col("b.neg"), 3).alias("confidence"),
        points.sorted_union(
            F.col("b.flags"), points.optional_flag(F.col("b.stale"), "stale")
        ).alias("flags"),
        "b.source_name",
    )
