"""Column expressions for miles, points, money, distance and freshness."""

from functools import reduce

from pyspark.sql import Column, functions as F

from awardlake import vocab
from awardlake.functions.labels import lookup

EARTH_RADIUS_MILES = 3958.7613
DAY_SECONDS = 86400.0


def half_even(value: Column, digits=0) -> Column:
    """Round a double half to even on its binary value."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale if digits else F.rint(value)


def instant(value) -> Column:
    """A point in time given as Column, ISO text with offset, or datetime."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def normalize_one_way(miles: Column, roundtrip: Column) -> Column:
    """struct<miles,flags>: round-trip prices halved (rounded up) and flagged."""
    rt = F.coalesce(roundtrip, F.lit(False))
    return F.struct(
        F.when(rt, F.ceil(miles / 2)).otherwise(miles).cast("bigint").alias("miles"),
        F.when(rt, F.array(F.lit("rt_to_ow_normalized")))
        .otherwise(F.array().cast("array<string>"))
        .alias("flags"),
    )


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in statute miles."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def route_key(origin: Column, dest: Column, cabin: Column) -> Column:
    """``ORIGIN-DEST-cabin``."""
    return F.concat_ws("-", F.upper(origin), F.upper(dest), cabin)


def cents_per_point(cents: Column, points: Column) -> Column:
    """Cents of value per point, 0 when no points are spent."""
    return F.when(points > 0, cents / points).otherwise(F.lit(0.0))


def portal_points_needed(cents: Column, portal_cpp: Column) -> Column:
    """Points that cover a fare at the portal rate; NULL stands for 'never'."""
    return F.when(portal_cpp > 0, F.ceil(cents / portal_cpp).cast("bigint"))


def source_points_for_award(miles: Column, ratio: Column) -> Column:
    """Source points that buy ``miles`` at ``ratio``; NULL stands for 'never'."""
    return F.when(ratio > 0, F.ceil(miles / ratio).cast("bigint"))


def transfer_cpp(cents: Column, miles: Column, ratio: Column) -> Column:
    """Cents per source point of one transfer redemption."""
    return cents_per_point(cents, source_points_for_award(miles, ratio))


def compound_ratio(ratios: Column) -> Column:
    """Product of an array of transfer ratios."""
    return F.aggregate(ratios, F.lit(1.0), lambda acc, r: acc * r)


def age_days(updated: Column, fetched: Column, now) -> Column:
    """Age in days of a datum, from its own date else its fetch time, never negative."""
    basis = F.coalesce(updated, fetched)
    micros = F.unix_micros(instant(now)) - F.unix_micros(basis)
    return F.greatest(F.lit(0.0), micros / F.lit(1_000_000 * DAY_SECONDS))


def decayed_confidence(confidence: Column, age: Column, half_life_days=vocab.HALF_LIFE_DAYS):
    """Confidence halved every ``half_life_days``, kept in [0, 1]."""
    decay = F.pow(F.lit(0.5), age / half_life_days) if half_life_days > 0 else F.lit(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * decay))


def freshness(
    confidence: Column,
    updated: Column,
    fetched: Column,
    now,
    half_life_days=vocab.HALF_LIFE_DAYS,
    stale_after_days=vocab.STALE_AFTER_DAYS,
) -> Column:
    """struct<age_days, confidence, stale>."""
    age = age_days(updated, fetched, now)
    return F.struct(
        age.alias("age_days"),
        decayed_confidence(confidence, age, half_life_days).alias("confidence"),
        (age > stale_after_days).alias("stale"),
    )


def within_bounds(cabin: Column, miles: Column) -> Column:
    """True when a one-way price is plausible for its cabin (limits inclusive)."""
    ok = [
        F.when(cabin == c, miles.between(lo, hi)) for c, (lo, hi) in vocab.AWARD_BOUNDS.items()
    ]
    return F.coalesce(*ok, miles.between(*vocab.ANY_CABIN_BOUNDS), F.lit(False))


def fare_within_bounds(cents: Column) -> Column:
    """True when a cash fare is plausible (limits inclusive)."""
    return F.coalesce(cents.between(*vocab.FARE_BOUNDS_CENTS), F.lit(False))


def portal_cpp_of(card: Column) -> Column:
    """Portal rate of a card product."""
    return F.coalesce(lookup(vocab.PORTAL_CPP, card).cast("double"), F.lit(vocab.DEFAULT_PORTAL_CPP))


def has_flag(flags: Column, *names: str) -> Column:
    """True when any of ``names`` is among ``flags``."""
    return reduce(lambda a, b: a | b, [F.array_contains(flags, n) for n in names])


def sorted_union(*flag_arrays: Column) -> Column:
    """Distinct flags of several arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*flag_arrays))))


def optional_flag(condition: Column, name) -> Column:
    """[name] when the condition holds, else []."""
    value = F.lit(name) if isinstance(name, str) else name
    return F.when(condition, F.array(value)).otherwise(F.array().cast("array<string>"))
