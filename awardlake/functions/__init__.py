"""Column expressions, and their registration as SQL functions."""

from awardlake.functions.labels import (  # noqa: F401
    cabin_of, canonicalize_program, canonicalize_region, canonicalize_zone_pair, parse_distance_band,
    parse_miles_cell, parse_source_date, to_bool_token, zone_key,
)
from awardlake.functions.points import (  # noqa: F401
    cents_per_point, compound_ratio, freshness, great_circle_miles, normalize_one_way,
    portal_cpp_of, portal_points_needed, route_key, source_points_for_award, transfer_cpp,
    within_bounds, fare_within_bounds,
)
from awardlake.functions.text import digit_runs, looks_undecoded, number_is_grounded  # noqa: F401

SQL_FUNCTIONS = {
    "route_key": "(o STRING, d STRING, c STRING) RETURNS STRING "
    "RETURN concat_ws('-', upper(o), upper(d), c)",
    "cents_per_point": "(cents BIGINT, points BIGINT) RETURNS DOUBLE "
    "RETURN CASE WHEN points > 0 THEN cents / points ELSE 0D END",
    "portal_points_needed": "(cents BIGINT, rate DOUBLE) RETURNS BIGINT "
    "RETURN CASE WHEN rate > 0 THEN CAST(ceil(cents / rate) AS BIGINT) END",
    "source_points_for_award": "(miles BIGINT, ratio DOUBLE) RETURNS BIGINT "
    "RETURN CASE WHEN ratio > 0 THEN CAST(ceil(miles / ratio) AS BIGINT) END",
    "great_circle_miles": "(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE "
    "RETURN 2 * 3958.7613D * asin(least(1D, sqrt(pow(sin((radians(c) - radians(a)) / 2), 2) "
    "+ cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2))))",
    "to_bool_token": "(v STRING) RETURNS BOOLEAN "
    "RETURN coalesce(lower(trim(v)) IN ('1','true','yes','y','rt','roundtrip'), false)",
}


def register_sql_functions(spark):
    """Make the pure-expression functions callable from SQL text, without Python per row."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(SQL_FUNCTIONS)
