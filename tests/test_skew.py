"""One group holding a third of all rows: same results, and no plan that gathers the group."""

import pytest

from awardlake.checks import base, load, views
from tools.compare import compare, duck

SF = "/root/testdata/sf0.01"
QUERIES, _ = load()
HOT = {
    "award_quotes": [
        ("'R' || cast(l_partkey AS varchar(20)) AS route_key", "CASE WHEN l_orderkey % 3 = 0 THEN 'HOT' ELSE 'R' || cast(l_partkey AS varchar(20)) END AS route_key"),
        ("'p' || cast(l_suppkey % 5 AS varchar(20)) AS program", "CASE WHEN l_orderkey % 3 = 0 THEN 'p0' ELSE 'p' || cast(l_suppkey % 5 AS varchar(20)) END AS program"),
    ],
    "fare_quotes": [(views.ANY_PART.format(k="o_orderkey") + " AS route_key", "CASE WHEN o_orderkey % 3 = 0 THEN 'HOT' ELSE " + views.ANY_PART.format(k="o_orderkey") + " END AS route_key")],
    "requests": [(views.ANY_PART.format(k="c_custkey") + " AS route_key", "CASE WHEN c_custkey % 3 = 0 THEN 'HOT' ELSE " + views.ANY_PART.format(k="c_custkey") + " END AS route_key")],
    "award_rows": [("'p' || cast(l_suppkey % 5 AS varchar(20)) AS program", "CASE WHEN l_orderkey % 3 = 0 THEN 'p0' ELSE 'p' || cast(l_suppkey % 5 AS varchar(20)) END AS program")],
    "chart_rows": [("'src' || cast(p_partkey % 4 AS varchar(20)) AS source_name", "CASE WHEN p_partkey % 3 = 0 THEN 'src0' ELSE 'src' || cast(p_partkey % 4 AS varchar(20)) END AS source_name")],
    "probe_log": [("'t' || cast(user_id % 40 AS varchar(20)) AS name", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 't' || cast(user_id % 40 AS varchar(20)) END AS name")],
    "responses": [("'d' || cast(user_id AS varchar(20)) AS domain", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'd' || cast(user_id AS varchar(20)) END AS domain")],
}
NAMES = [
    "verify_awards", "verify_fares", "award_provenance", "quote_requests", "dedupe_freshest", "resolve_award_miles",
    "chart_quotes", "live_award_quotes", "target_health", "adaptive_delay", "independent_source_count",
]


@pytest.fixture(scope="module")
def hot_views():
    plain = dict(base.VIEWS)
    for name, changes in HOT.items():
        for old, new in changes:
            assert old in base.VIEWS[name]
            base.VIEWS[name] = base.VIEWS[name].replace(old, new)
    yield
    base.VIEWS.update(plain)


@pytest.mark.parametrize("name", NAMES)
def test_hot_group(spark, hot_views, name):
    sql = base.expand(base.ORACLES[name], str)
    assert compare(spark, duck(SF), name, QUERIES[name], sql, SF)[2] == "ok"
