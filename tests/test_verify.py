"""Verification rules on small tables, and against a brute-force count with hot groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from awardlake.operators import quality, ranking, verify

NOW = "2024-06-01T00:00:00Z"
SCHEMA = (
    "route_key string, program string, cabin string, miles bigint, seats bigint, source_name string, "
    "trust double, confidence double, source_updated_at timestamp, fetched_at timestamp, flags array<string>, ord bigint"
)


def quote(spark, rows):
    """(program, miles, source, trust, confidence, date, flags, seats) tuples as quotes of one route."""
    data = [
        ("LAX-IST-business", p, "business", m, seats, s, t, c, d, "2024-05-30", f, i)
        for i, (p, m, s, t, c, d, f, seats) in enumerate(rows)
    ]
    text = SCHEMA.replace("timestamp", "string")
    df = spark.createDataFrame(data, text)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("source_updated_at", "fetched_at")})


CHART, LIVE = ["no_live_space"], ["live_award_space"]


def one(spark, rows):
    return {r["program"]: r for r in verify.verify_awards(quote(spark, rows), NOW).collect()}


def test_live_quote_displaces_chart(spark):
    got = one(spark, [("turkish", 45000, "chart", 0.9, 0.9, "2024-06-01", CHART, None), ("turkish", 50000, "net", 0.6, 0.6, "2024-06-01", LIVE, 2)])["turkish"]
    assert (got["miles"], got["seats"], got["confidence"]) == (50000, 2, 0.6)
    assert got["flags"] == ["live_award_space", "single_source"]


def test_two_sources_give_weighted_median_and_disagreement(spark):
    got = one(spark, [("a", 40000, "s1", 0.5, 0.8, "2024-06-01", CHART, None), ("a", 60000, "s2", 0.9, 0.6, "2024-06-01", CHART, None)])["a"]
    assert got["miles"] == 60000 and got["confidence"] == pytest.approx(0.48)
    assert got["flags"] == ["no_live_space", "sources_disagree_33%"]


def test_agreeing_sources_keep_confidence(spark):
    got = one(spark, [("a", 60000, "s1", 0.5, 0.8, "2024-06-01", CHART, None), ("a", 62000, "s2", 0.9, 0.6, "2024-06-01", CHART, None)])["a"]
    assert got["miles"] == 62000 and got["confidence"] == 0.8 and got["flags"] == ["no_live_space"]


def test_two_rows_of_one_source_stay_single(spark):
    got = one(spark, [("a", 60000, "s1", 0.5, 0.8, "2024-06-01", CHART, None), ("a", 90000, "s1", 0.5, 0.9, "2024-06-01", CHART, None)])["a"]
    assert (got["miles"], got["confidence"]) == (90000, 0.7) and "single_source" in got["flags"]


def test_stale_unsourced_and_implausible(spark):
    got = one(
        spark,
        [
            ("old", 60000, "s1", 0.9, 0.9, "2021-01-01", LIVE, 1), ("ghost", 60000, "unknown", 0.9, 0.9, "2024-06-01", LIVE, 1),
            ("tiny", 5, "s1", 0.99, 0.99, "2024-06-01", LIVE, 1),
        ],
    )
    assert set(got) == {"old"} and "stale" in got["old"]["flags"] and got["old"]["confidence"] == 0.0


def test_half_life(spark):
    got = one(spark, [("a", 60000, "s1", 0.9, 0.6, "2024-04-02", CHART, None)])["a"]
    assert got["confidence"] == pytest.approx(0.3)


def lower_median(values):
    total, acc = sum(w for _, w in values), 0.0
    for v, w in sorted(values):
        acc += w
        if acc >= total / 2:
            return v


def test_hot_group_matches_brute_force(spark):
    """A third of all rows in one group; trust in sixteenths keeps plain sums exact."""
    rng = random.Random(7)
    groups = ["hot"] * 10 + [f"g{i}" for i in range(20)]
    rows = [
        (rng.choice(groups), rng.randrange(10, 60) * 1000.0, f"s{rng.randrange(4)}", rng.randrange(1, 16) / 16) for _ in range(6000)
    ]
    df = spark.createDataFrame(rows, "k string, value double, source_name string, weight double")
    expect = defaultdict(list)
    for k, v, _, w in rows:
        expect[k].append((v, w))
    got = {r["k"]: r["weighted_median"] for r in verify.trust_weighted_median(df, ["k"]).collect()}
    assert got == {k: lower_median(v) for k, v in expect.items()}
    spread = {r["k"]: r["relative_spread"] for r in verify.relative_spread(df, ["k"]).collect()}
    for k, v in expect.items():
        vals = sorted(x for x, _ in v)
        assert spread[k] == pytest.approx((vals[-1] - vals[0]) / vals[len(vals) // 2])


def test_median_ignores_weightless_rows_and_floors_tiny_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 1e-9), ("a", 3.0, 1e-9), ("b", 5.0, -1.0)], "k string, value double, weight double")
    assert [tuple(r) for r in verify.trust_weighted_median(df, ["k"]).collect()] == [("a", 2.0)]


def test_poison_quotes(spark):
    plants = [
        ("turkish", 5, "blog", 0.99, 0.99, "2024-06-01", LIVE, 1), ("lifemiles", 25000, "unknown", 0.99, 0.99, "2024-06-01", LIVE, 1),
        ("aeroplan", 60000, "mirror", 0.99, 0.99, "2021-01-01", LIVE, 1), ("turkish", 45000, "net", 0.6, 0.6, "2024-06-01", LIVE, 2),
    ]
    expect = F.element_at(F.array(*[F.lit(x) for x in ("rejected", "rejected", "flagged_stale", "survives_clean")]), (F.col("ord") + 1).cast("int"))
    df = quote(spark, plants).withColumns({"plant": F.col("ord").cast("string"), "expect": expect})
    assert all(r["ok"] for r in quality.poison_check(df, NOW).collect())


def test_freshest_row_keeps_first_on_ties(spark):
    df = spark.createDataFrame(
        [("s", "p", "A", "B", "c", 1, "2024-01-01", 0), ("s", "p", "A", "B", "c", 2, "2024-01-01", 1), ("s", "p", "A", "B", "c", 3, "soon", 2)],
        "source_name string, program string, origin string, dest string, cabin string, miles long, updated_at string, ord long",
    )
    assert ranking.dedupe_freshest(df).first()["miles"] == 1


def test_flags_are_no_collected_set_of_the_wide_step(spark):
    rows = [("a", 40000 + 1000 * (i % 3), f"s{i % 2}", 0.5, 0.8, "2024-06-01", [f"f{i % 4}", "no_live_space"], None) for i in range(12)]
    df = verify.verify_awards(quote(spark, rows), NOW)
    assert df.first()["flags"] == ["f0", "f1", "f2", "f3", "no_live_space"]
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "collect_set(" in text and not [x for x in text.split("\n") if "collect_set(" in x and "miles" in x.split("functions=")[0]]
