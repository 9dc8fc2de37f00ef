"""Paths, options and verdicts end to end on hand-made markets."""

import pytest
from pyspark.sql import functions as F

from awardlake.plans import paths, quotes
from awardlake.sources import catalogue

PARTNERS = "from_currency string, partner string, ratio double, bonus double, valid_from string, valid_until string, label string, trust double, ord long"


def ratio_table(spark, rows, as_of="2024-06-01"):
    return catalogue.flatten_transfer_ratios(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], PARTNERS), as_of)


def market(spark, ratios, awards, fares, hops=2, program_edges=False):
    a = spark.createDataFrame(awards, "route_key string, program string, miles long, confidence double, seats long, flags array<string>")
    f = spark.createDataFrame(fares, "route_key string, cash_cents long, confidence double, flags array<string>, source_name string")
    return quotes.Market(a, f, paths.transfer_paths(ratios, hops, program_edges))


def ask(spark, rows):
    return spark.createDataFrame(rows, "request_id long, route_key string, currency string, balance long, card string")


PLAIN = [("bank", "turkish", 1.0, None, None, None, None, 1.0)]


def test_golden_labels(spark):
    m = market(
        spark, ratio_table(spark, PLAIN),
        [("LAX-IST-business", "turkish", 45000, 0.6, 2, ["live_award_space"]), ("LAX-JFK-economy", "turkish", 15000, 0.6, None, ["no_live_space"])],
        [("LAX-IST-business", 415000, 0.9, [], "f"), ("LAX-JFK-economy", 19500, 0.9, [], "f")],
    )
    asked = ask(spark, [
        (1, "LAX-IST-business", "bank", 90000, "venture_x"), (2, "LAX-IST-business", "bank", 30000, "venture_x"),
        (3, "LAX-JFK-economy", "bank", 20000, "venture_x"), (4, "LAX-JFK-economy", "bank", 10000, "venture_x"),
        (5, "DEN-SEA-economy", "bank", 20000, "venture_x"),
    ])
    got = {r["request_id"]: r for r in quotes.quote_requests(asked, m).verdicts.collect()}
    assert [got[i]["label"] for i in range(1, 6)] == ["best", "portal_only", "comparable", "portal_only", "no_fare"]
    assert got[1]["best_cpp"] == pytest.approx(9.2222) and got[3]["best_cpp"] == pytest.approx(1.3)
    assert "638% better" in got[1]["rationale"]
    assert got[5]["portal_cpp"] is None


def test_warned_winner_is_tentative(spark):
    m = market(spark, ratio_table(spark, PLAIN), [("R", "turkish", 45000, 0.6, None, ["sources_disagree_40%"])], [("R", 415000, 0.9, [], "f")])
    asked = ask(spark, [(1, "R", "bank", 90000, "venture")])
    assert quotes.quote_requests(asked, m).verdicts.first()["label"] == "tentative_best"
    free = quotes.quote_requests(asked, m, warning_flags=("stale",)).verdicts.first()
    assert free["label"] == "tentative_best"  # disagreement always warns


def test_bonus_path_beats_base_path_and_window_is_inclusive(spark):
    offer = [("bank", "turkish", 1.0, 1.3, "2024-05-01", "2024-06-01", None, 1.0)]
    live = ratio_table(spark, offer)
    assert [r["effective_ratio"] for r in live.orderBy("ord").collect()] == [1.0, 1.3]
    assert live.where("is_bonus").first()["bonus_label"] == "+30% transfer bonus"
    assert ratio_table(spark, offer, "2024-06-02").count() == 1
    m = market(spark, live, [("R", "turkish", 45000, 0.6, None, [])], [("R", 415000, 0.9, [], "f")])
    best = quotes.quote_requests(ask(spark, [(1, "R", "bank", 90000, "venture")]), m).options.where("rank = 1").first()
    assert best["source_points"] == 34616 and "transfer_bonus" in best["flags"]
    assert best["label"] == "Bank -> Turkish (+30% transfer bonus)"


def test_unreachable_program_never_becomes_an_option(spark):
    m = market(spark, ratio_table(spark, PLAIN), [("R", "united", 20000, 0.9, 1, []), ("R", "turkish", 45000, 0.6, 1, [])], [("R", 415000, 0.9, [], "f")])
    options = quotes.quote_requests(ask(spark, [(1, "R", "bank", 90000, "venture")]), m).options
    assert {r["program"] for r in options.collect()} == {None, "turkish"}


def chain(spark, n):
    rows = [("bank", "p1", 1.0, None, None, None, None, 0.9)]
    rows += [(f"p{i}", f"p{i + 1}", 0.8, None, None, None, None, 0.9) for i in range(1, n)] + [("p2", "p1", 1.0, None, None, None, None, 1.0)]
    return ratio_table(spark, rows)


def test_paths_are_simple_and_at_most_three_transfers(spark):
    found = paths.transfer_paths(chain(spark, 6), 2, True).where("start = 'bank'")
    assert sorted((r["program"], r["transfers"], round(r["ratio"], 3)) for r in found.collect()) == [("p1", 1, 1.0), ("p2", 2, 0.8), ("p3", 3, 0.64)]
    assert paths.transfer_paths(chain(spark, 6), 2).where("start = 'bank'").count() == 1


def test_multi_hop_flag_and_confidence_never_exceeds_inputs(spark):
    m = market(spark, chain(spark, 3), [("R", "p2", 40000, 0.5, 3, [])], [("R", 200000, 0.8, ["cached_fare"], "f")], program_edges=True)
    best = quotes.quote_requests(ask(spark, [(1, "R", "bank", 60000, "venture")]), m).options.where("kind = 'transfer'").first()
    assert best["flags"] == ["3 seats", "cached_fare", "multi_hop"]
    assert best["source_points"] == 50000 and best["confidence"] == pytest.approx(0.9 * 0.9 * 0.5 * 0.8)


def test_stepwise_operators_agree_with_the_batch_plan(spark):
    ratios = ratio_table(spark, [*PLAIN, ("bank", "ana", 0.75, 1.2, None, None, "offer", 0.9)])
    m = market(spark, ratios, [("R", "turkish", 45000, 0.6, None, ["x"]), ("R", "ana", 44000, 0.7, 4, [])], [("R", 415000, 0.9, ["cached_fare"], "f")])
    asked = ask(spark, [(1, "R", "bank", 90000, "venture"), (2, "R", "bank", 1, "venture_x")])
    moved = paths.transfer_options(paths.enumerate_paths(paths.build_edges(asked, ratios, m.awards)), m.fares, asked)
    floor = paths.portal_option(asked, m.fares).withColumn("path_ord", F.array().cast("array<bigint>"))
    step = paths.rank_options(moved.unionByName(floor))
    batch = quotes.quote_requests(asked, m)
    key = ["request_id", "rank", "label", "cpp", "source_points", "affordable", "confidence", "flags"]
    assert sorted(map(str, step.select(key).collect())) == sorted(map(str, batch.options.select(key).collect()))
    ended = paths.conclude_verdicts(step).select("request_id", "label", "best_cpp", "rationale").collect()
    assert sorted(map(str, ended)) == sorted(map(str, batch.verdicts.select("request_id", "label", "best_cpp", "rationale").collect()))


def test_same_market_different_balances(spark):
    m = market(spark, ratio_table(spark, PLAIN), [("R", "turkish", 45000, 0.6, 1, [])], [("R", 415000, 0.9, [], "f")])
    users = spark.createDataFrame([("rich", "venture_x", {"bank": 90000}), ("poor", "venture", {"bank": 100, "other": 5})], "user_id string, card string, balances map<string,long>")
    routes = spark.createDataFrame([("rich", "R"), ("poor", "R")], "user_id string, route_key string")
    got = {r["request_id"]: r["label"] for r in quotes.quote_portfolios(users, routes, m).verdicts.collect()}
    assert got == {"rich/bank/R": "best", "poor/bank/R": "portal_only", "poor/other/R": "portal_only"}
