"""A stored market: its sides stay in place, and audits read what was written once."""

import re

from pyspark.sql import functions as F

from awardlake.checks import load
from awardlake.checks.base import Data
from awardlake.checks.plan_checks import market
from awardlake.plans import quotes

SF = "/root/testdata/sf0.001"
QUERIES = load()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_dealt_to_a_market_that_stays_in_place(spark):
    d = Data(spark, SF)
    stored = quotes.stored_market(market(d))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(quotes.quote_requests(d.view("requests"), stored).verdicts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Bucketed: true") >= 2 and "FileScan parquet spark_catalog.default.awardlake_fares" in text
    # paths are joined by programme, for which the awards move where that table can't be broadcast
    for line, after in zip(text.split("\n"), text.split("\n")[1:]):
        assert not ("Exchange hashpartitioning(route_key" in line and "awardlake_fares" in after)
    small = plan(quotes.quote_requests(d.view("requests"), stored).verdicts).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", small)) <= 1, small


def test_audits_read_few_tables(spark):
    text = plan(QUERIES["audit_verdicts_planted"](spark, SF))
    assert len(re.findall("FileScan", text.split("== Initial Plan ==")[-1])) <= 15


def small_tables(spark, path):
    """Rows of its own: 12 parts, three quotes each, orders and customers."""
    at = "timestamp '1999-01-01 00:00:00'"
    for name, sql in {
        "region": "SELECT id AS r_regionkey, element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'), cast(id + 1 AS int)) AS r_name FROM range(5)",
        "nation": "SELECT cast(id AS int) AS n_nationkey, cast(id % 5 AS int) AS n_regionkey FROM range(25)",
        "part": "SELECT id AS p_partkey FROM range(12)",
        "customer": "SELECT id AS c_custkey, 9000.0D AS c_acctbal, element_at(array('AUTOMOBILE', 'BUILDING', 'FURNITURE'), cast(id % 3 + 1 AS int)) AS c_mktsegment FROM range(9)",
        "orders": f"SELECT id AS o_orderkey, id AS o_custkey, 4000.0D + id AS o_totalprice, {at} AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(11)",
        "lineitem": f"SELECT id AS l_orderkey, id % 12 AS l_partkey, id % 7 AS l_suppkey, cast(id % 3 AS int) AS l_linenumber, 2.0D AS l_quantity, 20000.0D + 700 * (id % 5) AS l_extendedprice, 0.05D AS l_discount, element_at(array('O', 'F'), cast(id % 2 + 1 AS int)) AS l_linestatus, {at} AS l_shipdate FROM range(36)",
    }.items():
        spark.sql(sql).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def scans(df, text):
    return plan(df).split("== Initial Plan ==")[-1].count(text)


def test_awards_verified_once_make_the_same_market(spark, tmp_path):
    from awardlake.checks.verify_checks import verified_awards

    d = Data(spark, small_tables(spark, tmp_path))
    again, once = market(d), market(d, verified_awards(d))
    for a, b in zip(again, once):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []


def test_golden_cases_verify_no_quote_twice(spark, tmp_path):
    # the verified awards are written once; verdicts and cases read that table
    path = small_tables(spark, tmp_path)
    assert scans(QUERIES["golden_cases"](spark, path), "l_extendedprice") == 0


def test_a_stream_of_requests_leaves_the_market_in_its_buckets(spark, tmp_path, monkeypatch):
    from awardlake.checks import stream_checks

    kept, real = [], stream_checks.jobs.requote_stream
    monkeypatch.setattr(stream_checks.jobs, "requote_stream", lambda s, m, *rest: kept.append(m) or real(s, m, *rest))
    path = small_tables(spark, tmp_path)
    assert QUERIES["requote_stream"](spark, path).count() == 9
    assert "awardlake_awards" in plan(kept[0].awards) and "awardlake_fares" in plan(kept[0].fares)


def test_no_side_of_a_market_is_dealt_by_its_few_programmes(spark, tmp_path):
    # where the catalogue can't be broadcast, a join by programme would read all quotes in one task a programme
    from awardlake.checks.verify_checks import verified_awards

    d = Data(spark, small_tables(spark, tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for built in (market(d), market(d, verified_awards(d))):
            for line, below in re.findall(r"Exchange hashpartitioning\(program#\d+, \d+\)(.*)\n(.*(?:\n.*){0,12})", plan(built.awards)):
                assert "l_extendedprice" not in below and "route_key" not in below, below
            programs = {r["program"] for r in built.awards.select("program").collect()}
            assert programs == {r["program"] for r in built.paths.select("program").collect()} != set()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_programmes_out_of_reach_or_null_have_no_market(spark):
    schema = "route_key string, program string, cabin string, miles bigint, seats bigint, source_name string, trust double, confidence double, " \
        "source_updated_at timestamp, fetched_at timestamp, flags array<string>, ord bigint"
    row = lambda program, i: ("r", program, "economy", 20000, None, "s", 1.0, 1.0, None, None, [], i)
    awards = spark.createDataFrame([row("p0", 1), row("p9", 2), row(None, 3)], schema)
    fares = spark.createDataFrame([], "route_key string, cash_cents bigint, source_name string, confidence double, source_updated_at timestamp, "
                                      "fetched_at timestamp, flags array<string>, ord bigint")
    ratios = "from_currency string, to_program string, ratio double, bonus_multiplier double, effective_ratio double, bonus_label string, " \
        "confidence double, ord bigint, is_bonus boolean"
    for some, reached in (([("AFRICA", "p0", 1.0, 1.0, 1.0, None, 0.9, 0, False)], ["p0"]), ([], [])):
        built = quotes.build_market(awards, fares, spark.createDataFrame(some, ratios), "2000-01-01T00:00:00Z")
        assert [r["program"] for r in built.awards.collect()] == reached


def test_options_deal_no_awards_by_their_few_programmes(spark, tmp_path):
    d = Data(spark, small_tables(spark, tmp_path))
    built = market(d)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        offers = quotes.market_options(built)
        # a join of awards with paths by programme would be a shuffle of both sides by it
        main = plan(offers).split("Subqueries")[0]
        assert "l_extendedprice" in main and "hashpartitioning(route_key" in main
        assert not re.findall(r"Join \[program#\d+\], \[program#\d+\]", main), main
        # the same rows as that join gives
        pairs = built.awards.join(built.fares.select("route_key"), "route_key").join(built.paths, "program")
        want = pairs.groupBy("route_key", F.col("start").alias("currency")).agg(F.sort_array(F.collect_list("path_ord")).alias("paths"))
        got = offers.select("route_key", "currency", F.sort_array(F.transform("offers", lambda o: o["path_ord"])).alias("paths"))
        assert got.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_without_programme_or_with_none_at_all_give_no_options(spark):
    awards = spark.createDataFrame([("r", "p0", 20000, 0.5, None, ["x"]), ("r", None, 20000, 0.5, None, [])],
                                   "route_key string, program string, miles long, confidence double, seats long, flags array<string>")
    fares = spark.createDataFrame([("r", 40000, 0.5, [])], "route_key string, cash_cents long, confidence double, flags array<string>")
    schema = "start string, program string, ratio double, confidence double, flags array<string>, hops string, path_ord array<long>, transfers int"
    way = lambda program, i: ("AFRICA", program, 1.0, 0.5, [], "hop", [i], 1)
    for ways, offered in (([way("p0", 1), way("p0", 1), way(None, 2), way("p9", 3)], [2]), ([way(None, 2)], []), ([], [])):
        built = quotes.Market(awards, fares, spark.createDataFrame(ways, schema))
        assert [len(r["offers"]) for r in quotes.market_options(built).collect()] == offered
