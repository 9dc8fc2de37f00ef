"""Physical-plan properties that matter at scale."""

import pytest

from awardlake.checks import load
from awardlake.checks.base import Data
from awardlake.operators import claims

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()
# Building these runs streams to their end, which the oracle tests already do.
BATCH = sorted(n for n in QUERIES if "stream" not in n and n not in ("incremental_discovery", "append_history"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["trust_weighted_median"](spark, SF))
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "l_suppkey" in schema and "l_extendedprice" in schema and "l_shipdate" not in schema


def test_filters_reach_the_scan(spark):
    d = Data(spark, SF)
    from awardlake.operators import verify

    text = plan(verify.trust_weighted_median(d.table("lineitem").where("l_quantity > 10"), ["l_suppkey"], "l_extendedprice", "l_quantity"))
    assert "GreaterThan(l_quantity,10.0)" in text


def test_html_parser_runs_once_per_page(spark):
    assert plan(QUERIES["extract_html_tables"](spark, SF)).count("ArrowEvalPython") == 1
    assert plan(QUERIES["extract_price_claims"](spark, SF)).count("ArrowEvalPython") == 1


def test_claims_are_not_broadcast_to_their_documents(spark):
    docs = spark.range(50).selectExpr(
        "id AS doc_id", "'Book LifeMiles business class from London to Tokyo for 45,000 miles.' AS text",
        "'email' AS intake", "concat('email:', id) AS origin", "'u' AS url", "'2024-01-01' AS published",
    )
    for creators in (None, spark.sql("SELECT 'creator 0' AS name, 0.2D AS trust")):
        out = claims.attach_discovery_provenance(claims.extract_price_claims(docs), docs, creators).select("doc_id", "source_name", "trust")
        for _ in range(2):  # the second plan is the one that AQE ended with, by the sizes that it met
            joins = [line for line in plan(out).splitlines() if "Join" in line and "doc_id" in line]
            assert joins and all("SortMergeJoin" in line for line in joins)
            assert out.count() == len(out.collect()) == 50
