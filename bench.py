"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES (comma separated, or ``all``) other queries. Each query runs once to warm up and once
timed, into the noop sink, so that every row and column is computed.
"""

import json
import os
import sys
import time

HEADLINE = (
    "verify_awards verify_fares trust_weighted_median quote_requests rank_options conclude_verdicts "
    "resolve_award_miles chart_quotes live_award_quotes dedupe_freshest extract_html_tables "
    "parse_chart_wide parse_chart_long parse_zone_matrix extract_price_claims find_price_mentions "
    "digit_runs html_pages_to_text extract_links canonicalize_region score_extraction target_health "
    "classify_fetch_blocks federate_fallback adaptive_delay classify_cache_hits "
    "enumerate_paths build_edges place_search audit_verdicts_planted follow_mail "
    "quote_stored_market dedupe_items_ttl parse_chart_documents"
).split()


def session(cpus):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("awardlake-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(fn, spark, sf_dir):
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from awardlake.checks import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = load()[0]
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = session(cpus)
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(queries[name], spark, sf_dir), 3)
        warm[name] = round(run(queries[name], spark, sf_dir), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:32s} cold {cold[name]:7.2f} warm {warm[name]:7.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
