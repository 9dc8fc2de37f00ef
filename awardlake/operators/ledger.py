"""Call ledgers and fetch statistics."""

from pyspark.sql import DataFrame, functions as F


def quota_ledger(fetch_events: DataFrame, providers: DataFrame, warn_below=0.2) -> DataFrame:
    """Calls per provider and month against the monthly limit.

    A call is a cache miss that came back, also with zero quotes; hits and skips cost nothing.
    """
    used = (
        fetch_events.where(~F.col("cache_hit") & ~F.col("skipped"))
        .groupBy("provider", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("used"))
    )
    limits = providers.select(F.col("name").alias("provider"), F.col("monthly_quota").cast("bigint").alias("monthly_quota"))
    left = F.when(
        F.col("monthly_quota").isNotNull(), F.greatest(F.lit(0), F.col("monthly_quota") - F.col("used"))
    ).cast("bigint")
    return used.join(limits, "provider", "left").withColumn("remaining", left).withColumn(
        "low", F.coalesce(F.col("remaining") < F.col("monthly_quota") * warn_below, F.lit(False))
    )


def federation_stats(fetch_events: DataFrame) -> DataFrame:
    """Hits, misses, skips by reason and quotes per provider and layer."""
    skipped = lambda reason: F.count_if(F.col("skipped") & (F.col("skip_reason") == reason))
    return fetch_events.groupBy("provider", "layer").agg(
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit") & ~F.col("skipped")).alias("cache_misses"),
        skipped("quota").alias("quota_skips"),
        skipped("rate_limit").alias("rate_skips"),
        skipped("locked").alias("lock_skips"),
        skipped("error").alias("errors"),
        F.sum("quotes").alias("quotes"),
    )
