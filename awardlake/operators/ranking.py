"""Best-of and ranking operators: ratios, cabins, award rows, providers."""

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions.labels import parse_source_date


def best_ratio_per_program(ratios: DataFrame, keys=("from_currency", "to_program")) -> DataFrame:
    """Per key the ratio with the highest (confidence, effective ratio); the first on ties."""
    rest = [c for c in ratios.columns if c not in keys]
    order = F.struct(-F.col("confidence"), -F.col("effective_ratio"), F.col("ord"))
    best = ratios.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select(*keys, "b.*")


def cabins_available(chart_rows: DataFrame) -> DataFrame:
    """Valid cabins of each programme's chart."""
    return (
        chart_rows.where(F.col("cabin").isin(*vocab.CABINS))
        .groupBy("program").agg(F.array_sort(F.collect_set("cabin")).alias("cabins"))
    )


def reachable_awards(awards: DataFrame, ratios: DataFrame, currency=None) -> DataFrame:
    """Awards of programmes the currency has a transfer row for; absence means unreachable."""
    rows = ratios if currency is None else ratios.where(F.col("from_currency") == currency)
    return awards.join(rows.select(F.col("to_program").alias("program")), "program", "left_semi")


def unreachable_awards(awards: DataFrame, ratios: DataFrame, currency=None) -> DataFrame:
    """The awards :func:`reachable_awards` leaves out."""
    rows = ratios if currency is None else ratios.where(F.col("from_currency") == currency)
    return awards.join(rows.select(F.col("to_program").alias("program")), "program", "left_anti")


def dedupe_freshest(
    award_rows: DataFrame, keys=("source_name", "program", "origin", "dest", "cabin"),
    ts="updated_at", order="ord",
) -> DataFrame:
    """Freshest row per key; an unreadable date loses, the first row wins ties.

    A plain aggregate with map-side combine, so a key that holds much of the data is reduced
    before it is shuffled.
    """
    rest = [c for c in award_rows.columns if c not in keys]
    freshness = F.coalesce(-F.unix_micros(parse_source_date(F.col(ts))), F.lit(2**62))
    best = award_rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(freshness, F.col(order))).alias("b")
    )
    return best.select(*keys, "b.*")


def provider_ranking(providers: DataFrame, ledger: DataFrame = None) -> DataFrame:
    """Eligible providers per layer by layer trust, with their quota state.

    ``providers``: name, trust, layers array, layer_trust map, health, disabled, monthly_quota,
    reg_ord; ``ledger``: provider, used.
    """
    layered = providers.select("*", F.explode("layers").alias("layer")).withColumn(
        "effective_trust",
        F.coalesce(F.try_element_at("layer_trust", F.col("layer")), F.col("trust")),
    )
    w = Window.partitionBy("layer").orderBy(F.desc("effective_trust"), "reg_ord")
    ranked = layered.where(~F.col("disabled") & (F.col("health") != "down")).withColumn(
        "position", F.row_number().over(w)
    )
    if ledger is not None:
        used = ledger.select(F.col("provider").alias("name"), "used")
        ranked = ranked.join(used, "name", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    else:
        ranked = ranked.withColumn("used", F.lit(0))
    left = F.when(
        F.col("monthly_quota").isNotNull(), F.greatest(F.lit(0), F.col("monthly_quota") - F.col("used"))
    ).cast("bigint")
    return ranked.select(
        "layer", "position", "name", "effective_trust", "health", "monthly_quota", "used",
        left.alias("remaining"),
    )


def source_group_health(targets: DataFrame, group="provider", healthy="healthy") -> DataFrame:
    """Health of a provider made of targets: down when none is healthy, degraded when some are not."""
    return targets.groupBy(group).agg(
        F.when(~F.max(healthy), "down").when(~F.min(healthy), "degraded").otherwise("healthy").alias("health")
    )


def federate_fallback(quotes: DataFrame, ranking: DataFrame, layer: str) -> DataFrame:
    """Per request all quotes of the first provider, in trust order, that returned any.

    The winning position is a plain minimum per request (combined map-side); no ordering of the
    request's quotes is needed.
    """
    order = ranking.where(F.col("layer") == layer).select(F.col("name").alias("provider"), "position")
    pool = quotes.join(order, "provider")
    first = pool.groupBy("request_id").agg(F.min("position").alias("position"))
    return pool.join(first, ["request_id", "position"]).drop("position")


def federate_pool(quotes: DataFrame, ranking: DataFrame, layer: str) -> DataFrame:
    """All quotes of the providers eligible for a pooled layer."""
    order = ranking.where(F.col("layer") == layer).select(F.col("name").alias("provider"))
    return quotes.join(order, "provider", "left_semi")
