"""Reference tables: ratios, charts, fares, dimensions, source and creator catalogues."""

from pyspark.sql import DataFrame, functions as F

from awardlake import vocab
from awardlake.functions.labels import to_bool_token
from awardlake.functions.points import half_even, route_key

PARTNER = "struct<ratio:double,bonus:double,valid_from:string,valid_until:string,label:string>"


def partner_rows(blocks: DataFrame) -> DataFrame:
    """Ratio blocks with a ``partners`` map -> one row per currency and partner."""
    rest = [c for c in blocks.columns if c != "partners"]
    rows = blocks.select(*rest, F.explode("partners").alias("partner", "spec"))
    return rows.select(*rest, "partner", "spec.*")


def flatten_transfer_ratios(partners: DataFrame, as_of, currency=None, programs=None) -> DataFrame:
    """Base row per partner, plus a bonus row while its time box (inclusive, open ends) holds."""
    if currency is not None:
        partners = partners.where(F.col("from_currency") == currency)
    if programs is not None:
        partners = partners.where(F.col("partner").isin(*programs))
    today = F.lit(str(as_of)[:10]).cast("date")
    day = lambda c: F.substring(F.col(c), 1, 10).try_cast("date")
    active = (
        F.col("bonus").isNotNull() & (F.col("bonus") != 1)
        & F.coalesce(day("valid_from") <= today, F.lit(True))
        & F.coalesce(day("valid_until") >= today, F.lit(True))
    )
    percent = half_even((F.col("bonus") - 1) * 100, 0).cast("int").cast("string")
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("+"), percent, F.lit("% transfer bonus")))
    trust = F.coalesce(F.col("trust").cast("double"), F.lit(1.0))
    ratio = F.coalesce(F.col("ratio").cast("double"), F.lit(1.0))

    def row(multiplier, is_bonus):
        date = lambda c: F.col(c) if is_bonus else F.lit(None).cast("string")
        return F.struct(
            ratio.alias("ratio"), multiplier.alias("bonus_multiplier"),
            (ratio * multiplier).alias("effective_ratio"),
            F.array(*([F.lit("transfer_bonus")] if is_bonus else [])).cast("array<string>").alias("flags"),
            date("valid_from").alias("valid_from"), date("valid_until").alias("valid_until"),
            (label if is_bonus else F.lit(None).cast("string")).alias("bonus_label"),
            F.lit(is_bonus).alias("is_bonus"),
        )

    both = F.when(
        active, F.array(row(F.lit(1.0), False), row(F.col("bonus").cast("double"), True))
    ).otherwise(F.array(row(F.lit(1.0), False)))
    keep = [c for c in ("source", "url", "updated_at") if c in partners.columns]
    out = partners.select(
        "from_currency", F.col("partner").alias("to_program"), trust.alias("confidence"), *keep,
        *(["ord"] if "ord" in partners.columns else []), F.posexplode(both).alias("_i", "r"),
    )
    ord_col = [(F.col("ord") * 2 + F.col("_i")).alias("ord")] if "ord" in partners.columns else []
    return out.select("from_currency", "to_program", "confidence", *keep, "r.*", *ord_col)


def flatten_award_chart(spec: DataFrame) -> DataFrame:
    """Chart specs (program, bands array) -> long chart rows that keep the band order."""
    meta = [c for c in ("source_name", "source_url", "trust", "updated_at") if c in spec.columns]
    bands = spec.select("program", *meta, F.posexplode("bands").alias("band_ord", "b"))
    at = lambda c, i: F.try_element_at(F.col(f"b.{c}"), F.lit(i))
    return bands.select(
        "program", *meta, F.col("band_ord").cast("bigint").alias("band_ord"),
        F.lower(at("regions", 1)).alias("region_a"), F.lower(at("regions", 2)).alias("region_b"),
        F.upper(at("airports", 1)).alias("origin_airport"), F.upper(at("airports", 2)).alias("dest_airport"),
        F.coalesce(F.col("b.roundtrip"), F.lit(False)).alias("roundtrip"),
        at("distance", 1).alias("distance_min"), at("distance", 2).alias("distance_max"),
        F.explode("b.miles").alias("cabin", "miles"),
    )


FARE_TIERS = {
    "cached": ("cached fares", 0.6, "cached_fare"),
    "floor": ("curated fallback fares", 0.3, "hardcoded_fallback"),
}


def read_fares(fares: DataFrame, tier: str) -> DataFrame:
    """``O-D-cabin`` keyed fares -> fare quotes of one tier."""
    source, trust, flag = FARE_TIERS[tier]
    part = F.split("key", "-")
    return fares.select(
        part[0].alias("origin"), part[1].alias("dest"), part[2].alias("cabin"),
        F.col("key").alias("route_key"), F.col("cents").cast("bigint").alias("cash_cents"),
        F.lit(source).alias("source_name"), F.lit(trust).alias("trust"),
        F.lit(trust).alias("confidence"), F.array(F.lit(flag)).alias("flags"),
    )


def build_dimensions(spec: DataFrame):
    """Map-shaped geography -> (dim_airport(code, region, lat, lon), dim_zone(program, code, zone)).

    ``spec``: region_map map<string,string>, coords map<string,array<string>>,
    program_zones map<string,map<string,string>>. Coordinates that are no numbers are dropped.
    """
    regions = spec.select(F.explode("region_map").alias("code", "region")).select(
        F.upper("code").alias("code"), "region"
    )
    coords = spec.select(F.explode("coords").alias("code", "xy")).select(
        F.upper("code").alias("code"),
        F.try_element_at("xy", F.lit(1)).try_cast("double").alias("lat"),
        F.try_element_at("xy", F.lit(2)).try_cast("double").alias("lon"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    zones = spec.select(F.explode("program_zones").alias("program", "z")).select(
        F.lower("program").alias("program"), F.explode("z").alias("code", "zone")
    ).select("program", F.upper("code").alias("code"), F.col("zone").try_cast("int").alias("zone"))
    return regions.join(coords, "code", "full"), zones.where(F.col("zone").isNotNull())


def validate_targets_catalog(targets: DataFrame) -> DataFrame:
    """Targets of a known format and kind, normalised, in order of falling trust."""
    role = F.lower(F.trim(F.col("role")))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return (
        targets.where(
            F.trim("format").isin(*vocab.SOURCE_FORMATS) & F.trim("provides").isin(*vocab.SOURCE_PROVIDES)
        )
        .withColumns(
            {
                "format": F.trim("format"),
                "provides": F.trim("provides"),
                "role": F.when(role.isin(*vocab.SOURCE_ROLES), role).otherwise("primary"),
                "program": F.lower(blank("program")),
                "hub": F.upper(blank("hub")),
                "trust": F.coalesce(F.col("trust").cast("double"), F.lit(0.5)),
            }
        )
        .orderBy(F.desc("trust"), "ord")
    )


def creators_catalog(creators: DataFrame) -> DataFrame:
    """Creators with their usable intakes."""
    channel = F.when(~F.coalesce("channel_id", F.lit("")).isin("", "TODO"), F.col("channel_id"))
    rss = F.nullif(F.col("blog_rss"), F.lit(""))
    return creators.select(
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("creator")).alias("name"),
        rss.alias("blog_rss"), channel.alias("channel_id"),
        F.coalesce(F.col("trust").cast("double"), F.lit(0.45)).alias("trust"),
        rss.isNotNull().alias("has_blog"),
        F.coalesce(channel.startswith("UC"), F.lit(False)).alias("has_youtube"),
    )


DISCOVERED = (
    "struct<updated_at:string,stale_programs:array<string>,rows:array<struct<program:string,"
    "region_a:string,region_b:string,cabin:string,miles:string,roundtrip:string,"
    "source_name:string,source_url:string,source_updated_at:string,trust:string>>>"
)


def read_discovered_rows(docs: DataFrame, column="doc"):
    """Persisted discovery documents (JSON) -> (typed rows, stale programmes).

    A row without programme, regions, cabin or whole miles is dropped.
    """
    parsed = docs.select(F.from_json(column, DISCOVERED).alias("d"))
    clean = lambda c: F.lower(F.trim(F.col(f"r.{c}")))
    rows = parsed.select(F.explode("d.rows").alias("r")).select(
        clean("program").alias("program"), clean("region_a").alias("region_a"),
        clean("region_b").alias("region_b"), clean("cabin").alias("cabin"),
        F.col("r.miles").try_cast("double").cast("bigint").alias("miles"),
        to_bool_token(F.col("r.roundtrip")).alias("roundtrip"),
        F.coalesce(F.nullif(F.col("r.source_name"), F.lit("")), F.lit("discovery")).alias("source_name"),
        "r.source_url", F.col("r.source_updated_at").alias("updated_at"),
        F.coalesce(F.nullif(F.col("r.trust").try_cast("double"), F.lit(0.0)), F.lit(0.3)).alias("trust"),
    )
    whole = [F.col(c).isNotNull() for c in ("program", "region_a", "region_b", "cabin", "miles")]
    keep = whole[0] & whole[1] & whole[2] & whole[3] & whole[4]
    stale = (
        parsed.select(F.explode("d.stale_programs").alias("p"))
        .select(F.lower(F.trim("p")).alias("program")).where(F.col("program") != "").distinct()
    )
    return rows.where(keep), stale


def partner_programs(ratios: DataFrame, currency=None) -> DataFrame:
    """Programmes each currency (or one currency) can transfer to."""
    rows = ratios if currency is None else ratios.where(F.col("from_currency") == currency)
    return rows.select("from_currency", F.col("to_program").alias("program")).distinct()


def offers_to_fares(offers: DataFrame, source="live fare offers", trust=0.9) -> DataFrame:
    """Cheapest priced offer per route as a fare quote; routes without a priced offer have none."""
    price = F.col("grand_total").try_cast("double")
    cheapest = (
        offers.where(price.isNotNull() & (F.col("grand_total") != ""))
        .groupBy("origin", "dest", "cabin").agg(F.min(price).alias("price"))
    )
    return cheapest.select(
        route_key(F.col("origin"), F.col("dest"), F.col("cabin")).alias("route_key"),
        half_even(F.col("price") * 100, 0).cast("bigint").alias("cash_cents"),
        F.lit(source).alias("source_name"), F.lit(trust).alias("trust"),
        F.lit(trust).alias("confidence"), F.array().cast("array<string>").alias("flags"),
    )
