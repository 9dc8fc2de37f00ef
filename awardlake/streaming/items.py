"""Items that count once per lifetime: batch form by pointer doubling, stream form by expiring state."""

from pyspark.sql import DataFrame, Window, functions as F

from awardlake.sources.sinks import materialize

#: Fixed value: how long a processed item is remembered.
SEEN_TTL_DAYS = 30
DAY_US = 86_400_000_000


def _us(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def next_after_expiry(times: DataFrame, ttl_us) -> DataFrame:
    """(_key, at, to): for every time of a key the first one ``ttl_us`` later or more, null without any.

    Times are dealt into buckets one lifetime wide, so a key that holds many rows spreads over many
    tasks; only one row per bucket of a key is looked at in the order of the whole key.
    """
    bucket = lambda c: F.floor(c / ttl_us)
    none = F.lit(None).cast("bigint")
    seen = times.select("_key", F.col("_us").alias("t"), F.col("_us").alias("event"), none.alias("at"))
    asked = times.select("_key", (F.col("_us") + ttl_us).alias("t"), none.alias("event"), F.col("_us").alias("at"))
    both = seen.unionByName(asked).withColumn("b", bucket(F.col("t")))
    # from late to early, an event before the questions of its time
    late = Window.partitionBy("_key", "b").orderBy(F.desc("t"), F.desc_nulls_last("event")).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("to", F.last("event", ignorenulls=True).over(late)).where(F.col("at").isNotNull())
    later = Window.partitionBy("_key").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    after = both.groupBy("_key", "b").agg(F.min("event").alias("first")).select(
        F.col("_key").alias("_k"), F.col("b").alias("_b"), F.last("first", ignorenulls=True).over(later).alias("after"))
    joined = within.join(after, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b")))
    return joined.select("_key", "at", F.coalesce("to", "after").alias("to"))


def first_sightings(items: DataFrame, key, ts, ttl_days=SEEN_TTL_DAYS) -> DataFrame:
    """(key, seen_us): per key its first time, then each first time after the one before has expired.

    Every time points to the next one after its expiry. Round by round the pointers are doubled, and
    what is marked marks as many again: the rounds are the logarithm of the longest chain, whatever
    the span of the data. Pointers are written between rounds; those that lead nowhere drop out.
    """
    times = items.select(F.col(key).alias("_key"), _us(ts).alias("_us")).where(F.col("_us").isNotNull()).distinct()
    links = materialize(next_after_expiry(times, int(ttl_days * DAY_US)), "links")
    marked = links.groupBy("_key").agg(F.min("at").alias("at"))
    jumps = links.where(F.col("to").isNotNull())
    same = lambda a, b, at: F.col(f"{a}._key").eqNullSafe(F.col(f"{b}._key")) & (F.col(f"{a}.{at}") == F.col(f"{b}.at"))
    while not jumps.isEmpty():
        reached = marked.alias("m").join(jumps.alias("j"), same("m", "j", "at")).select("m._key", F.col("j.to").alias("at"))
        marked = materialize(marked.unionByName(reached), "marked")
        doubled = jumps.alias("a").join(jumps.alias("b"), same("a", "b", "to")).select("a._key", "a.at", F.col("b.to").alias("to"))
        jumps = materialize(doubled, "jumps")
    return marked.select(F.col("_key").alias(key), F.col("at").alias("seen_us"))


def dedupe_items_batch(items: DataFrame, key, ts, order, ttl_days=SEEN_TTL_DAYS) -> DataFrame:
    """Each item once per lifetime, the first by ``order`` of equal times: the batch form of :func:`dedupe_items_ttl`.

    A lifetime starts with the row that counts; rows within it do not extend it. A null key is a key; a row
    without a time is left out.
    """
    seen = first_sightings(items, key, ts, ttl_days).select(F.col(key).alias("_k"), F.col("seen_us").alias("_at"))
    timed = items.withColumn("_us", _us(ts))
    hits = timed.join(seen, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_us") == F.col("_at")))
    firsts = hits.groupBy("_k", "_at").agg(F.min(order).alias("_first"))
    kept = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_us") == F.col("_at")) & (F.col(order) == F.col("_first"))
    return timed.join(firsts, kept, "left_semi").drop("_us")


def dedupe_items_ttl(stream: DataFrame, key, ts, ttl_days=SEEN_TTL_DAYS) -> DataFrame:
    """Streaming: drop items whose key was seen within the lifetime (event time); expired keys leave the state."""
    return stream.withWatermark(ts, f"{ttl_days} days").dropDuplicatesWithinWatermark([key])
