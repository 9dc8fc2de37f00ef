"""Queries over stateful operators: batch forms, and streams run to completion and read back."""

from pyspark.sql import functions as F

from awardlake.checks.base import joined, query, r6
from awardlake.checks.document_checks import CLAIMS_SQL, SENTENCE, TITLES, TITLE_IDS, DISCOVERED_SQL, intake_docs
from awardlake.checks.label_checks import pick
from awardlake.checks.plan_checks import VERDICTS_CTE, market
from awardlake.plans.quotes import stored_market
from awardlake.sources import sinks
from awardlake.streaming import items, jobs, state


def replay(d, df, files=4):
    """A DataFrame as a file stream of a few micro-batches; with a ``ts`` column in its order."""
    path = sinks.new_table_path(d.spark, "stream")
    if "ts" in df.columns:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        lo, hi = df.agg(F.min(us), F.max(us)).first()
        step = (hi - lo) // files + 1
        for i in range(files):
            df.where((us >= lo + i * step) & (us < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    else:
        df.repartition(files).write.parquet(path)
    return d.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def place(d, name):
    return sinks.new_table_path(d.spark, name), sinks.new_table_path(d.spark, f"{name}-checkpoint")


def drain(d, stream, name):
    """Run a stream to its end into a table and read the table."""
    out, checkpoint = place(d, name)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return d.spark.read.parquet(out)


def events(d):
    return d.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


CACHE_SQL = """
e AS (SELECT user_id, event_id, ts FROM @events),
m AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
      UNION ALL SELECT m.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL {ttl}) FROM m WHERE m.ts IS NOT NULL),
miss AS (SELECT e.user_id, min(event_id) AS event_id FROM e JOIN m ON m.user_id = e.user_id AND m.ts = e.ts GROUP BY e.user_id, e.ts)
"""
HITS_SQL = f"WITH RECURSIVE {CACHE_SQL.format(ttl='2 DAY')} SELECT e.user_id, e.event_id, miss.event_id IS NULL AS is_hit FROM e LEFT JOIN miss ON miss.event_id = e.event_id"


@query("classify_cache_hits", HITS_SQL)
def _hits(d):
    return state.classify_cache_hits(events(d), "user_id", "ts", "event_id").select("user_id", "event_id", "is_hit")


@query("classify_cache_hits_stream", HITS_SQL)
def _hits_stream(d):
    return drain(d, state.cache_hits_stream(replay(d, events(d)), "user_id", "ts", "event_id"), "hits")


SEEN_SQL = f"WITH RECURSIVE {CACHE_SQL.format(ttl='10 DAY')} SELECT user_id, count(*) AS kept FROM miss GROUP BY 1"


@query("dedupe_items_ttl", SEEN_SQL)
def _seen(d):
    return items.dedupe_items_batch(events(d), "user_id", "ts", "event_id", 10).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("dedupe_items_ttl_stream", "SELECT DISTINCT user_id FROM @events")
def _seen_stream(d):
    """With a TTL longer than the data every key survives once; which payload does is arrival order."""
    return drain(d, items.dedupe_items_ttl(replay(d, events(d)), "user_id", "ts", 40), "seen").select("user_id")


DELAY_SQL = """
WITH RECURSIVE r AS (SELECT domain, seq, status IN (429, 0) AS bad, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS rn FROM @@responses v),
w AS (SELECT domain, seq, rn, CASE WHEN bad THEN 2.0E0 ELSE 0.9E0 END AS delay, CASE WHEN bad THEN 1 ELSE 0 END AS streak FROM r WHERE rn = 1
      UNION ALL SELECT r.domain, r.seq, r.rn, CASE WHEN bad THEN least(30, delay * 2) ELSE greatest(0.25, delay * 0.9E0) END, CASE WHEN bad THEN streak + 1 ELSE 0 END
      FROM w JOIN r ON r.domain = w.domain AND r.rn = w.rn + 1)
SELECT domain, seq, round(delay, 6) AS delay, streak FROM w
"""


@query("adaptive_delay", DELAY_SQL)
def _delay(d):
    return state.adaptive_delay(d.view("responses")).withColumn("delay", r6(F.col("delay")))


@query("adaptive_delay_stream", DELAY_SQL)
def _delay_stream(d):
    return drain(d, state.adaptive_delay_stream(replay(d, d.view("responses")), "domain", "ts", "seq"), "delay").withColumn("delay", r6(F.col("delay")))


# Requests squeezed in time (a day becomes 20 seconds), so that buckets run dry.
BUCKET_SQL = """
WITH RECURSIVE r AS (SELECT user_id % 10 AS k, event_id, epoch_us(ts) // 4320 AS us, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 4320, event_id) AS rn FROM @events),
w AS (SELECT k, event_id, us, rn, 9.0E0 AS tokens, true AS allowed FROM r WHERE rn = 1
      UNION ALL SELECT k, event_id, us, rn, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, t >= 1 FROM (SELECT r.*, least(10, w.tokens + (r.us - w.us) * 5 / 1e6) AS t FROM w JOIN r ON r.k = w.k AND r.rn = w.rn + 1))
SELECT k, event_id, allowed FROM w
"""


def squeezed(d):
    us = F.expr("unix_micros(cast(ts AS timestamp)) div 4320")
    return d.table("events").select((F.col("user_id") % 10).alias("k"), "event_id", F.timestamp_micros(us).alias("ts"))


@query("token_bucket", BUCKET_SQL)
def _bucket(d):
    return state.token_bucket(squeezed(d), "k", "ts", "event_id")


@query("token_bucket_stream", BUCKET_SQL)
def _bucket_stream(d):
    return drain(d, state.token_bucket_stream(replay(d, squeezed(d)), "k", "ts", "event_id"), "bucket")


@query("devaluation_stream", f"""
SELECT program, epoch_us(max(ts)) AS marked FROM (SELECT {pick(TITLE_IDS, 'event_id % 7', 'duck')} AS program, ts FROM @events) WHERE program IS NOT NULL GROUP BY 1
""")
def _devaluations(d):
    docs = d.sql(f"SELECT event_id AS doc_id, {pick(TITLES, 'event_id % 7', 'spark')} AS title, cast(ts AS timestamp) AS published, cast(ts AS timestamp) AS ts FROM @events")
    sink, checkpoint = place(d, "stale")
    jobs.devaluation_stream(replay(d, docs), sink, checkpoint).awaitTermination()
    return jobs.read_latest(d.spark, sink).select("program", F.unix_micros("marked_at").alias("marked"))


@query("incremental_discovery", DISCOVERED_SQL)
def _incremental(d):
    """Every document comes twice, two days apart, and counts once."""
    docs, creators = intake_docs(d)
    twice = docs.withColumn("arrived", F.explode(F.array(*(F.lit(t).cast("timestamp") for t in ("2024-01-01", "2024-01-03")))))
    sink, checkpoint = place(d, "found")
    jobs.incremental_discovery(replay(d, twice), sink, checkpoint, creators).awaitTermination()
    return d.spark.read.parquet(sink).select("doc_id", "program", "miles", "source_name", "source_url", "trust")


@query("requote_stream", f"WITH {VERDICTS_CTE} SELECT q.request_id, coalesce(v.label, 'no_fare') AS label, best_cpp FROM @@requests q LEFT JOIN verdicts v ON v.request_id = q.request_id")
def _requote(d):
    sink, checkpoint = place(d, "requotes")
    current = stored_market(market(d))
    jobs.requote_stream(replay(d, d.view("requests")), current, sink, checkpoint).awaitTermination()
    return d.spark.read.parquet(sink).select("request_id", "label", "best_cpp")
