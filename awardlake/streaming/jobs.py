"""Streaming jobs that keep stored tables current; every batch writes its own place, so a repeat is harmless."""

from pyspark.sql import DataFrame, functions as F

from awardlake.operators import claims
from awardlake.plans import quotes
from awardlake.sources import sinks
from awardlake.streaming.items import SEEN_TTL_DAYS, dedupe_items_ttl


def _stale_programs(spark, path):
    return sinks.BucketedTable(spark, path, ["program"])


def read_latest(spark, path) -> DataFrame:
    """The table of stale programmes kept by :func:`devaluation_stream`; None before its first batch."""
    return _stale_programs(spark, path).read()


def devaluation_stream(stream: DataFrame, sink, checkpoint, title_col="title", id_col="doc_id", ts="published"):
    """Headlines -> table of stale programmes (program, marked_at), upserted per batch.

    A batch rewrites the buckets of the programmes that it names and no others.
    """

    def upsert(batch, batch_id):
        marked = batch.select(claims.devaluation_program(F.col(title_col)).alias("program"), F.col(ts).cast("timestamp").alias("marked_at"))
        new = marked.where("program IS NOT NULL").groupBy("program").agg(F.max("marked_at").alias("marked_at"))
        _stale_programs(batch.sparkSession, sink).upsert(new, "marked_at", batch_id)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_discovery(doc_stream: DataFrame, sink, checkpoint, creators: DataFrame = None, key="doc_id", arrived="arrived", ttl_days=SEEN_TTL_DAYS):
    """New documents -> discovered rows; each batch owns one partition of the table.

    A document counts once within ``ttl_days`` of the time that it ``arrived``; later it is read anew. The keys
    live in the state of the stream, which forgets them as time goes on, and survive a restart with its checkpoint.
    """

    def extract(batch, batch_id):
        batch = batch.persist()  # claims and their provenance both read the documents
        rows = claims.attach_discovery_provenance(claims.extract_price_claims(batch), batch, creators)
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    fresh = dedupe_items_ttl(doc_stream, key, arrived, ttl_days)
    return fresh.writeStream.foreachBatch(extract).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requote_stream(request_stream: DataFrame, market, sink, checkpoint):
    """Requests -> verdicts against the current market tables.

    ``market``: the tables, or a function that reads them; it is called for every batch, so each
    batch sees the market of its time.
    """

    def answer(batch, batch_id):
        current = market() if callable(market) else market
        quotes.quote_requests(batch, current).verdicts.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return request_stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
