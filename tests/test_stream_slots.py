"""Keyed state on streams: many keys share one call of Python, and stay apart in it."""

from pyspark.sql import functions as F

from awardlake.streaming import state

DAY = 86400
BIG = 2**53 + 1


def drained(spark, tmp_path, rows, slots, monkeypatch, key="long"):
    """Hits of (user, event, day) rows, one micro-batch a file; two batches."""
    monkeypatch.setattr(state, "SLOTS", slots)
    schema = f"k {key}, event long, second long"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        spark.read.parquet(f"{tmp_path}/in/{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all").withColumn("ts", F.timestamp_seconds("second"))
    hits = state.cache_hits_stream(stream, "k", "ts", "event")
    query = hits.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet")
    query.awaitTermination()
    groups = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    return groups, {(r["k"], r["event"], r["is_hit"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_many_keys_share_few_groups(spark, tmp_path, monkeypatch):
    first = [(k, k * 10, 0) for k in range(40)] + [(k, k * 10 + 1, DAY) for k in range(40)]
    second = [(k, k * 10 + 2, (3 if k % 2 else 1) * DAY + k) for k in range(40)]
    groups, got = drained(spark, tmp_path, [first, second], 3, monkeypatch)
    assert groups <= 3
    expect = {(k, k * 10, False) for k in range(40)} | {(k, k * 10 + 1, True) for k in range(40)}
    assert got == expect | {(k, k * 10 + 2, k % 2 == 0) for k in range(40)}


def test_missing_keys_and_orders_leave_long_numbers_whole(spark, tmp_path, monkeypatch):
    first = [(BIG, BIG, 0), (BIG + 2, BIG + 4, 0), (None, 7, 0), (BIG, None, DAY)]
    second = [(None, 8, DAY), (BIG, BIG + 2, 3 * DAY)]
    _, got = drained(spark, tmp_path, [first, second], 1, monkeypatch)
    assert got == {(BIG, BIG, False), (BIG + 2, BIG + 4, False), (None, 7, False), (BIG, None, True), (None, 8, True), (BIG, BIG + 2, False)}


def test_names_as_keys(spark, tmp_path, monkeypatch):
    _, got = drained(spark, tmp_path, [[("a", 1, 0), ("b", 2, 0), (None, 3, 0)], [("b", 4, DAY), ("a", 5, 2 * DAY)]], 1, monkeypatch, "string")
    assert got == {("a", 1, False), ("b", 2, False), (None, 3, False), ("b", 4, True), ("a", 5, False)}
