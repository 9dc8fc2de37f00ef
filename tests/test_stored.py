"""Tables that streams keep: buckets touched, versions removed, repeated batches, keys that expire."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from awardlake.sources import sinks
from awardlake.streaming import items, jobs


def folders(path):
    return sorted(f"{v}/{b}" for v in os.listdir(path) if v.startswith("version") for b in os.listdir(f"{path}/{v}") if b.startswith("bucket"))


def test_upsert_rewrites_touched_buckets_only_and_folders_stay_bounded(spark, tmp_path):
    path, expect = str(tmp_path / "table"), {}
    table = sinks.BucketedTable(spark, path, ["k"], buckets=4)
    assert table.read() is None
    for version in range(12):
        new = [(f"k{i}", version, f"v{version}") for i in range(20) if version == 0 or i == version]
        expect |= {k: (t, v) for k, t, v in new}
        before = set(folders(f"{path}/data")) if version else set()
        table.upsert(spark.createDataFrame(new, "k string, t int, v string"), "t", version)
        added = set(folders(f"{path}/data")) - before
        assert len(added) == (4 if version == 0 else 1)
        assert len(folders(f"{path}/data")) <= 8 and len([m for m in os.listdir(f"{path}/manifest") if m[0] == "v"]) <= 2
        assert {r.k: (r.t, r.v) for r in table.read().collect()} == expect


def test_a_repeated_version_starts_from_the_one_before(spark, tmp_path):
    table = sinks.BucketedTable(spark, str(tmp_path / "table"), ["k"], buckets=2)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, t int")
    table.upsert(frame(("a", 1), ("b", 1)), "t", 3)
    table.upsert(frame(("a", 9), ("c", 2)), "t", 5)
    table.upsert(frame(("a", 2), ("c", 2)), "t", 5)
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 1), ("c", 2)]
    table.upsert(frame(("a", 7)).limit(0), "t", 6)
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 1), ("c", 2)]


def write(spark, path, rows, at):
    spark.createDataFrame(rows, "doc_id string, text string, title string, intake string, origin string, url string, published string, arrived timestamp").coalesce(1).write.mode("append").parquet(path)
    for f in os.listdir(path):
        if f.startswith("part") and os.path.getmtime(f"{path}/{f}") > at + 10:
            os.utime(f"{path}/{f}", (at, at))


def documents(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def doc(key, day):
    return (key, "Book Turkish Miles&Smiles business class from home to Tokyo for 65,000 miles. ", "Deal", "email", "email:a", f"u{key}", "2024-01-01", datetime(2024, 1, 1) + timedelta(days=day))


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_documents_count_once_per_lifetime_over_batches_and_restarts(spark, tmp_path):
    src, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    run = lambda: jobs.incremental_discovery(documents(spark, src), sink, checkpoint)
    found = lambda: sorted(r.doc_id for r in spark.read.parquet(sink).collect())
    write(spark, src, [doc("a", 0), doc("a", 0), doc("b", 0)], 1_000_000_000)
    run().awaitTermination()
    once = found()
    assert set(once) == {"a", "b"} and len(once) == 2
    write(spark, src, [doc("a", 5), doc("c", 5)], 1_000_000_100)
    run().awaitTermination()
    assert found() == ["a", "b", "c"]
    sizes = []
    for step in range(6):
        write(spark, src, [doc(f"d{step}-{i}", 20 * step + 20) for i in range(10)], 1_000_000_200 + 100 * step)
        query = run()
        query.awaitTermination()
        sizes.append(state_rows(query))
    assert len(found()) == 63 and sizes[-1] == sizes[-2] == sizes[-3]
    write(spark, src, [doc("a", 130)], 1_000_001_000)
    run().awaitTermination()
    assert found().count("a") == 2


def test_stale_programmes_are_kept_by_batch(spark, tmp_path):
    src, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    assert jobs.read_latest(spark, sink) is None
    for i in range(4):
        rows = [("1", "Turkish Miles&Smiles devaluation announced", datetime(2024, 1, 1 + i))]
        spark.createDataFrame(rows, "doc_id string, title string, published timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id string, title string, published timestamp").parquet(src)
        jobs.devaluation_stream(stream, sink, checkpoint).awaitTermination()
        assert [r.marked_at.day for r in jobs.read_latest(spark, sink).collect()] == [1 + i]
    assert len(folders(f"{sink}/data")) <= 2
