"""Items once per lifetime, against step-by-step simulation; one key holds a third of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from awardlake.streaming import items

DAY = 86400


def simulated(rows, ttl):
    """Row numbers that count, per key in the order of time and number."""
    by_key, kept = defaultdict(list), set()
    for seq, key, second in rows:
        if second is not None:
            by_key[key].append((second, seq))
    for times in by_key.values():
        free = None
        for second, seq in sorted(times):
            if free is None or second >= free:
                kept.add(seq)
                free = second + ttl
    return kept


@pytest.mark.parametrize("ttl_days", [0.0001, 0.5, 3, 1000])
def test_batch_keeps_what_a_simulation_keeps(spark, ttl_days):
    rng = random.Random(5)
    keys = ["hot"] * 10 + [None] + [f"k{i}" for i in range(20)]
    rows = [(i, rng.choice(keys), rng.choice([None, *[rng.randrange(90 * DAY) for _ in range(20)]])) for i in range(4000)]
    rows += [(5000 + i, "each day", i * DAY) for i in range(90)] + [(6000 + i, "at once", 7) for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, k string, second long").withColumn("ts", F.timestamp_seconds("second"))
    got = {r.seq for r in items.dedupe_items_batch(df, "k", "ts", "seq", ttl_days).collect()}
    assert got == simulated(rows, ttl_days * DAY)


def test_no_items(spark):
    df = spark.createDataFrame([], "seq long, k string, ts timestamp")
    assert items.dedupe_items_batch(df, "k", "ts", "seq").collect() == []


def test_rounds_follow_the_logarithm_of_the_chain(spark, monkeypatch):
    written, plain = [], items.materialize
    monkeypatch.setattr(items, "materialize", lambda df, name: (written.append(name), plain(df, name))[1])
    rows = [(i, "k", i * DAY) for i in range(1000)]
    df = spark.createDataFrame(rows, "seq long, k string, second long").withColumn("ts", F.timestamp_seconds("second"))
    assert items.dedupe_items_batch(df, "k", "ts", "seq", 2).count() == 500
    assert written.count("jumps") == 9
