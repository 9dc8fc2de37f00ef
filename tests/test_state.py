"""Stateful operators against step-by-step simulation, with one key holding a third of the rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from awardlake.streaming import state


def requests(spark, n=3000, span=2_000_000, seed=3):
    rng = random.Random(seed)
    keys = ["hot"] * 10 + [f"k{i}" for i in range(20)]
    rows = [(i, rng.choice(keys), rng.randrange(span), rng.choice([200, 200, 429, 0])) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, k string, second long, status int").withColumn("ts", F.timestamp_seconds("second"))
    by_key = defaultdict(list)
    for seq, k, s, status in rows:
        by_key[k].append((s, seq, status))
    return df, {k: sorted(v) for k, v in by_key.items()}


def test_cache_hits(spark):
    df, by_key = requests(spark)
    expect = {}
    for items in by_key.values():
        free = -1
        for s, seq, _ in items:
            expect[seq] = s < free
            free = free if s < free else s + 2 * 86400
    got = {r["seq"]: r["is_hit"] for r in state.classify_cache_hits(df, "k", "ts", "seq").collect()}
    assert got == expect


def test_cache_of_no_requests(spark):
    df, _ = requests(spark, 10)
    assert state.classify_cache_hits(df.limit(0), "k", "ts", "seq").count() == 0


def test_token_bucket(spark):
    df, by_key = requests(spark, span=60)
    expect = {}
    for items in by_key.values():
        tokens, last = 10.0, items[0][0]
        for s, seq, _ in items:
            tokens, last = min(10.0, tokens + (s - last) * 5.0), s
            expect[seq] = tokens >= 1
            tokens -= expect[seq]
    got = {r["seq"]: r["allowed"] for r in state.token_bucket(df, "k", "ts", "seq").collect()}
    assert got == expect and not all(expect.values())


def test_adaptive_delay(spark):
    df, by_key = requests(spark)
    expect = {}
    for items in by_key.values():
        delay, streak = 1.0, 0
        for _, seq, status in items:
            bad = status in (429, 0)
            delay = min(30.0, delay * 2) if bad else max(0.25, delay * 0.9)
            streak = streak + 1 if bad else 0
            expect[seq] = (round(delay, 9), streak)
    got = state.adaptive_delay(df, "k", "ts", "seq", slice_hours=6).collect()
    assert {r["seq"]: (round(r["delay"], 9), r["streak"]) for r in got} == expect
