"""Time-to-live, rate and back-off state: batch forms and Structured Streaming forms.

The batch forms give the exact result of the event-time order. They avoid one task per key:
``cache_misses`` advances all keys together, one TTL period per round; ``adaptive_delay`` composes
the back-off steps of time slices, which is associative; ``token_bucket`` is cut wherever a pause
refills the bucket.
"""

import sys
from functools import reduce
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from awardlake.functions.rows import inline_rows
from awardlake.sources.sinks import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Back-off settings, rate limit, cache lifetime.
START_DELAY, MIN_DELAY, MAX_DELAY = 1.0, 0.25, 30.0
BACKOFF, RECOVER = 2.0, 0.9
RATE, CAPACITY = 5.0, 10.0
CACHE_TTL_DAYS = 2
#: Groups of keys of a stream that keep their states together; part of what a checkpoint holds.
SLOTS = 1 << 12
DAY_US = 86_400_000_000


def _us(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


# --- cache -----------------------------------------------------------------------------------


def cache_misses(requests: DataFrame, key, ts, ttl_days=CACHE_TTL_DAYS) -> DataFrame:
    """(key, miss_us): per key the requests that find no live entry; hits do not extend an entry.

    Round k reads only requests of the k-th TTL period. A key has at most one miss in such a
    period: its first request at or after its entry's expiry, a minimum that is combined map-side.
    The rounds are as many as TTL periods in the data, and the work over all of them reads each
    request once; the state (one row per key) is written to the shared folder between rounds.
    """
    ttl = int(ttl_days * DAY_US)
    rows = requests.select(F.col(key).alias("_key"), _us(ts).alias("_us"))
    span = rows.agg(F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    state = rows.select("_key", F.col("_us").alias("miss_us"), F.lit(True).alias("fresh")).limit(0)
    found = [state]
    if span["lo"] is not None:
        for start in range(span["lo"], span["hi"] + 1, ttl):
            part = rows.where((F.col("_us") >= start) & (F.col("_us") < start + ttl))
            expiry = state.select("_key", (F.col("miss_us") + ttl).alias("_free"))
            late = part.join(expiry, "_key", "left").where(F.col("_free").isNull() | (F.col("_us") >= F.col("_free")))
            new = late.groupBy("_key").agg(F.min("_us").alias("_new"))
            entries = state.drop("fresh").join(new, "_key", "full").select(
                "_key", F.coalesce("_new", "miss_us").alias("miss_us"), F.col("_new").isNotNull().alias("fresh")
            )
            state = materialize(entries, "entries")
            found.append(state.where("fresh"))
    misses = reduce(DataFrame.unionByName, found)
    return misses.select(F.col("_key").alias(key), "miss_us")


def classify_cache_hits(requests: DataFrame, key, ts, order, ttl_days=CACHE_TTL_DAYS) -> DataFrame:
    """Requests with ``is_hit``; of requests with the same key and time the first by ``order`` can miss."""
    misses = cache_misses(requests, key, ts, ttl_days)
    firsts = requests.select(key, _us(ts).alias("miss_us"), order).join(misses, [key, "miss_us"]).groupBy(key, "miss_us").agg(
        F.min(order).alias(order)
    )
    marked = requests.join(firsts.select(key, order, F.lit(False).alias("is_hit")), [key, order], "left")
    return marked.withColumn("is_hit", F.coalesce("is_hit", F.lit(True)))


# --- adaptive delay ----------------------------------------------------------------------------


def _bad(status):
    return status.isin(429, 0)


def _step(low, high, factor, streak, bad):
    """Compose one response onto ``delay -> min(max(factor * delay, low), high)``."""
    return (
        F.when(bad, F.least(F.lit(MAX_DELAY), low * BACKOFF)).otherwise(F.greatest(F.lit(MIN_DELAY), low * RECOVER)),
        F.when(bad, F.least(F.lit(MAX_DELAY), high * BACKOFF)).otherwise(F.greatest(F.lit(MIN_DELAY), high * RECOVER)),
        F.when(bad, factor * BACKOFF).otherwise(factor * RECOVER),
        F.when(bad, streak + 1).otherwise(F.lit(0)),
    )


def adaptive_delay(responses: DataFrame, domain="domain", ts="ts", order="seq", status="status", slice_hours=1) -> DataFrame:
    """Delay and error streak of each domain after each response.

    Responses are folded per (domain, time slice); the slices of a domain, few and of fixed size,
    are chained; the fold is then replayed inside each slice from its known start. What one task
    holds at a time is one slice of one domain; a busier log takes a shorter slice.
    """
    slot = F.floor(_us(ts) / (slice_hours * 3600 * 1_000_000))
    item = F.struct(_us(ts).alias("us"), F.col(order).alias("seq"), _bad(F.col(status)).alias("bad"))
    slices = responses.groupBy(F.col(domain).alias("_d"), slot.alias("_s")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    unit = F.struct(F.lit(0.0).alias("low"), F.lit(1e300).alias("high"), F.lit(1.0).alias("factor"), F.lit(0).alias("streak"), F.lit(True).alias("all_bad"))

    def fold(a, x):
        low, high, factor, streak = _step(a["low"], a["high"], a["factor"], a["streak"], x["bad"])
        return F.struct(
            low.alias("low"), high.alias("high"), factor.alias("factor"), streak.alias("streak"), (a["all_bad"] & x["bad"]).alias("all_bad")
        )

    folded = slices.select("_d", "_s", F.aggregate("items", unit, fold).alias("f"))
    begin = F.struct(F.lit(START_DELAY).alias("delay"), F.lit(0).alias("streak"))

    def chain(a, x):
        delay = F.least(F.greatest(a["delay"] * x["f"]["factor"], x["f"]["low"]), x["f"]["high"])
        streak = F.when(x["f"]["all_bad"], a["streak"] + x["f"]["streak"]).otherwise(x["f"]["streak"])
        return F.struct(delay.alias("delay"), streak.alias("streak"))

    grown = F.struct(begin.alias("now"), F.array().cast("array<struct<s:bigint,delay:double,streak:int>>").alias("starts"))
    starts = (
        folded.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("_s", "f"))).alias("all"))
        .select(
            "_d",
            F.explode_outer(
                F.aggregate(
                    "all", grown,
                    lambda a, x: F.struct(
                        chain(a["now"], x).alias("now"),
                        F.array_append(
                            a["starts"], F.struct(x["_s"].alias("s"), a["now"]["delay"].alias("delay"), a["now"]["streak"].alias("streak"))
                        ).alias("starts"),
                    ),
                    lambda a: a["starts"],
                )
            ).alias("st"),
        )
        .select("_d", F.col("st.s").alias("_s"), F.col("st.delay").alias("_delay"), F.col("st.streak").alias("_streak"))
    )

    def replay(a, x):
        delay = F.when(x["bad"], F.least(F.lit(MAX_DELAY), a["delay"] * BACKOFF)).otherwise(F.greatest(F.lit(MIN_DELAY), a["delay"] * RECOVER))
        streak = F.when(x["bad"], a["streak"] + 1).otherwise(F.lit(0))
        return F.struct(
            delay.alias("delay"), streak.alias("streak"),
            F.array_append(a["out"], F.struct(x["seq"].alias("seq"), delay.alias("delay"), streak.alias("streak"))).alias("out"),
        )

    empty = F.array().cast("array<struct<seq:bigint,delay:double,streak:int>>")
    played = F.aggregate(
        "items", F.struct(F.col("_delay").alias("delay"), F.col("_streak").alias("streak"), empty.alias("out")), replay, lambda a: a["out"]
    )
    begun = slices.join(starts, ["_d", "_s"]).withColumnRenamed("_d", domain)
    return inline_rows(begun, [domain], played, "seq").withColumnRenamed("seq", order)


# --- token bucket ------------------------------------------------------------------------------


def bucket_segments(requests: DataFrame, key, ts, order, rate=RATE, capacity=CAPACITY, slice_seconds=2) -> DataFrame:
    """Add ``segment``: a new one starts after a pause long enough to refill any bucket.

    The previous request is looked up inside (key, time slice) and, for a slice's first request, in
    the latest earlier slice; no window spans a whole key.
    """
    refill = int(capacity / rate * 1_000_000)
    timed = requests.withColumns({"_us": _us(ts)}).withColumn("_slot", F.floor(F.col("_us") / (slice_seconds * 1_000_000)))
    ends = timed.groupBy(key, "_slot").agg(F.max("_us").alias("_end"))
    before = Window.partitionBy(key).orderBy("_slot")
    ends = ends.select(key, "_slot", F.lag("_end").over(before).alias("_prev_end"))
    inside = Window.partitionBy(key, "_slot").orderBy("_us", order)
    joined = timed.join(ends, [key, "_slot"]).withColumn("_prev", F.coalesce(F.lag("_us").over(inside), F.col("_prev_end")))
    fresh = joined.withColumn("_new", (F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= refill)).cast("int"))
    counts = fresh.groupBy(key, "_slot").agg(F.sum("_new").alias("_n"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.join(base, [key, "_slot"]).withColumn("segment", F.col("_base") + running).drop("_slot", "_prev", "_prev_end", "_new", "_base")


def _take_tokens(times, tokens, last, rate, capacity):
    """Allowed flags of sorted request times (micros), and the bucket left behind."""
    allowed = []
    for t in times:
        tokens = min(capacity, tokens + (t - last) * rate / 1e6)
        last = t
        allowed.append(tokens >= 1.0)
        tokens -= allowed[-1]
    return allowed, tokens, last


def token_bucket(requests: DataFrame, key, ts, order, rate=RATE, capacity=CAPACITY) -> DataFrame:
    """Requests with ``allowed``: at least one token left after refill.

    Segments start with a full bucket, so they are independent; they are sorted by Spark and read as
    a stream of batches that carries only the bucket, never as a whole group. Within one segment,
    that is while a key never pauses, each decision needs the one before it.
    """
    segments = bucket_segments(requests, key, ts, order, rate, capacity).select(key, order, "segment", "_us")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, capacity, 0
        for pdf in batches:
            out = []
            for name, part in pdf.groupby([key, "segment"], sort=False):
                if name != current:
                    current, tokens, last = name, capacity, int(part["_us"].iloc[0])
                flags, tokens, last = _take_tokens(part["_us"].tolist(), tokens, last, rate, capacity)
                out.append(part[[key, order]].assign(allowed=flags))
            if out:
                yield pd.concat(out)

    types = dict(segments.dtypes)
    ordered = segments.repartition(key, "segment").sortWithinPartitions(key, "segment", "_us", order)
    return ordered.mapInPandas(run, f"`{key}` {types[key]}, `{order}` {types[order]}, allowed boolean")


# --- keyed state on streams --------------------------------------------------------------------


def _stateful(stream, key, ts, order, extra, result, state_type, start, advance):
    """Run ``advance(columns of a key's sorted rows as lists, state) -> (columns, state)`` per key of a stream.

    A call of Python costs much more than the rows of most keys, so keys are dealt to ``SLOTS`` groups by their
    hash, and a group keeps the states of its keys as arrays. Keys without a name are a group of their own, and
    missing integers of ``order`` travel as a mark: neither turns the numbers of other keys into floats.
    """
    kind = dict(stream.dtypes)
    whole = kind[order] in ("bigint", "int", "smallint", "tinyint")
    timed = stream.select(
        key, (F.coalesce(F.col(order), F.lit(0).cast(kind[order])) if whole else F.col(order)).alias(order),
        F.col(order).isNull().alias("_none"), *extra, _us(ts).alias("_us"),
        F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(SLOTS))).alias("_slot"),
    )
    made = [field.split()[0] for field in result.split(", ")]

    def run(slot, batches, state):
        rows = pd.concat(list(batches), ignore_index=True)
        nameless = slot[0] == -1
        rows = rows.sort_values([*([] if nameless else [key]), "_us", "_none", order], kind="stable")
        names = [None] * len(rows) if nameless else rows[key].tolist()
        lists = {c: rows[c].tolist() for c in ("_us", *extra)}
        known, *fields = state.get if state.exists else ([], *[[]] * state_type.count(" "))
        states, columns = dict(zip(known, zip(*fields))), {c: [] for c in made}
        first = 0
        for last in range(1, len(names) + 1):
            if last == len(names) or names[last] != names[first]:
                part = {c: x[first:last] for c, x in lists.items()}
                new, states[names[first]] = advance(part, states.get(names[first]) or start(part))
                for c in made:
                    columns[c] += new[c]
                first = last
        state.update((list(states), *map(list, zip(*states.values()))))
        out = rows[[key, order]].assign(**columns)
        if whole and rows["_none"].any():
            out[order] = out[order].astype("object").where(~rows["_none"], None)
        yield out

    held = ", ".join("{} array<{}>".format(*field.split()) for field in state_type.split(", "))
    return timed.groupBy("_slot").applyInPandasWithState(
        run, f"`{key}` {kind[key]}, `{order}` {kind[order]}, {result}", f"names array<{kind[key]}>, {held}", "append", GroupStateTimeout.NoTimeout
    )


def cache_hits_stream(stream: DataFrame, key, ts, order, ttl_days=CACHE_TTL_DAYS) -> DataFrame:
    """Streaming form of :func:`classify_cache_hits`; the state of a key is the entry's expiry."""
    ttl = int(ttl_days * DAY_US)

    def advance(rows, state):
        free, hits = state[0], []
        for t in rows["_us"]:
            hits.append(t < free)
            free = free if t < free else t + ttl
        return {"is_hit": hits}, (free,)

    return _stateful(stream, key, ts, order, [], "is_hit boolean", "free long", lambda rows: (-(2**62),), advance)


def token_bucket_stream(stream: DataFrame, key, ts, order, rate=RATE, capacity=CAPACITY) -> DataFrame:
    """Streaming form of :func:`token_bucket`; the state is (tokens, last time)."""

    def advance(rows, state):
        flags, tokens, last = _take_tokens(rows["_us"], state[0], state[1], rate, capacity)
        return {"allowed": flags}, (float(tokens), int(last))

    return _stateful(
        stream, key, ts, order, [], "allowed boolean", "tokens double, last long",
        lambda rows: (capacity, int(rows["_us"][0])), advance,
    )


def adaptive_delay_stream(stream: DataFrame, domain, ts, order, status="status") -> DataFrame:
    """Streaming form of :func:`adaptive_delay`; the state is (delay, streak)."""

    def advance(rows, state):
        delay, streak = state
        delays, streaks = [], []
        for code in rows[status]:
            bad = code in (429, 0)
            delay = min(MAX_DELAY, delay * BACKOFF) if bad else max(MIN_DELAY, delay * RECOVER)
            streak = streak + 1 if bad else 0
            delays.append(delay)
            streaks.append(streak)
        return {"delay": delays, "streak": streaks}, (delay, streak)

    return _stateful(
        stream, domain, ts, order, [status], "delay double, streak int", "delay double, streak int",
        lambda rows: (START_DELAY, 0), advance,
    )
