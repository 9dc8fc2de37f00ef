"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings. One weight per feature is shared by all grades; ordered
thresholds cut the one score into grades, so P(grade >= k) = sigmoid(score - threshold_k), and the
expected severity is the sum of these. Labels only tell toxic from clean: grade 0 is clean, and the
toxic documents are graded by how many telling features they hold, cut at the quantiles.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import LOWER, Rolling, bytes_of, chunks, cut, held_out, labelled_sample, mix, small_batches, texts, words_of

#: Labelled documents per class that are learned from at most; features kept; grades above clean.
SAMPLE, FEATURES, GRADES = 3000, 4096, 3
#: Probability of any toxicity from which a filter rejects a document.
REJECT = 0.3
#: Bytes of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
STEPS, RATE, DECAY = 400, 0.05, 1e-4

#: Bytes outside words: ASCII without letters.
BREAK = np.ones(256, bool)
BREAK[97:123] = False
BREAK[128:] = False
SLOT_BITS = 20


def features_of(data, ends):
    """Row and 64-bit feature hash of every word and word beginning."""
    data = LOWER[data]
    first, last, row = words_of(data, ends, BREAK)
    rolling = Rolling(data)
    rows, found = [row], [rolling.hash(first, last)]
    for size in BEGINNINGS:
        long = last - first > size
        rows.append(row[long])
        found.append(mix(rolling.hash(first[long], first[long] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(found)


def _sampled_features(docs, labels, label, sample) -> DataFrame:
    """``label``, distinct ``features`` with their ``counts`` of each sampled document; stays in the cluster, however long the texts."""

    def run(batches):
        for batch in chunks(batches):
            rows, found = features_of(*bytes_of(batch.column("text")))
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            sets = [np.unique(found[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([u.view(np.int64) for u, _ in sets], pa.list_(pa.int64())),
                pa.array([c.astype(np.int32) for _, c in sets], pa.list_(pa.int32())),
            ], ["label", "features", "counts"])

    picked = labelled_sample(docs, labels, label, sample)
    return cut(picked.mapInArrow(run, "label int, features array<long>, counts array<int>"))


def select(rows: DataFrame, totals, keep=FEATURES, least=3):
    """The features that tell the classes apart best (likelihood ratio) in ``least`` documents or more, their log-odds, and a scale.

    Counted and ranked in the cluster; only ``keep`` features are fetched. The scale (root of the relative
    gain) keeps the many features that tell little from fitting chance.
    """
    of = lambda c: F.count_if(F.col("label") == c).alias(f"n{c}")
    counted = rows.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(of(0), of(1))
    pooled = (F.col("n0") + F.col("n1") + 0.5) / (sum(totals) + 1.0)
    gain = F.lit(0.0)
    for c, total in enumerate(totals):
        share = (F.col(f"n{c}") + 0.5) / (total + 1.0)
        gain = gain + F.col(f"n{c}") * F.log(share / pooled) + (float(total) - F.col(f"n{c}")) * F.log((1 - share) / (1 - pooled))
    told = counted.where(F.col("n0") + F.col("n1") >= least).withColumn("gain", gain).where("gain >= 0")
    best = told.orderBy(F.desc("gain"), "feature").limit(keep).toPandas()
    known = best["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    seen, gain = best[["n0", "n1"]].to_numpy(float).T[:, order], best["gain"].to_numpy(float)[order]
    share = (seen + 0.5) / (np.array(totals, float)[:, None] + 1)
    odds = np.log(share[1] / (1 - share[1])) - np.log(share[0] / (1 - share[0]))
    return known[order], odds, np.sqrt(gain / max(gain.max(initial=0.0), 1e-9))


def _chosen_features(rows: DataFrame, chosen):
    """(labels, places among ``chosen``, counts) of the sampled documents, in an order that their content alone decides."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        known = shared.value
        for batch in batches:
            places, counts = [], []
            for features, number in zip(batch.column("features"), batch.column("counts")):
                features = features.values.to_numpy().view(np.uint64)
                at = np.searchsorted(known, features).clip(max=max(len(known) - 1, 0))
                hit = known[at] == features if len(known) else np.zeros(len(features), bool)
                places.append(at[hit].astype(np.int32).tobytes())
                counts.append(number.values.to_numpy()[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["label", "places", "counts"])

    found = rows.mapInArrow(run, "label int, places binary, counts binary").toArrow().to_pydict()
    ordered = sorted(zip(found["label"], found["places"], found["counts"]))
    labels = np.array([x for x, _, _ in ordered], int)
    return labels, [np.frombuffer(p, np.int32) for _, p, _ in ordered], [np.frombuffer(c, np.int32) for _, _, c in ordered]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(index, values, starts, grades, size, levels, steps=STEPS):
    """Weights and ordered thresholds by gradient steps on the cumulative-link likelihood."""
    n = len(grades)
    row = np.repeat(np.arange(n), np.diff(starts))
    target = grades[:, None] >= np.arange(1, levels + 1)
    # thresholds are the first one and positive steps, kept as logarithms, so that they stay ordered
    params = [np.zeros(size), np.array([1.0]), np.zeros(levels - 1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        weights, base, gaps = params
        score = np.bincount(row, values * weights[index], minlength=n)
        cuts = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        # probability of each grade is a difference of neighbouring cumulative ones
        above = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - cuts), np.zeros((n, 1))], axis=1)
        own = np.arange(n), grades
        high, low = above[own], above[np.arange(n), grades + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        by_score = -(d_high - d_low) / n
        by_cut = np.zeros(levels + 2)
        np.add.at(by_cut, grades, d_high / n)
        np.add.at(by_cut, grades + 1, -d_low / n)
        by_cut = by_cut[1 : levels + 1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        slopes = [
            np.bincount(index, values * by_score[row], minlength=size) + DECAY * weights,
            np.array([by_cut.sum()]), tail[1:] * np.exp(gaps),
        ]
        for p_, g, m in zip(params, slopes, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p_ -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    weights, base, gaps = params
    return weights, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, label="toxic", sample=SAMPLE, grades=GRADES):
    """(features, weights, thresholds) from at most ``sample`` documents of each class, or None without both classes."""
    rows = _sampled_features(docs, labels, label, sample)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    chosen, odds, scale = select(rows, [sizes[0], sizes[1]])
    known, places, counts = _chosen_features(rows, chosen)
    index, values, starts, telling = [], [], [0], []
    for at, c in zip(places, counts):
        index.append(at)
        values.append(np.log1p(c) * scale[at])
        starts.append(starts[-1] + len(at))
        telling.append(float(c[odds[at] > 2].sum()))
    telling = np.array(telling)
    cuts = np.quantile(telling[known == 1], [k / grades for k in range(1, grades)])
    grade = np.where(known == 1, 1 + np.searchsorted(cuts, telling, "left"), 0)
    weights, thresholds = train(np.concatenate(index), np.concatenate(values), np.array(starts), grade, len(chosen), grades)
    return chosen, weights * scale, thresholds


def _cumulative(model):
    """Function from an Arrow batch with ``text`` to P(grade >= k) of its rows, for whole texts."""
    chosen, weights, thresholds = model if model is not None else (np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0))
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    slots = (chosen >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    known, number = np.unique(slots, return_counts=True)
    table[slots] = np.arange(len(chosen))
    table[known[number > 1]] = -2  # several features share the slot: looked up one by one

    def above(batch):
        rows, found = features_of(*bytes_of(batch.column("text")))
        at = table[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        rows, found, at = rows[at != -1], found[at != -1], at[at != -1]
        total = np.zeros(batch.num_rows)
        if len(at):
            at = np.where(at == -2, np.searchsorted(chosen, found).clip(max=len(chosen) - 1), at)
            hit = chosen[at] == found
            pair, count = np.unique(rows[hit] * len(chosen) + at[hit], return_counts=True)
            total = np.bincount(pair // len(chosen), np.log1p(count) * weights[pair % len(chosen)], minlength=batch.num_rows)
        return _sigmoid(total[:, None] - thresholds)

    return above


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (thresholds passed), ``toxic`` (P(grade >= 1)).

    Whole texts; null or empty texts have no features and get the severity of an empty text. Without
    a model (no labels of both classes) everything is clean.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cumulative = _cumulative(shared.value)
        for batch in chunks(batches):
            above = cumulative(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0])],
                ["doc_id", "severity", "grade", "toxic"])

    return texts(docs).mapInArrow(run, "doc_id long, severity double, grade int, toxic double")


def without_toxic(docs: DataFrame, labels: DataFrame, label="toxic", sample=SAMPLE, reject=REJECT) -> DataFrame:
    """The documents, all columns and rows in place, whose P(grade >= 1) stays below ``reject``; null texts stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, sample))

    def run(batches):
        cumulative = _cumulative(shared.value)
        for batch in chunks(batches):
            yield batch.filter(pa.array(cumulative(batch)[:, 0] < reject))

    return docs.mapInArrow(run, docs.schema)


def severity(docs: DataFrame, labels: DataFrame, label="toxic", sample=SAMPLE) -> DataFrame:
    """Severity of every document; learned from a bounded sample of labels outside the held-out fold.

    ``doc_id``, ``held_out``, ``severity``, ``grade``, ``toxic``. One row per input row, nulls, ties and
    repeated rows included; other columns are ignored; an empty table gives an empty result.
    """
    found = score(docs, fit(docs, labels, label, sample))
    return found.select("doc_id", held_out().alias("held_out"), "severity", "grade", "toxic")

