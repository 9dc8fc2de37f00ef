"""Ordinal toxicity: likelihood, ordered thresholds, held-out accuracy, edge cases."""

import random

import numpy as np

from awardlake.llm import toxicity


def likelihood(weights, thresholds, x, grades):
    above = 1 / (1 + np.exp(-(x @ weights)[:, None] + thresholds))
    above = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
    return np.log(above[np.arange(len(x)), grades] - above[np.arange(len(x)), grades + 1]).mean()


def test_training_orders_thresholds_and_beats_other_parameters():
    rng = np.random.default_rng(1)
    x = rng.poisson(0.7, (800, 6)).astype(float)
    latent = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0]) + rng.logistic(size=800)
    grades = np.searchsorted([1.0, 2.5, 4.0], latent)
    rows, index = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(801))
    weights, thresholds = toxicity.train(index, x[rows, index], starts, grades, 6, 3, steps=1500)
    assert (np.diff(thresholds) > 0).all() and abs(weights[0] - 2) < 0.5
    best = likelihood(weights, thresholds, x, grades)
    for _ in range(50):
        assert best >= likelihood(weights + rng.normal(0, 0.2, 6), thresholds + np.sort(rng.normal(0, 0.1, 3)), x, grades) - 1e-3


def test_held_out_accuracy_and_severity(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        bad = rng.choice([0, 0, 1, 3, 8])
        text = rng.choices(words, k=60) + rng.choices(["scumbag", "vileness", "nastyperson"], k=bad)
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad > 0)))
    found = toxicity.severity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    held = found[found.held_out].merge(spark.createDataFrame(labels, "doc_id long, label int").toPandas())
    assert len(held) > 200 and ((held.toxic >= 0.5) == (held.label == 1)).mean() > 0.98
    counts = np.array([sum(w in ("scumbag", "vileness", "nastyperson") for w in t.split()) for _, t in docs])
    by_count = [found.set_index("doc_id").severity[np.flatnonzero(counts == c)].mean() for c in (0, 1, 3, 8)]
    assert by_count == sorted(by_count) and found.severity.between(0, 3).all()


def test_nulls_no_labels_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "aé " * 100000, 3), (2, "x", 4), (2, "x", 5)], "doc_id long, text string, grade int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    found = toxicity.severity(docs, none).collect()
    assert len(found) == 5 and all(r.toxic < 0.01 and r.grade == 0 for r in found)
    assert toxicity.severity(docs.limit(0), none).collect() == []


def plain_features(text):
    """Words (runs of letters outside ASCII's other characters) and beginnings of longer ones, by their bytes."""
    import re

    out = []
    for word in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()):
        out.append((0, word))
        out += [(n, word[:n]) for n in toxicity.BEGINNINGS if len(word) > n]
    return out


def test_scores_by_plain_counting():
    import pyarrow as pa

    from awardlake.llm.common import bytes_of

    rng = random.Random(5)
    words = ["bad", "badly", "badness", "BADNESSES", "good", "élan", "élans", "x1y", "don't"]
    texts = ["", "bad " * 50, *(" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(40))]
    column = pa.array(texts)
    rows, hashes = toxicity.features_of(*bytes_of(column))
    by_hash, by_name = {}, {}
    for i, text in enumerate(texts):
        names = plain_features(text)
        mine = hashes[rows == i].tolist()
        assert sorted(mine.count(h) for h in set(mine)) == sorted(names.count(n) for n in set(names))
        by_hash[i], by_name[i] = mine, names
    lone = {w: toxicity.features_of(*bytes_of(pa.array([w])))[1][0] for w in ("bad", "badly", "good", "élan")}
    weights = dict(zip(lone, (1.5, -0.7, 0.2, 3.0)))
    chosen = np.array(sorted(lone.values()), np.uint64)
    model = chosen, np.array([weights[next(w for w in lone if lone[w] == c)] for c in chosen]), np.array([0.5, 1.0, 4.0])
    above = toxicity._cumulative(model)(pa.RecordBatch.from_arrays([column], ["text"]))
    for i in range(len(texts)):
        score = sum(weights[w] * np.log1p(by_name[i].count((0, w.encode()))) for w in lone)
        assert np.allclose(above[i], 1 / (1 + np.exp(-(score - model[2]))))


def test_chosen_features_and_reruns(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in "abcdefgh"], k=20) + (["vile"] if i % 2 else []))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    first, second = (toxicity.fit(frame.repartition(n), labels) for n in (3, 7))
    assert all((a == b).all() for a, b in zip(first, second))
    rows = toxicity._sampled_features(frame, labels, "toxic", 400)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    known, odds, scale = toxicity.select(rows, [sizes[0], sizes[1]], keep=1)
    import pyarrow as pa

    from awardlake.llm.common import bytes_of

    assert known.tolist() == [toxicity.features_of(*bytes_of(pa.array(["vile"])))[1][0]] and odds[0] > 2 and scale.tolist() == [1.0]
