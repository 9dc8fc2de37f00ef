"""Quality voting: exact cosines, held-out accuracy, edge cases."""

import random

import numpy as np

from awardlake.llm import quality


def test_votes_match_a_plain_computation():
    rng = np.random.default_rng(5)
    known, own = quality.unit(rng.normal(size=(60, 8))), quality.unit(rng.normal(size=(20, 8)))
    labels = rng.integers(0, 2, 60)
    want = []
    for v in own:
        cosine = [float(v @ k) for k in known]
        near = sorted(range(60), key=lambda i: -cosine[i])[:7]
        weight = [max(cosine[i], 1e-6) ** quality.POWER for i in near]
        want.append(sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight))
    assert np.allclose(quality.votes(own, known, labels, 7), want)


def test_latent_space_spans_the_largest_singular_values():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 40)) + 1e-3 * rng.normal(size=(80, 40))
    basis = quality.latent_space(x, 5)
    assert np.linalg.norm(x - x @ basis @ basis.T) < 0.2


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(800):
        good = rng.random() < 0.8
        picked = rng.choices(words, k=rng.randint(20, 80))
        text = " ".join(picked) if good else rng.choice([" ".join(w.upper() + "!!" for w in picked), " ".join(w for w in picked[:6] for _ in range(15))])
        docs.append((i, text))
        labels.append((i, int(good)))
    found = quality.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    held = found[found.held_out].merge(spark.createDataFrame(labels, "doc_id long, label int").toPandas())
    assert len(held) > 100 and (held.predicted == held.label).mean() > 0.97
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_nulls_no_labels_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "aé " * 100000, 3), (2, "x", 4), (2, "x", 5), (3, "good words here", 6)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 6
    some = spark.createDataFrame([(1, 0), (3, 1), (2, 1)], "doc_id long, quality int")
    found = quality.score(docs, some).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert quality.score(docs.limit(0), some).collect() == []
