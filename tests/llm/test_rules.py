"""Quality rules: statistics by plain Python, paths by recursion, held-out verdicts, edge cases."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from awardlake.llm import rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é  \n\t\x0b\x85#|😀", max_size=60))
def test_statistics_of_any_text(text):
    assert rules.measure(text.encode())[0] == plain(text)


def test_statistics_of_many_words():
    rng = random.Random(1)
    for size in (3, 50, 5000):
        text = "".join(rng.choice([f"w{rng.randrange(size)} ", f"w{rng.randrange(size)}\n", "a b c "]) for _ in range(4000))
        assert rules.measure(text.encode())[0] == plain(text)


def plain_path(tree, row, at=0, depth=0):
    feature, cut, left, right, path = tree
    if feature[at] < 0:
        return depth, path[at]
    return plain_path(tree, row, (left if row[feature[at]] <= cut[at] else right)[at], depth + 1)


def test_scores_follow_the_paths_and_find_outliers():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(600, 3)), rng.normal(6, 0.2, (12, 3))])
    grown, expected = model = rules.forest(x, trees=40)
    scores = rules.anomaly(x, model)
    for i in (0, 77, 605):
        found = [plain_path(tree, x[i]) for tree in grown]
        assert all(depth <= path for depth, path in found) and scores[i] == 2.0 ** (-sum(p for _, p in found) / (40 * expected))
    assert scores[600:].min() > np.quantile(scores[:600], 0.97)
    again = rules.anomaly(x, rules.forest(x, trees=40))
    assert (again == scores).all()


def test_average_path_counts_comparisons():
    """Mean depth of a leaf in random binary search trees of n values."""
    rng, n = np.random.default_rng(3), 64

    def depths(values):
        if len(values) < 2:
            return [0] * len(values)
        cut = rng.choice(values)
        low = values[values < cut]
        return [d + 1 for d in depths(low) + depths(values[values > cut])] + [0]

    misses = []
    for _ in range(300):
        inner = depths(rng.permutation(n).astype(float))
        misses.append((sum(inner) + 2 * n) / (n + 1))
    assert abs(np.mean(misses) - rules.average_path(n + 1)) < 0.3


def test_calibration_loses_few_good_rows():
    scores, labels = np.array([0.1, 0.2, 0.3, 0.4, 0.8, 0.9]), np.array([1, 1, 1, 0, 0, 0])
    assert rules.calibrate(scores, labels, lost=0) == 0.35
    assert rules.calibrate(scores, 1 - labels, lost=0) == float("inf")
    assert rules.calibrate(scores[:3], labels[:3]) == float("inf") and rules.calibrate(np.zeros(2), np.array([0, 1])) == float("inf")


def text_of(rng, junk):
    words = [rng.choice(["plain", "words", "stand", "here", "number", "again"]) + str(rng.randrange(400)) for _ in range(rng.randrange(60, 400))]
    if junk:
        words = [w + rng.choice(["###", "$$$", "|"]) if rng.random() < 0.5 else w for w in words]
    return " ".join(words) + "."


def test_held_out_verdicts(spark):
    rng = random.Random(4)
    docs = [(i, text_of(rng, i % 7 == 0)) for i in range(2500)]
    labels = [(i, int(i % 7 > 0)) for i in range(2500)]
    found = rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    from awardlake.llm.common import held_out

    held = {r.doc_id for r in spark.createDataFrame(labels, "doc_id long, quality int").where(held_out()).collect()}
    mine = found[found.doc_id.isin(held)]
    good, bad = mine[mine.doc_id % 7 > 0], mine[mine.doc_id % 7 == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1
    by_id = found.set_index("doc_id")
    for i, text in docs[:60]:
        assert tuple(by_id.loc[i, list(rules.STATISTICS)]) == plain(text)


def test_nulls_long_texts_repeats_no_labels_and_empty_tables(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    rows = [(1, None, 1), (None, "", 2), (2, long, 3), (2, long, 3), (3, "same three words " * 40, 4), (4, " ".join(map(str, range(50))), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    found = rules.judge(docs, none).collect()
    assert len(found) == 6
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].base_failed and by_id[None].base_failed and not by_id[1].kept and by_id[1].n_words == 0
    assert by_id[2].kept and by_id[2].n_words == 300_000 and by_id[3].base_failed and by_id[3].n_repeat_words == 120
    assert by_id[4].kept and not by_id[4].base_failed
    assert rules.judge(docs.limit(0), none).collect() == [] and len(rules.judge(docs, none.limit(0)).collect()) == 6


def test_all_labelled_documents_are_learned_from(spark):
    """More documents a class than the sample of old: every one is counted in every tree and in the thresholds."""
    n = 9000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60 + cast(id % 7 AS int)), x -> concat('w', (x * 31 + id) % 97))) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    rows = rules.labelled(rules.measured(docs), labels, "quality").cache()
    from awardlake.llm.common import held_out

    assert rows.count() == labels.where(~held_out()).count() > 7000
    root = rules._spans_of(rows)([(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.array([True]))])
    assert root.shape == (1, 3 + 2 * len(rules.FEATURES)) and root[0, 2] == rows.count()
    x = rows.select(*rules.FEATURES).toPandas().to_numpy()
    here, there = rules.forest(x, trees=3), rules.grow(rules._spans_of(rows), len(rules.FEATURES), trees=3)
    assert here[1] == there[1] and all((a == b).all() for t, u in zip(here[0], there[0]) for a, b in zip(t, u))


def test_calibration_on_counted_steps():
    scores, labels, counts = np.array([0.25, 0.5, 0.5, 0.75]), np.array([1, 1, 0, 0]), np.array([990, 10, 3, 40])
    assert rules.calibrate(scores, labels, lost=0.005, counts=counts) == 0.75 and rules.calibrate(scores, labels, lost=0.02, counts=counts) == 0.5
