"""Mixing: targets, budgets, epochs, edge cases."""

import random

from awardlake.llm import mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by literal resharing, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if got[s] + level * weight[s] >= cap * sizes[s]}
        for s in free:
            got[s] += level * weight[s]
        left = sum(got[s] - cap * sizes[s] for s in over)
        for s in over:
            got[s] = cap * sizes[s]
        free -= over
    return got


def test_targets_budgets_and_reruns(spark):
    rng = random.Random(3)
    names = ["b", "a", "é", "c", "zz", None, "ü", "d"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 300]) + "x" * (i % 2), names[min(rng.randrange(14), 7) if i % 3 else 0]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.allotment(docs).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    want = filled(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
        epochs = int(target[s] // sizes[s])
        assert all(r.taken >= epochs * r.size and r.source_size == sizes[s] for r in got if source[r.doc_id] == s)
    assert sorted(got) == sorted(mixing.allotment(docs.repartition(2)).collect())


def test_heavier_documents_come_earlier(spark):
    rows = [(i, "word!! " * 10 if i % 2 else "word " * 10, "s" if i < 4000 else "t") for i in range(4400)]
    got = mixing.allotment(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    extra = [sum(r.taken % 20 == 0 and r.taken == 20 for r in got if r.doc_id % 2 == odd) for odd in (0, 1)]
    assert sum(r.taken for r in got) > 0 and extra[0] != extra[1]


def test_nulls_empty_sources_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 2), (3, "x y", None, 3), (3, "x y", None, 4), (None, "q", "b", 5), (4, "w " * 90000, "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    got = mixing.allotment(docs).collect()
    assert len(got) == 6 and sorted(r.size for r in got) == [0, 0, 1, 2, 2, 90000]
    assert all(r.target == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r.bin for r in mixed.collect()} <= {3, 4, 5, 6}
    assert mixing.allotment(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_documents_of_the_mix_follow_the_allotment(spark):
    rng = random.Random(12)
    rows = [(rng.choice([i, i, i, 7, None]), " ".join(rng.choices(["w", "x!", "yy"], k=rng.choice([0, 1, 9, 40]))) + f" {i}" * (i % 3), rng.choice(["a", "b", None, "c"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    size = lambda text: len(text.split())
    total, got = {}, {}
    for r in mixing.mixed(docs).collect():
        total[r.source] = total.get(r.source, 0) + size(r.text)
        got[r.doc_id, r.text, r.source] = got.get((r.doc_id, r.text, r.source), 0) + 1
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = filled(sizes)
    assert all(abs(total[s] - want[s]) <= 45 for s in sizes)
    lone = [r for r in mixing.mix(mixing.sized(docs)).collect() if r.doc_id not in (7, None)]
    for r in lone:
        copies = got.get((r.doc_id, r.document.text, r.source), 0)
        assert copies == (r.epochs + (2 * r.part >= r.size) if r.size else 0)
    assert {k: v for k, v in got.items()} == {k: v for k, v in _counted(mixing.mixed(docs.repartition(2))).items()}


def _counted(df):
    out = {}
    for r in df.collect():
        out[r.doc_id, r.text, r.source] = out.get((r.doc_id, r.text, r.source), 0) + 1
    return out


def test_texts_of_the_mix_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    assert "Exchange hashpartitioning" not in mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for df in (mixing.allotment(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
