"""Near-duplicates against a brute-force comparison of all pairs."""

import random

import pytest

from awardlake.llm import minhash
from awardlake.llm.components import stars
from awardlake.llm.minhash import near_duplicates


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(vocabulary, k=40)
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            base = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            text = " ".join(base)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 60, 120])) + (passage if kind < 0.8 else []))
        rows.append((i * 3 % 1009, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, rows, seed):
    data = corpus(seed, 220)
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), words=4)
    assert rows(got) == sorted(brute(data, 4, 80), key=repr)


@pytest.mark.parametrize("block", [2048, 40])
def test_one_large_group_of_near_copies_and_a_shared_passage(spark, rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    data = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 8])):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(copy)))
    data += [(1000 + i, " ".join([f"y{i}_{j}" for j in range(50)] + base[:60])) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), words=4)
    assert rows(got) == sorted(brute(data, 4, 80), key=repr)


def test_nulls_empty_texts_repeats_and_clashing_columns(spark, rows):
    long = " ".join(f"z{i % 9999}" for i in range(60000))
    data = [(5, None, 1), (6, "", 2), (7, " \t\n", 3), (8, "A b", 4), (2, "a  B", 5), (None, "a b", 6), (9, long, 7), (9, long, 8), (10, long + " q", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, node int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(docs, words=4).collect())
    assert got == [
        (-1, None, True), (2, 2, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 2, False),
        (9, 9, True), (9, 9, True), (10, 9, False)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_stars_on_a_path_a_hub_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7)]
    found = {r.node: r.root for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 0 for i in range(1, 50)}
    assert stars(spark.createDataFrame([], "u long, v long")).collect() == []
