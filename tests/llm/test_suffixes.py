"""Repeated 100-byte strings against a table of all windows."""

import hashlib
import random

import pytest

from awardlake.llm import suffixes


def brute(rows, length=100):
    first, out = {}, {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in first:
                gone[p : p + length] = b"\1" * length
            else:
                first[w] = doc
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh éß🙂\n"
    words = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 70))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 60))))
        if rng.random() < 0.1:
            parts.append(rng.choice(words) * rng.randint(20, 120))
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(letters)
            text = "".join(text)
        rows.append((i * 7 % 1009, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_match_all_windows(spark, seed):
    data = corpus(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in suffixes.digests(docs).collect()}
    assert got == brute(data)


@pytest.mark.parametrize("at_once", [1, 3])
def test_windows_that_travel_as_digests_give_the_same(spark, at_once):
    data = corpus(5)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r[1:]) for r in suffixes.digests(docs, at_once=at_once).collect()} == brute(data)


def test_one_line_in_many_contexts(spark):
    rng = random.Random(6)
    line, letters = "the very same line of forty bytes, always", "abcdefghijklmnopqrstuvwxyz "
    random_text = lambda n: "".join(rng.choices(letters, k=n))
    contexts = [[random_text(70), random_text(70)] for _ in range(200_000)]
    shared = list(range(100, 200_000, 5000))
    for i in shared:
        left, right = rng.choice([(35, 40), (70, 10), (0, 70), (20, 30)])
        earlier = contexts[i - 100]
        contexts[i] = [contexts[i][0][: 70 - left] + earlier[0][70 - left :], earlier[1][:right] + contexts[i][1][right:]]
    data = [(i, a + line + b) for i, (a, b) in enumerate(contexts)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digests(spark.createDataFrame(data, "doc_id long, text string").repartition(8)).collect()}
    near = brute([data[j] for i in shared for j in (i - 100, i)])
    assert any(v[1] for v in near.values())
    for i, text in data:
        assert got[i] == near.get(i, (len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest()))


def test_small_runs_and_blocks_change_nothing(spark, monkeypatch):
    data = corpus(4)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    text = "".join(t for _, t in data).encode()
    import numpy as np

    ends = np.array([0, len(text)])
    parts = suffixes.anchors(np.frombuffer(text, np.uint8), ends, 100)
    monkeypatch.undo()
    whole = suffixes.anchors(np.frombuffer(text, np.uint8), ends, 100)
    expand = lambda found: {p: (x, h) for _, x, lo, hi, h in zip(*(f.tolist() for f in found)) for p in range(lo, hi + 1)}
    assert expand(parts) == expand(whole) and len(expand(whole)) == len(text) - 99


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(1)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 40))) for _ in range(7)]
    coded = [[(suffixes._shared_prefix(a, b, 0), b, 0, None) for a, b in zip([b"", *run], run)] for run in runs]
    out = list(suffixes.merged(coded))
    assert [x[1] for x in out] == sorted(k for run in runs for k in run)
    assert all(x[0] == suffixes._shared_prefix(a[1], x[1], 0) for a, x in zip(out, out[1:]))


def test_nulls_empty_repeats_clashing_columns(spark):
    line = "".join(random.Random(9).choices("abcdefghijkl", k=130))
    long = "".join(random.Random(2).choices("abcdefghij ", k=300000))
    data = [(1, line, "a"), (2, "x" + line + "é", "b"), (3, None, "c"), (4, "", "d"), (None, line, "e"), (5, long, "f"), (6, long, "g"), (7, "aa" * 80, "h"), (8, "zq", "i"), (8, "zq", "j")]
    docs = spark.createDataFrame(data, "doc_id long, text string, starts string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in suffixes.digests(docs).collect()}
    assert got == {(1, 130): (0, 0), (2, 133): (130, 1), (3, 0): (0, 0), (4, 0): (0, 0), (None, 130): (130, 1), (5, 300000): (0, 0), (6, 300000): (300000, 1), (7, 160): (159, 1), (8, 2): (0, 0)}
    kept = {r.starts: r.text for r in suffixes.without_repeats(docs).collect()}
    assert (kept["a"], kept["b"], kept["c"], kept["g"], kept["i"], kept["j"]) == (line, "xé", None, "", "zq", "zq")
    assert suffixes.digests(docs.limit(0)).collect() == []
