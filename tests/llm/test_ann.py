"""Cross-polytope search against all inner products."""

import numpy as np
import pytest

from awardlake.llm import ann


def brute(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            scores = sorted((-float((w * v).sum()), i) for i, w in usable if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_hadamard_keeps_lengths_and_axes_are_nearest():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(ann.hadamard(y), x)
    axes = ann.nearest_axes(y, 32)
    values = np.stack([y, -y], 2).reshape(5, -1)
    assert (np.diff(np.take_along_axis(values, axes, 1)) <= 0).all()


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, unit):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 2, (1500, 1))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    want = brute(rows, 20)
    got = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 20 = 0").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hits = 0
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(found, found[1:]))
        hits += len({i for i, _, _ in found} & {i for i, _ in want[q]})
        assert all(abs(s - float((np.array(rows[i][1]) * np.array(rows[q][1])).sum())) < 1e-12 for i, s, _ in found)
    assert len(got) == 75 and hits >= 0.9 * 75 * 20


def test_copies_ties_small_blocks_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 3)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    same = [0.5, 0.5, 0.5, 0.5]
    rows = [(i, same) for i in range(0, 100)] + [(200 + i, [0.1 * (i % 7), -0.2, 0.3 * (i % 3), 1.0]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 4), (402, [None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0]), (None, same), (405, [1.0, 2.0]), (5, same)]
    want = brute([r for r in rows if r[0] != 405], 20)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.search(docs, "id % 20 = 0", tables=4, probes=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q in want}
    for q in (0, 20, 40, 60, 80):
        first = [i for i in range(100) if i != q][:20]
        assert [v for _, v, _ in sorted(got[q])] == first
    assert [v for _, v, _ in sorted(got[200])] == [i for i, _ in dict((i, s) for i, s in want[200]).items()][:20]
    assert ann.search(docs.limit(0), "id % 20 = 0").collect() == []


def recall(spark, x, **more):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    want = brute(rows, 20)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", **more).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = [len(got.get(q, set()) & {i for i, _ in near}) / len(near) for q, near in want.items()]
    assert all(len(got.get(q, ())) == len(near) for q, near in want.items())
    return sum(shares) / len(shares)


@pytest.mark.parametrize("components", [64, 300])
@pytest.mark.parametrize("norms", ["unit", "one long", "log-normal"])
def test_recall_at_real_width_with_skewed_norms(spark, monkeypatch, components, norms):
    monkeypatch.setattr(ann, "WHOLE", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, components))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one long":
        x[7] *= 20
    if norms == "log-normal":
        x *= np.exp(rng.normal(size=(2000, 1)))
    assert recall(spark, x) >= 0.93


def test_small_ranges_are_met_whole(spark):
    x = np.random.default_rng(4).normal(size=(2000, 64)) * np.exp(np.random.default_rng(5).normal(size=(2000, 1)))
    assert recall(spark, x) == 1
    assert recall(spark, x[:15] / np.linalg.norm(x[:15], axis=1, keepdims=True)) == 1


def test_queries_go_on_until_they_meet_enough_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "WHOLE", 0)
    monkeypatch.setattr(ann, "SENT", 7)
    x = np.random.default_rng(6).normal(size=(15, 64))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) == 1
    x = np.random.default_rng(7).normal(size=(300, 64)) * 0.01 + np.eye(64)[0]
    x[::20] -= 2 * np.eye(64)[0]
    recall(spark, x, tables=1, probes=1)
