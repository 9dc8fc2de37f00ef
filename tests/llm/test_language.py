"""Byte recurrent network: slopes, one position by hand, held-out accuracy, edge cases."""

import random

import numpy as np

from awardlake.llm import language


def test_slopes_match_differences():
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 103, (9, 5))
    codes[6:, 2] = language.NOTHING
    labels, model = rng.integers(0, 3, 5), [p.astype(np.float64) for p in language.start(3)]
    _, slopes = language.loss_and_gradient(codes, labels, model)
    for p, g in zip(model, slopes):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            at = (at[0], int(rng.choice(codes.ravel()))) if p.shape[1] == 257 else at
            old = p[at]
            p[at] = old + 1e-3
            up = language.loss_and_gradient(codes, labels, model)[0]
            p[at] = old - 1e-3
            down = language.loss_and_gradient(codes, labels, model)[0]
            p[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_positions_match_a_scalar_network():
    model, text = language.start(4), b"h\xc3\xa9llo w"
    codes = np.frombuffer(text, np.uint8).astype(np.int64)[:, None]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(inputs, recurrence, sequence):
        h, out = np.zeros(language.UNITS), []
        for c in sequence:
            x, u, k = inputs[:, c], recurrence @ h, language.UNITS
            z, r = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(x[2 * k :] + r * u[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    ahead, back = run(*model[0:2], text), run(*model[2:4], text[::-1])[::-1]
    got = language.probabilities(codes, model)[:, :, 0]
    for t in range(len(text)):
        scores = model[4] @ np.concatenate([ahead[t], back[t]]) + model[5][:, 0]
        want = np.exp(scores - scores.max())
        assert np.allclose(got[t], want / want.sum(), atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "té"], "bb": ["sch", "ung", "ver", "ß"], "cc": ["ing", "the", "wh", "on"]}
    rows = []
    for i in range(700):
        name = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))
        rows.append((i, text, name, "x"))
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 !!", "bb", "x"), (None, "ka lo mi", None, "x"), (903, "schung ver " * 30000, "bb", "x"), (904, "é", None, "y"), (904, "é", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in rows[:700] if found[r[0]].held_out]
    assert len(held) > 80 and np.mean([found[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found.values()) and found[904].lang_pred in syllables
    assert language.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang_pred.substr(9, 1)).where("doc_id < 0")).collect()} <= {"und"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs).collect()] == [("und", 0.0)]
