"""Language by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

A text is cut into stretches of ``STRETCH`` bytes; the network reads every stretch in both directions
from a zero state and gives each position language probabilities. A document's probabilities are the
mean over its letter bytes, all of them. Arrays are laid out (features, stretches), so that a step
of the recurrence is one small matrix product over thousands of stretches.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import bytes_of, chunks, held_out, texts

#: Units per direction, bytes per stretch, the input that stands for nothing.
UNITS, STRETCH, NOTHING = 8, 128, 256
#: Learning: documents per language and stretches of each (``LEARN`` bytes), steps, stretches a step.
SAMPLE, PER_DOCUMENT, LEARN, STEPS, BATCH, RATE = 300, 4, 48, 350, 192, 0.02
#: Letters that the shares of the languages among what is learned from count as in a document's mean.
PRIOR = 3.0
#: Languages that can be learned at most; one model knows a fixed list.
LANGUAGES = 200
CHUNK = 1 << 19

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def start(languages, seed=3):
    """Random parameters: per direction inputs ``(3 * units, 257)`` and recurrence ``(3 * units, units)``; output layer."""
    rng = np.random.default_rng(seed)
    f = np.float32
    one = lambda: (rng.normal(0, 0.3, (3 * UNITS, 257)).astype(f), rng.normal(0, 0.3, (3 * UNITS, UNITS)).astype(f))
    return [*one(), *one(), rng.normal(0, 0.3, (languages, 2 * UNITS)).astype(f), np.zeros((languages, 1), f)]


def states(codes, inputs, recurrence, backward=False, trace=None):
    """Hidden states ``(steps, units, stretches)`` of one direction; ``trace`` collects what the way back needs.

    The first two thirds of the inputs are the update and the reset gate. Padding keeps the state zero.
    """
    steps, width = codes.shape
    out = np.empty((steps, UNITS, width), np.float32)
    h = np.zeros((UNITS, width), np.float32)
    real = (codes != NOTHING).astype(np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        x, u = inputs.take(codes[t], axis=1, mode="clip"), recurrence @ h
        gates = x[: 2 * UNITS]
        gates += u[: 2 * UNITS]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:UNITS], gates[UNITS:]
        n = x[2 * UNITS :]
        n += r * u[2 * UNITS :]
        np.tanh(n, out=n)
        if trace is not None:
            trace[t] = (h, z, r, n, u[2 * UNITS :])
        h = h - n
        h *= z
        h += n
        h *= real[t]
        out[t] = h
    return out


def probabilities(codes, model):
    """Language probabilities ``(steps, languages, stretches)`` of every position."""
    ahead, back = states(codes, *model[0:2]), states(codes, *model[2:4], backward=True)
    scores = model[4][:, :UNITS] @ ahead
    scores += model[4][:, UNITS:] @ back
    scores += model[5]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _gradient_of_direction(codes, recurrence, trace, slopes, backward):
    """Backpropagation through time of one direction: slopes of inputs and recurrence."""
    steps, width = codes.shape
    at_inputs = np.empty((steps, 3 * UNITS, width), np.float32)
    by_recurrence = np.zeros_like(recurrence)
    later = np.zeros((UNITS, width), np.float32)
    real = (codes != NOTHING).astype(np.float32)
    for t in range(steps) if backward else range(steps - 1, -1, -1):
        h, z, r, n, u = trace[t]
        d = (slopes[t] + later) * real[t]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        at_inputs[t] = np.concatenate([dz, dr, dn])
        down = np.concatenate([dz, dr, dn * r])
        by_recurrence += down @ h.T
        later = d * z + recurrence.T @ down
    flat = codes.ravel()
    order = np.argsort(flat, kind="stable")
    seen, first = np.unique(flat[order], return_index=True)
    by_inputs = np.zeros((257, 3 * UNITS), np.float32)
    by_inputs[seen] = np.add.reduceat(at_inputs.transpose(0, 2, 1).reshape(-1, 3 * UNITS)[order], first)
    return by_inputs.T, by_recurrence


def loss_and_gradient(codes, labels, model):
    """Mean cross-entropy over all real positions and its slopes for every parameter."""
    traces = [None] * len(codes), [None] * len(codes)
    ahead = states(codes, *model[0:2], trace=traces[0])
    back = states(codes, *model[2:4], backward=True, trace=traces[1])
    scores = model[4][:, :UNITS] @ ahead + model[4][:, UNITS:] @ back + model[5]
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    real = (codes != NOTHING)[:, None, :]
    own = np.arange(codes.shape[1])
    loss = -(np.log(p[:, labels, own] + 1e-12) * real[:, 0]).sum() / real.sum()
    d = p.copy()
    d[:, labels, own] -= 1
    d *= real / np.float32(real.sum())
    out = np.concatenate([(d @ ahead.transpose(0, 2, 1)).sum(0), (d @ back.transpose(0, 2, 1)).sum(0)], axis=1)
    first = _gradient_of_direction(codes, model[1], traces[0], model[4][:, :UNITS].T @ d, False)
    second = _gradient_of_direction(codes, model[3], traces[1], model[4][:, UNITS:].T @ d, True)
    return loss, [*first, *second, out, d.sum((0, 2))[:, None]]


def train(codes, labels, languages, steps=STEPS, batch=BATCH, seed=3):
    """Parameters after steps of adaptive gradient descent on random batches of stretches ``(LEARN, stretches)``."""
    rng, model = np.random.default_rng(seed), start(languages, seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model]
    for step in range(1, steps + 1):
        take = rng.integers(0, codes.shape[1], batch)
        _, slopes = loss_and_gradient(codes[:, take], labels[take], model)
        norm = np.sqrt(sum((g**2).sum() for g in slopes))
        rate = RATE * (1 - step / (steps + 1)) / max(1.0, norm)
        for p, g, (m, v) in zip(model, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def stretches(data, ends, size=STRETCH):
    """Codes ``(size, stretches)`` of all bytes, padded within each row's last stretch, and the row of each stretch."""
    lengths = np.diff(ends)
    number = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), number)
    if not len(row):
        return np.zeros((size, 0), np.int64), row
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    at = ends[row] + nth * size + np.arange(size)[:, None]
    return np.where(at < ends[row + 1], data[np.minimum(at, len(data) - 1)], NOTHING), row


def _learning_stretches(docs, seed, sample, per_document):
    """A bounded sample of stretches to learn from, about as many for each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and text <> ''").where(~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}, None, None
    languages = sorted(counts)
    share = F.create_map(*(x for c in languages for x in (F.lit(c), F.lit(min(1.0, sample / counts[c])))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    picked = known.where(F.try_element_at(share, F.col("lang")) > draw).limit(2 * sample * len(languages))

    def run(batches):
        for batch in chunks(batches):
            names, cut = [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                rng = np.random.default_rng(len(text))
                for at in rng.integers(0, max(1, len(text) - LEARN), per_document).tolist():
                    names.append(name)
                    cut.append(text[at : at + LEARN])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.binary())], ["lang", "bytes"])

    rows = sorted(tuple(r) for r in picked.select("lang", "text").mapInArrow(run, "lang string, bytes binary").collect())
    codes = np.full((LEARN, len(rows)), NOTHING, np.int64)
    for i, (_, b) in enumerate(rows):
        codes[: len(b), i] = np.frombuffer(bytes(b), np.uint8)
    return counts, codes, np.array([languages.index(name) for name, _ in rows])


def fit(docs: DataFrame, seed=3, sample=SAMPLE, per_document=PER_DOCUMENT):
    """(languages, their shares, parameters), learned from text and language of documents outside the held-out fold."""
    counts, codes, labels = _learning_stretches(docs, seed, sample, per_document)
    if not counts or not codes.shape[1]:
        return [], None, None
    shares = np.array([counts[c] for c in sorted(counts)], float)
    return sorted(counts), shares / shares.sum(), train(codes, labels, len(counts), seed=seed)


def pooled(data, ends, shares, model):
    """Mean language probabilities over the letter bytes of each row and a few letters' worth of ``shares``."""
    codes, row = stretches(data, ends)
    total = np.zeros((len(ends) - 1, len(shares)))
    if codes.shape[1]:
        p = probabilities(codes, model)
        weight = np.append(LETTER, False)[codes].astype(np.float32)
        by_stretch = np.einsum("tlw,tw->lw", p, weight)
        for k, values in enumerate(by_stretch):
            total[:, k] = np.bincount(row, values, minlength=len(total))
    total += PRIOR * shares
    return total / total.sum(1, keepdims=True)


def identify(docs: DataFrame, seed=3, sample=SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (its probability) of every document.

    Whole texts. ``und`` with score 0 for a null text, one without any letter, or if nothing could be
    learned. Ties go to the first language by code point. Only texts enter a prediction. One row per
    input row; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, seed, sample))

    def run(batches):
        languages, shares, model = shared.value
        for batch in chunks(batches, limit=CHUNK, rows=2048):
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if languages:
                p = pooled(*bytes_of(batch.column("text")), shares, model)
                best = p.argmax(1)
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if any(map(str.isalpha, text)):
                        names[i], scores[i] = languages[best[i]], min(1.0, p[i, best[i]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
