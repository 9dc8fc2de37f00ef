"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of word shapes; a truncated singular value
decomposition of a bounded labelled sample gives the latent space. The sample's vectors are
broadcast (their number and length are parameters), every document is compared with all of them by
exact cosines in blocks, and the nearest vote with their label, weighted by similarity.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import Rolling, bytes_of, chunks, held_out, labelled_sample, texts, words_of

#: Labelled documents per class, latent dimensions, neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 1500, 64, 15
#: Hashed trigrams and word shapes; documents handled in one block.
TRIGRAMS, SHAPES, ROWS = 4096, 64, 256
#: Similarity enters a vote with this power, so that near neighbours count more.
POWER = 4


def counts_of(data, ends):
    """Counts of hashed trigrams and word shapes: one row of floats per text."""
    n, width = len(ends) - 1, TRIGRAMS + SHAPES
    wide = data.astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(ends))
    codes = (wide[:-2] * 7919 + wide[1:-1] * 104729 + wide[2:] * 1299709) % 65521 % TRIGRAMS if len(data) > 2 else wide[:0]
    inside = row[2:] == row[: len(codes)] if len(data) > 2 else np.zeros(0, bool)
    cells = [row[: len(codes)][inside] * width + codes[inside]]
    first, last, of = words_of(data, ends)
    if len(first):
        hashes = Rolling(data).hash(first, last)
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])])
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
        capital, capitals = upper[first], np.add.reduceat(upper, first) >= 2
        sums = np.concatenate([[0], np.cumsum(~letter)])
        symbols = np.minimum(sums[last] - sums[first], 3)
        length = np.minimum((last - first) // 8, 1)
        shape = same + 2 * capital + 4 * capitals + 8 * symbols + 32 * length
        cells.append(of * width + TRIGRAMS + shape)
    return np.bincount(np.concatenate(cells), minlength=n * width).reshape(n, width).astype(np.float32)


def scaled(counts, idf):
    """Square roots of relative frequencies, each kind weighted and scaled to length one."""
    out = counts * 1.0
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, None)):
        x = np.sqrt(out[:, part] / np.maximum(out[:, part].sum(1, keepdims=True), 1)) * idf[part]
        out[:, part] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def latent_space(x, dimensions, seed=1, rounds=4):
    """Right singular vectors of the largest singular values, by subspace iteration."""
    basis = np.random.default_rng(seed).normal(size=(x.shape[1], min(dimensions, *x.shape)))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    return basis.astype(np.float32)


def votes(vectors, known, labels, neighbours, own=False):
    """Share of label 1 among the nearest known vectors, weighted by similarity; ``own``: a vector does not vote for itself."""
    cosine = vectors @ known.T
    if own:
        np.fill_diagonal(cosine, -1)
    k = min(neighbours, known.shape[0] - own)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** POWER
    return (weight * labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, label="quality", sample=SAMPLE):
    """Model from at most ``sample`` labelled documents per class, or None without both classes.

    The last entry is the share of votes that tells the classes apart best when the sample's own
    vectors are judged by the others; scores are stretched so that it becomes 0.3.
    """

    def run(batches):
        for batch in chunks(batches, rows=ROWS):
            counts = counts_of(*bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([c.astype(np.float16).tobytes() for c in np.minimum(counts, 6e4)], pa.binary())], ["label", "counts"])

    found = labelled_sample(docs, labels, label, sample).mapInArrow(run, "label int, counts binary").toArrow()
    known = found.column("label").to_numpy()
    if len(set(known.tolist())) < 2:
        return None
    raw = found.column("counts").to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (known[i], raw[i]))
    known = known[order]
    counts = np.stack([np.frombuffer(raw[i], np.float16) for i in order]).astype(np.float32)
    idf = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)).astype(np.float32) + 1
    x = scaled(counts, idf)
    space = latent_space(x, DIMENSIONS)
    vectors = unit(x @ space)
    share = votes(vectors, vectors, known, NEIGHBOURS, own=True)
    steps = np.linspace(0.02, 0.98, 49)
    right = [((share >= t) == (known == 1)) for t in steps]
    best = steps[int(np.argmax([r[known == 1].mean() + r[known == 0].mean() for r in right]))]
    return idf, space, vectors, known, float(best)


def score(docs: DataFrame, labels: DataFrame, label="quality", sample=SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` from 0 to 1, ``predicted`` (score of 0.3 or more) for every document.

    Whole texts; null and empty texts are scored as texts without features. Nothing but texts enters
    a score, and nothing is learned from held-out ids. Without labels of both classes every score is
    0.5. Ties among neighbours are settled by the order of the sample. One row per input row; other
    columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, sample))

    def run(batches):
        for batch in chunks(batches, rows=ROWS):
            if shared.value is None:
                value = np.full(batch.num_rows, 0.5)
            else:
                idf, space, vectors, known, best = shared.value
                own = unit(scaled(counts_of(*bytes_of(batch.column("text"))), idf) @ space)
                share = votes(own, vectors, known, NEIGHBOURS).astype(np.float64).clip(0, 1)
                value = np.where(share >= best, 0.3 + 0.7 * (share - best) / (1 - best), 0.3 * share / best)
                value = np.where((share < best) & (value >= 0.3), 0.3 - 1e-9, value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value.astype(np.float64))], ["doc_id", "score"])

    found = texts(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
