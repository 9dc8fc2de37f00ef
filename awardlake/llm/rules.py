"""Quality rules: statistics of whole texts, hard limits, and an isolation forest on what is left.

The forest is a set of random binary trees over shares of the rule statistics. A document that few
random splits set apart has short paths and is an anomaly. Trees grow on all labelled documents
outside the held-out fold, a level at a time: tasks give the spans of the features and the rows of every
open node, the driver draws the cuts. A leaf counts its good documents only, since many bad ones
alike would hide one another. The score from which a document is rejected is calibrated on the same
documents, once per band of length, so that almost no good one is lost. Texts are read once; all
documents are scored.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import SPACE, bytes_of, chunks, cut, held_out, texts

#: Trees, and the most cuts on a path.
TREES, DEEPEST = 128, 10
#: Rows whose spans a task takes at once; steps of the score that thresholds are set in.
BLOCK, STEPS = 1 << 17, 1 << 16
#: Share of good labelled documents that calibration may lose in a band, and labelled bad ones a band of its own needs.
LOST, ENOUGH = 0.005, 30
#: Bands of length by words; below the first one the hard rule rejects.
BANDS = (50, 200, 1000)
#: Hard limits: least words, and per cent of words in repeated windows.
LEAST_WORDS, REPEATED = 50, 50
#: Words of a window.
WINDOW = 3
SEED = 11

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_CODES = (np.arange(256) & 0xC0) != 0x80
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that the forest sees.
FEATURES = ("word_length", "symbols", "bars", "upper", "ends", "bangs", "digits", "dup_lines", "repeats", "line_words")


def repeated_words(words, window=WINDOW) -> int:
    """Number of words in windows that occur twice or more, the first time included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    known = defaultdict()
    known.default_factory = known.__len__
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    keys = codes[:count]
    for k in range(1, window):
        # windows so far as dense numbers, so that the next word always fits into 64 bits
        if k > 1:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(known) + codes[k : k + count]
    _, index, number = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(number[index] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes):
    """(statistics, features) of one whole text as UTF-8."""
    bytes_by_value = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()  # splits at space and tab to carriage return
    n = len(words)
    chars = int(bytes_by_value[_CODES].sum() - bytes_by_value[SPACE].sum())
    symbols = int(bytes_by_value[SYMBOLS].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    per_word, letters = 1 / max(n, 1), max(int(bytes_by_value[65:91].sum() + bytes_by_value[97:123].sum()), 1)
    ends = bytes_by_value[46] + bytes_by_value[63]
    shares = (
        chars * per_word, symbols * per_word, bytes_by_value[124] * per_word, bytes_by_value[65:91].sum() / letters, ends * per_word,
        bytes_by_value[33] * per_word, bytes_by_value[48:58].sum() / max(chars, 1), repeated_lines / max(len(lines), 1), repeats * per_word,
        np.log1p(n / max(len(lines), 1)),
    )
    return (n, chars, symbols, repeated_lines, repeats), shares


def _measured(batch):
    """Statistics (whole numbers) and features of the rows of an Arrow batch with ``text``."""
    data, ends = bytes_of(batch.column("text"))
    found = [measure(data[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    statistics = np.array([s for s, _ in found], np.int64).reshape(-1, len(STATISTICS))
    return statistics, np.array([f for _, f in found], float).reshape(-1, len(FEATURES))


def fails(statistics):
    """Rows that break a hard limit."""
    n, repeats = statistics[:, 0], statistics[:, 4]
    return (n < LEAST_WORDS) | (100 * repeats > REPEATED * n)


def average_path(n):
    """Mean path length of an unsuccessful search among n rows: what a leaf of n rows adds to a path."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def leaves(x, tree):
    """The node each row comes to; where a tree still grows, one without a cut yet."""
    feature, cut_at, left, right = tree[:4]
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= cut_at[node], left[node], right[node])


def spans(x, good, trees):
    """Per tree and open node that rows come to: tree, node, good rows, least and largest value of every feature."""
    found = []
    for number, tree in enumerate(trees):
        at = leaves(x, tree)
        rows = np.flatnonzero(tree[5][at])
        if not len(rows):
            continue
        rows = rows[np.argsort(at[rows], kind="stable")]
        nodes, starts = np.unique(at[rows], return_index=True)
        counts = np.add.reduceat(good[rows].astype(np.int64), starts)
        sides = np.minimum.reduceat(x[rows], starts), np.maximum.reduceat(x[rows], starts)
        found.append(np.column_stack([np.full(len(nodes), number), nodes, counts, *sides]))
    return np.concatenate(found) if found else np.zeros((0, 3 + 2 * x.shape[1]))


def grow(spans_of, width, trees=TREES, deepest=DEEPEST, seed=SEED):
    """Random trees and the path length that scores are set against.

    ``spans_of(trees)`` gives the lines of :func:`spans` over all rows. A tree is its arrays: feature (-1: leaf), cut, left and right
    child, path length at a leaf, whether a node is open. A node with at most one good row is a leaf.
    """
    nodes = [[(-1, 0.0, 0, 0, 0.0, True)] for _ in range(trees)]
    arrays = lambda: [tuple(map(np.array, zip(*tree))) for tree in nodes]
    expected = 1.0
    for depth in range(deepest + 1):
        lines = spans_of(arrays())
        for line in lines[np.lexsort((lines[:, 1], lines[:, 0]))]:
            number, at, count = map(int, line[:3])
            low, high = line[3 : 3 + width], line[3 + width :]
            open_ = np.flatnonzero(high > low)
            if depth == 0:
                expected = max(float(average_path(count)), 1.0)
            if depth == deepest or count < 2 or not len(open_):
                nodes[number][at] = (-1, 0.0, at, at, depth + float(average_path(count)), False)
                continue
            rng, tree = np.random.default_rng((seed, number, at)), nodes[number]
            feature = int(rng.choice(open_))
            cut_at = float(rng.uniform(low[feature], high[feature]))
            cut_at = cut_at if cut_at < high[feature] else float(low[feature])  # rounding must not leave a side empty
            tree[at] = (feature, cut_at, len(tree), len(tree) + 1, 0.0, False)
            tree += [(-1, 0.0, len(tree) + k, len(tree) + k, 0.0, True) for k in (0, 1)]
    return [tree[:5] for tree in arrays()], expected


def forest(x, trees=TREES, seed=SEED):
    """Random trees on the rows of one array."""
    good = np.ones(len(x), bool)
    return grow(lambda grown: spans(x, good, grown), x.shape[1], trees, seed=seed)


def anomaly(x, model):
    """Score from 0 to 1 of each row: 2 to the power of minus its mean path, relative to the expected one."""
    grown, expected = model
    total = np.zeros(len(x))
    for tree in grown:
        total += tree[4][leaves(x, tree)]
    return 2.0 ** (-total / (len(grown) * expected))


def calibrate(scores, labels, lost=LOST, counts=None):
    """The score from which rows are rejected: most bad ones less good ones, at most ``lost`` of the good. Infinite without gain.

    With ``counts`` a score is the lower end of a step and stands for so many rows.
    """
    each = np.ones(len(scores)) if counts is None else np.asarray(counts, float)
    cuts, of = np.unique(scores, return_inverse=True)
    good, bad = (np.bincount(of, each * (labels == c), len(cuts)) for c in (1, 0))
    if not good.sum() or not bad.sum():
        return float("inf")
    hit, false = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (bad, good))
    gain = np.where(false <= lost, hit - false, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return float("inf")
    # between the least rejected score and the one below it
    return float((cuts[best] + cuts[best - 1]) / 2) if best and counts is None else float(cuts[best])


def band(n_words):
    return np.searchsorted(BANDS, n_words, "right")


def _columns(batch, names):
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])


def _typed(names, kind):
    return ", ".join(f"{c} {kind}" for c in names)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, statistics and features of every document, one row per input row."""

    def run(batches):
        for batch in chunks(batches):
            statistics, features = _measured(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, statistics.T), *map(pa.array, features.T)], ["doc_id", *STATISTICS, *FEATURES])

    return texts(docs).mapInArrow(run, f"doc_id long, {_typed(STATISTICS, 'long')}, {_typed(FEATURES, 'double')}")


def labelled(found: DataFrame, labels: DataFrame, label) -> DataFrame:
    """``label``, ``n_words`` and features of all labelled rows of :func:`measured` outside the held-out fold that keep the hard limits.

    Null or other labels are left out; of repeated labels of an id the largest counts.
    """
    known = labels.where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(label).cast("int").alias("label"))
    passed = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= REPEATED * F.col("n_words"))
    return found.where(passed).join(known.where(F.col("label").isin(0, 1)), F.col("doc_id") == F.col("of")).select("label", "n_words", *FEATURES)


def _spans_of(rows, best=1):
    """``spans`` over all rows of a table, as :func:`grow` asks for them; one line per open node comes to the driver."""
    sides = [f"{side}_{f}" for side in ("low", "high") for f in FEATURES]
    names = ["tree", "node", "good", *sides]

    def ask(trees):
        shared = rows.sparkSession.sparkContext.broadcast(trees)

        def run(batches):
            held, size = [], 0
            for batch in batches:
                held.append(_columns(batch, ("label", *FEATURES)))
                size += len(held[-1])
                if size >= BLOCK:
                    yield lines(held)
                    held, size = [], 0
            if size:
                yield lines(held)

        def lines(held):
            block = np.concatenate(held)
            found = spans(block[:, 1:], block[:, 0] == best, shared.value)
            columns = [pa.array(c.astype(np.int64)) for c in found[:, :3].T]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, found[:, 3:].T)], names)

        part = rows.mapInArrow(run, f"{_typed(names[:3], 'long')}, {_typed(sides, 'double')}")
        ends = [(F.min if c.startswith("low_") else F.max)(c).alias(c) for c in sides]
        whole = part.groupBy("tree", "node").agg(F.sum("good").alias("good"), *ends).select(names).toArrow()
        return _columns(whole, names).astype(float).reshape(-1, len(names))

    return ask


def fit(rows: DataFrame):
    """(forest, threshold per band of length) from all rows of :func:`labelled`, which is read once a level.

    Spans and counts of nodes and steps of scores come to the driver, as many as there are nodes and steps. None without rows.
    """
    best = rows.agg(F.max("label")).first()[0]  # without good rows the bad ones count
    if best is None:
        return None
    model = grow(_spans_of(rows, best), len(FEATURES))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            step = np.floor(anomaly(_columns(batch, FEATURES), shared.value) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(band(batch.column("n_words").to_numpy()).astype(np.int64)), pa.array(step)], ["label", "band", "step"])

    steps = rows.mapInArrow(run, "label int, band long, step long").groupBy("label", "band", "step").count().toArrow()
    y, bands, step, counts = _columns(steps, ("label", "band", "step", "count")).T
    scores = step / STEPS
    overall = calibrate(scores, y, counts=counts)
    thresholds = []
    for b in range(len(BANDS) + 1):
        mine = bands == b
        thresholds.append(calibrate(scores[mine], y[mine], counts=counts[mine]) if counts[mine & (y == 0)].sum() >= ENOUGH else overall)
    return model, np.array(thresholds)


def judge(docs: DataFrame, labels: DataFrame, label="quality") -> DataFrame:
    """Statistics of every document, hard rules and the forest's verdict.

    ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, ``anomaly``
    (0 to 1). A null text is empty, and fails. Without labels of both classes only the hard rules reject. One row per
    input row, repeated ids and texts included; other columns are ignored; an empty table gives an empty result.
    """
    found = cut(measured(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(cut(labelled(found, labels, label))))

    def run(batches):
        known = shared.value
        for batch in batches:
            statistics = _columns(batch, STATISTICS)
            failed = fails(statistics)
            scores, rejected = np.zeros(len(failed)), np.zeros(len(failed), bool)
            if known is not None:
                scores = anomaly(_columns(batch, FEATURES), known[0])
                rejected = scores >= known[1][band(statistics[:, 0])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *STATISTICS)), pa.array(failed), pa.array(~failed & ~rejected), pa.array(scores)],
                ["doc_id", *STATISTICS, "base_failed", "kept", "anomaly"])

    schema = f"doc_id long, {_typed(STATISTICS, 'long')}, base_failed boolean, kept boolean, anomaly double"
    return found.mapInArrow(run, schema)
