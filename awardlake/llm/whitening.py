"""Whitening of embeddings from a polarisation covariance.

Entries become whole numbers, are centred on the nearest whole mean, and only squares are summed:
of every dimension and of the sum of every pair of dimensions. Sums are exact whole numbers, split
into limbs for Spark to add. With var(x + y) = var(x) + var(y) + 2 cov(x, y), differences of
variances give every cross-covariance, correctly rounded, and the matrix goes to ``eigh``.

What reaches the driver has the size of that matrix, whatever the number of rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Whole steps per unit, and what is added after rounding down.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this do not count as representable.
LARGEST = float(1 << 61)
#: Rows looked at in one pass of numpy.
BLOCK = 1024
#: Components put out at most.
COMPONENTS = 32

_LIMB = 31
_MASK = (1 << _LIMB) - 1
_ROOM = 1 << 62


def usable(rows: DataFrame, column="embedding", key="vec_id") -> tuple[DataFrame, int]:
    """(``id``, ``vector`` of doubles) of the rows that take part, and their width (0 without any).

    Vectors that are null, empty, or hold null or non-finite entries, or entries of 2**55 and more, take no part. Where
    widths differ, the most frequent one counts (of equally frequent ones the largest).
    """
    x = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v * SCALE) < LARGEST, F.lit(False)))  # a NaN is no less than anything
    kept = rows.where(fine & (F.size(x) > 0)).select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("vector"))
    widths = kept.groupBy(F.size("vector").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = most[0]["width"] if most else 0
    return kept.where(F.size("vector") == width), width


def whole(batch, width):
    """The vectors of an Arrow batch as rows of whole numbers."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def blocks(batches, width):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, whole(part, width)


def safe(values, factor):
    """The array itself if sums of ``factor`` squares of its entries fit into 64 bits, else Python's whole numbers."""
    most = int(np.abs(values).max(initial=0))
    return values if most * most * factor < _ROOM else values.astype(object)


def pair_squares(y):
    """Sums over rows of y_i squared (i = j) and of (y_i + y_j) squared (i < j), one after another, as an object array."""
    y, out = safe(y, 4 * len(y)), []
    for i in range(y.shape[1]):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        out.append((both * both).sum(axis=0))
    return np.concatenate(out).astype(object)


def _limbs(keys, totals):
    """Whole numbers of up to 140 bits as four limbs; the last one holds the sign."""
    rest, limbs = list(totals), []
    for _ in range(3):
        limbs.append(pa.array([v & _MASK for v in rest], pa.int64()))
        rest = [v >> _LIMB for v in rest]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *limbs, pa.array(rest, pa.int64())], ["at", "l0", "l1", "l2", "l3"])


def exact_sums(frame: DataFrame, sums) -> list[int]:
    """Add up what ``sums`` (Arrow batches to one list of whole numbers) finds in each task, exactly."""

    def run(batches):
        total = sums(batches)
        if total is not None:
            yield _limbs(np.arange(len(total)), total)

    parts = frame.mapInArrow(run, "at long, l0 long, l1 long, l2 long, l3 long")
    limbs = [F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(4)]
    rows = parts.groupBy("at").agg(*limbs).collect()
    found = [0] * len(rows)
    for row in rows:
        found[row["at"]] = sum(int(row[f"l{k}"]) << (_LIMB * k) for k in range(4))
    return found


def _dimension_sums(width):
    def sums(batches):
        total = None
        for _, x in blocks(batches, width):
            part = np.append(safe(x, len(x)).sum(axis=0).astype(object), len(x))
            total = part if total is None else total + part
        return total

    return sums


def _square_sums(width, centre):
    """Squares first, then the plain sums of the centred entries."""

    def sums(batches):
        total = None
        for _, x in blocks(batches, width):
            y = x - centre
            part = np.concatenate([pair_squares(y), safe(y, len(y)).sum(axis=0).astype(object)])
            total = part if total is None else total + part
        return total

    return sums


def covariance(n, squares, sums):
    """Covariance matrix (divisor n) and trace out of exact sums of squares and sums, each entry rounded once."""
    width = len(sums)
    at = np.zeros((width, width), int)
    at[np.triu_indices(width)] = np.arange(len(squares))
    alone = [n * squares[at[i, i]] - sums[i] ** 2 for i in range(width)]
    matrix = np.zeros((width, width))
    for i in range(width):
        matrix[i, i] = alone[i] / n**2
        for j in range(i + 1, width):
            both = n * squares[at[i, j]] - (sums[i] + sums[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - alone[i] - alone[j]) / (2 * n**2)
    return matrix, sum(alone) / n**2


def fit(vectors: DataFrame, width: int) -> dict | None:
    """Exact counts and sums of all vectors, covariance and unit eigenvectors by falling eigenvalue; None without vectors.

    Directions without variance (up to rounding) are no components. Of an eigenvector and its opposite the one
    whose largest entry is positive is taken.
    """
    if not width:
        return None
    *totals, n = exact_sums(vectors, _dimension_sums(width))
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    found = exact_sums(vectors, _square_sums(width, centre))
    squares, sums = found[:-width], found[-width:]
    matrix, trace = covariance(n, squares, sums)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    rank = int((values > width * np.finfo(float).eps * max(values[0], 0)).sum())
    values, axes = values[:rank], axes[:, :rank]
    top = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[top, np.arange(rank)] < 0, -1.0, 1.0)
    return {"n": n, "width": width, "centre": centre, "sums": sums, "values": values, "axes": axes, "trace": trace, "covariance": matrix}


def projected(x, model, components):
    """Whole vectors less their mean, on the components, over the roots of the eigenvalues."""
    mean = np.array([s / model["n"] for s in model["sums"]])
    kept = slice(0, components)
    return ((x - model["centre"]) - mean) @ (model["axes"][:, kept] / np.sqrt(model["values"][kept]))


def deviations(x, model) -> list[int]:
    """Per vector the sum over dimensions of (n x - S) squared, exact."""
    n, sums = model["n"], model["sums"]
    y = x - model["centre"]
    squares, y_most = safe(y, y.shape[1]), int(np.abs(y).max(initial=0))
    narrow = y_most * sum(map(abs, sums)) < _ROOM
    cross = y @ np.array(sums, np.int64) if narrow else y.astype(object) @ np.array(sums, object)
    rest = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip((squares * squares).sum(axis=1), cross)]


def identity_error(vectors: DataFrame, model, components=COMPONENTS) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured on all of them."""
    shared, count = vectors.sparkSession.sparkContext.broadcast(model), min(components, len(model["values"]))

    def run(batches):
        known = shared.value
        first, second = np.zeros(count), np.zeros((count, count))
        for _, x in blocks(batches, known["width"]):
            w = projected(x, known, components)
            first += w.sum(axis=0)
            second += w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    rows = vectors.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(count + count * count)
    for row in rows:
        values[row["at"]] = row["value"] / model["n"]
    first, second = values[:count], values[count:].reshape(count, count)
    return float(np.abs(second - np.outer(first, first) - np.eye(count)).max(initial=0.0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(rows: DataFrame, column="embedding", key="vec_id", components=COMPONENTS) -> DataFrame:
    """Whitened vectors, one row per vector and component: fit on all vectors that take part, then applied to them.

    ``vec_id``, ``component`` (from 1), ``n``, ``deviation`` (null beyond 64 bits; ``deviation_exact`` has up to 38
    digits, null beyond), ``whitened``, ``explained`` (share of the trace), ``identity_error``. Which vectors take
    part: ``usable``. Rows that repeat an id or a vector count each for themselves; a null id stays null.
    Constant tables, and tables without vectors, have no components and so no rows. Other columns are ignored.
    """
    vectors, width = usable(rows, column, key)
    model = fit(vectors, width)
    if model is None or not len(model["values"]):
        return rows.sparkSession.createDataFrame([], _OUT)
    error = identity_error(vectors, model, components)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        count = min(components, len(known["values"]))
        share = known["values"][:count] / known["trace"]
        for part, x in blocks(batches, known["width"]):
            exact = [v for v in deviations(x, known)]
            index = np.repeat(np.arange(len(x)), count)
            long = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            # 38 digits at most: what an Arrow decimal holds
            wide = pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            size = len(index)
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(pa.array(index)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, known["n"], np.int64)), long.take(pa.array(index)), pa.array(projected(x, known, components).ravel()),
                pa.array(np.tile(share, len(x))), pa.array(np.full(size, error)), wide.take(pa.array(index)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return vectors.mapInArrow(run, _OUT)
