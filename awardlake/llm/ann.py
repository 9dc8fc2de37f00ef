"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are dealt into ranges of norm, so that one long vector does not flatten the others. A range
of few vectors is met whole. In a larger one a vector is made a unit vector by one more component (so
that the largest inner product is the nearest angle), rotated by three rounds of random signs and
Hadamard transforms, and put into the bucket of its nearest signed axis, once per table. A query
looks into the buckets of its nearest signed axes in every table, and goes on until those buckets
hold enough vectors. Buckets are met in blocks of bounded size: what they hold is reranked by exact
inner products, and only the best of a block travel on.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import cut

#: Tables, and the share of all signed axes that a query tries at least in each.
TABLES, SHARE = 6, 5 / 16
#: A range of norm with no more distinct vectors than this is met whole, in parts of the second size.
WHOLE, WHOLE_PART = 4096, 256
#: Vectors of a bucket, and queries at a bucket, that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 8192
#: Rows of an Arrow batch that goes to the blocks.
SENT = 1 << 14
#: Distinct vectors a task holds before it sends them.
HELD = 1 << 17


def hadamard(a):
    """Normalised fast Hadamard transform of each row; the width is a power of two."""
    n, width = a.shape
    step = 1
    while step < width:
        halves = a.reshape(n, width // (2 * step), 2, step)
        a = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return a / np.sqrt(width)


def rotated(unit, table, seed):
    """Pseudo-rotation of rows for one table."""
    width = 1 << int(unit.shape[1] - 1).bit_length()
    a = np.zeros((len(unit), width))
    a[:, : unit.shape[1]] = unit
    for signs in np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, width)):
        a = hadamard(a * signs)
    return a


def axes_of(components):
    """Number of signed axes for vectors of so many components and one more."""
    return 2 << int(components).bit_length()


def norms(x):
    """Length of each row, without overflow inside."""
    most = np.abs(x).max(axis=1)
    scaled = x / most[:, None]
    return most * np.sqrt((scaled * scaled).sum(axis=1))


def ranges(length):
    """Range of norm of each length: the nearest power of two."""
    return np.rint(np.log2(np.clip(length, 5e-324, 1.7e308))).astype(np.int32)


def widened(x, largest):
    """Unit vectors whose angle to a widened query falls with the inner product."""
    x = x / largest
    rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def nearest_axes(y, count):
    """The ``count`` nearest signed axes of each row, nearest first: twice the axis, one more if negative."""
    signed = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return signed.argmax(axis=1)[:, None] if count == 1 else np.argsort(-signed, axis=1, kind="stable")[:, :count]


def _binary(matrix):
    """Rows of a matrix as an Arrow binary array."""
    size = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(0, (len(matrix) + 1) * size, size, dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))]).cast(pa.binary())


def _matrix(column, kind=np.float64):
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1).astype(kind)


def _valid(vectors, id_column, vector_column):
    """Usable rows as ``id`` and ``vector`` (array of double): id not null, all components finite, not all zero."""
    x = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("vector")).where("id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda v: v != 0))


def _distinct(rows, keep):
    """Distinct vectors as binary with their ``keep`` smallest ids (enough for the nearest ``keep``) and ``node``, the smallest.

    Copies are collapsed where they are read, so a vector that most rows share reaches its group as
    one row per task.
    """

    def run(batches):
        held = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vector", "ids"])

        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            flat = flat + 0.0  # one zero
            for doc, a, b in zip(batch.column("id").to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0]):
                ids = held.setdefault(flat[a:b].tobytes(), [])
                ids.append(doc)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(held) >= HELD:
                yield sent()
                held = {}
        yield sent()

    packed = rows.mapInArrow(run, "vector binary, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return packed.groupBy("vector").agg(least.alias("ids")).select("vector", "ids", F.get("ids", F.lit(0)).alias("node"))


def _places(x, kinds, tables, seed):
    """Where each vector lies: (range, table, rows, buckets) for one range and table after another.

    ``kinds`` has the largest norm of each range and whether the range is hashed or met whole.
    """
    of = ranges(norms(x))
    for kind in np.unique(of).tolist():
        at = np.flatnonzero(of == kind)
        largest, hashed = kinds[kind]
        if not hashed:
            yield kind, 0, at, np.zeros(len(at), np.int64)
            continue
        unit = widened(x[at], largest)
        for table in range(tables):
            yield kind, table, at, nearest_axes(rotated(unit, table, seed), 1)[:, 0]


def _looks(x, kinds, held, tables, probes, seed, enough):
    """Where each query looks, in the form of ``_places``.

    In every range: whole if it is small, else in the ``probes`` nearest buckets of each table and on
    in the next ones until they hold ``enough`` vectors or all. ``held`` has the vectors per bucket.
    """
    every = np.arange(len(x))
    large = [kind for kind, (_, hashed) in kinds.items() if hashed]
    for kind in kinds.keys() - set(large):
        yield kind, 0, every, np.zeros(len(x), np.int64)
    if not large:
        return
    unit = np.concatenate([x / norms(x)[:, None], np.zeros((len(x), 1))], axis=1)
    for table in range(tables):
        order = nearest_axes(rotated(unit, table, seed), axes_of(x.shape[1]))
        for kind in large:
            inside = held[kind, table][order]
            tried = np.maximum(probes, (np.cumsum(inside, axis=1) < enough).sum(axis=1) + 1)
            rows, place = np.nonzero((np.arange(order.shape[1]) < tried[:, None]) & (inside > 0))
            yield kind, table, rows, order[rows, place]


def _bucketed(rows, places, splits, others):
    """Rows by block: ``kind``, ``table``, ``bucket``, ``mine``, ``theirs``, ``node``, ``vector``.

    ``splits`` and ``others`` tell into how many parts a bucket's own and opposite rows are cut; a row
    goes to one part of its own side against every part of the other.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x, node = _matrix(part.column("vector")), part.column("node").to_numpy()
                for kind, table, row, bucket in places(x):
                    if (kind, table) not in splits or (kind, table) not in others:
                        continue
                    copies = np.where(splits[kind, table][bucket] > 0, others[kind, table][bucket], 0)
                    ends = np.cumsum(copies)
                    total = int(ends[-1]) if len(ends) else 0
                    for start in range(0, total, SENT):
                        copy = np.arange(start, min(start + SENT, total))
                        of = np.searchsorted(ends, copy, "right")
                        theirs = copy - (ends[of] - copies[of])
                        own, b = node[row[of]], bucket[of]
                        mine = own % splits[kind, table][b]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(of), kind, np.int32)), pa.array(np.full(len(of), table, np.int32)), pa.array(b.astype(np.int32)),
                            pa.array(mine.astype(np.int32)), pa.array(theirs.astype(np.int32)), pa.array(own), _binary(x[row[of]]),
                        ], ["kind", "table", "bucket", "mine", "theirs", "node", "vector"])

    return rows.select("node", "vector").mapInArrow(run, "kind int, table int, bucket int, mine int, theirs int, node long, vector binary")


def _best(queries, vectors, keep):
    """Indices of the best vectors of each query by inner product, and of all that may tie with the last of them."""
    scores = queries @ vectors.T
    if scores.shape[1] > keep:
        least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        slack = 1e-12 * np.maximum(1, np.abs(least))
        for row, bound in zip(scores, least - slack):
            at = np.flatnonzero(row >= bound)
            yield at
    else:
        for _ in scores:
            yield np.arange(scores.shape[1])


def _meet(queries, vectors, keep):
    """Best vectors of every query of a block: ``query``, ``nodes``, ``scores``."""
    out, found, scores = [], [], []
    if queries.num_rows and vectors.num_rows:
        node, x = vectors.column("node").to_numpy(), _matrix(vectors.column("vector"))
        for start in range(0, queries.num_rows, 512):
            part = queries.slice(start, 512)
            q = _matrix(part.column("vector"))
            for own, vector, at in zip(part.column("node").to_pylist(), q, _best(q, x, keep)):
                exact = (x[at] * vector).sum(axis=1)
                order = np.lexsort((node[at], -exact))[:keep]
                out.append(own)
                found.append(node[at][order])
                scores.append(exact[order])
    kinds = pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.table({"query": pa.array(out, pa.int64()), "nodes": pa.array(found, kinds[0]), "scores": pa.array(scores, kinds[1])})


def _merged(lists, keep):
    """The best distinct vectors of one query out of its lists from all buckets (a bounded number of short lists)."""
    nodes, scores = (np.concatenate([c.flatten().to_numpy() for c in lists.column(n).chunks]) for n in ("nodes", "scores"))
    order = np.lexsort((nodes, -scores))
    _, first = np.unique(nodes[order], return_index=True)
    best = order[np.sort(first)[:keep]]
    return pa.table({"query": pa.array([lists.column("query")[0].as_py()] * len(best), pa.int64()), "down": pa.array(-scores[best]), "node": pa.array(nodes[best])})


def _counts(rows, places, axes):
    """Rows per bucket, one array for each range and table: of fixed size."""

    def run(batches):
        found = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for kind, table, _, bucket in places(_matrix(batch.column("vector").slice(at, 512))):
                    for b, c in zip(*np.unique(bucket, return_counts=True)):
                        found[kind, table, int(b)] += int(c)
        keys = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([key[i] for key in keys], pa.int32()) for i in range(3)), pa.array(list(found.values()), pa.int64())], ["kind", "table", "bucket", "c"])

    out = {}
    counted = rows.select("vector").mapInArrow(run, "kind int, table int, bucket int, c long")
    for r in counted.groupBy("kind", "table", "bucket").agg(F.sum("c").alias("c")).collect():
        out.setdefault((r["kind"], r["table"]), np.zeros(axes, np.int64))[r["bucket"]] = r["c"]
    return out


def search(vectors: DataFrame, is_query, k=20, id_column="vec_id", vector_column="embedding", tables=TABLES, probes=None, seed=11) -> DataFrame:
    """The ``k`` nearest rows found for every query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``is_query`` is a condition on ``id``. Nearness is the inner product in double precision on the
    original vectors, ties go to the smaller id, a query never finds its own row (nor another one of
    its id), fewer rows than ``k`` are all found. ``probes`` buckets at least are tried in each table,
    by default ``SHARE`` of them. Vectors that are null, empty, zero or hold null or non-finite
    components, and null ids, take no part; nor do vectors of another length than most. Repeated rows
    count once. An empty table gives an empty result.
    """
    rows = _valid(vectors, id_column, vector_column)
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("vector") == (lengths["n"] if lengths else 1)).select("id", F.transform("vector", lambda v: v + 0.0).alias("vector"))
    known = cut(_distinct(rows, k + 1))

    def length_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                length = norms(_matrix(batch.column("vector").slice(at, 512)))
                kind, of = np.unique(ranges(length), return_inverse=True)
                most = np.zeros(len(kind))
                np.maximum.at(most, of, length)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(most), pa.array(np.bincount(of))], ["kind", "length", "c"])

    spread = known.select("vector").mapInArrow(length_of, "kind int, length double, c long")
    kinds = {r["kind"]: (r["length"], r["c"] > WHOLE) for r in spread.groupBy("kind").agg(F.max("length").alias("length"), F.sum("c").alias("c")).collect()}
    axes = axes_of(lengths["n"] if lengths else 1)
    tried = max(1, round(axes * SHARE)) if probes is None else probes

    def packed(batches):
        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy() + 0.0, lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["query_id", "vector"])

    asked = rows.where(is_query).distinct().mapInArrow(packed, "query_id long, vector binary")
    asked = cut(asked.join(known.select("vector", "node"), "vector").select("query_id", "node"))
    queries = known.join(asked.select("node").distinct(), "node", "left_semi")

    def lies(x):
        return _places(x, kinds, tables, seed)

    ours = _counts(known, lies, axes)

    def looks(x):
        return _looks(x, kinds, ours, tables, tried, seed, k + 1)

    theirs = _counts(queries, looks, axes)
    cut_vectors = {b: -(-c // (BLOCK_VECTORS if kinds[b[0]][1] else WHOLE_PART)) for b, c in ours.items()}
    cut_queries = {b: -(-c // BLOCK_QUERIES) for b, c in theirs.items()}
    block = ["kind", "table", "bucket"]
    index = _bucketed(known, lies, cut_vectors, cut_queries)
    looking = _bucketed(queries, looks, cut_queries, cut_vectors)
    met = index.groupBy(*block, "mine", "theirs").cogroup(looking.groupBy(*block, "theirs", "mine")).applyInArrow(
        lambda a, b: _meet(b, a, k + 1), "query long, nodes array<long>, scores array<double>")
    itself = queries.select(F.col("node").alias("query"), "vector").mapInArrow(_itself, "query long, nodes array<long>, scores array<double>")
    best = met.unionAll(itself).groupBy("query").applyInArrow(lambda t: _merged(t, k + 1), "query long, down double, node long")
    named = best.join(known.select("node", "ids"), "node")
    answer = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("down").alias("down"), i.alias("id")))))
    ranked = named.groupBy("query").agg(F.slice(F.array_sort(answer), 1, k + 1).alias("found"))
    answers = asked.join(ranked, F.col("node") == F.col("query"))
    rest = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(rest).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.down")).alias("score"))


def _itself(batches):
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("vector"))
            node = batch.column("query").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("query"), pa.array([[n] for n in node], pa.list_(pa.int64())), pa.array([[s] for s in (x * x).sum(axis=1).tolist()], pa.list_(pa.float64())),
            ], ["query", "nodes", "scores"])
