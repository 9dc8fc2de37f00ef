"""Near-duplicates by MinHash: many universal hash minima, banding, verification, components."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import LOWER, Rolling, bytes_of, chunks, cut, mix, small_batches, texts, words_of
from awardlake.llm.components import stars

#: Hashes per band and bands. A pair at similarity 0.8 shares no band with probability 3e-7.
BAND_ROWS, BANDS = 6, 50
#: Standard deviations below the threshold at which an estimated similarity rules a pair out.
MARGIN = 5.0
#: Bits of the field that tells where sets are needed; classes of a bucket that meet in one block.
FIELD, BLOCK = 1 << 24, 2048

_FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def shingle_sets(data, ends, words):
    """Sorted distinct 64-bit shingle hashes of each row: a list of arrays (empty without words)."""
    data = LOWER[data]
    first, last, row = words_of(data, ends)
    n = len(ends) - 1
    if not len(first):
        return [np.zeros(0, np.uint64)] * n
    word = Rolling(data).hash(first, last)
    bounds = np.searchsorted(row, np.arange(n + 1))
    size = len(word) - words + 1
    runs = np.zeros(max(size, 0), np.uint64)
    for i in range(words):
        runs += word[i : i + len(runs)] * _FACTORS[i]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = (word[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(shingles):
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(sets, size, seed):
    """Low 16 bits of ``size`` universal-hash minima of each non-empty set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, scratch = np.empty((size, len(sets)), np.uint16), np.empty_like(x)
    for k in range(size):
        np.multiply(x, a[k], out=scratch)
        np.add(scratch, b[k], out=scratch)
        out[k] = np.minimum.reduceat(scratch, starts).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def sketches(docs: DataFrame, words, band_rows=BAND_ROWS, bands=BANDS, seed=1) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the shingle set and ``signature`` (null without words)."""

    def run(batches):
        for batch in chunks(batches):
            sets = shingle_sets(*bytes_of(batch.column("text")), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = [None] * len(sets)
            if full:
                for i, row in zip(full, minima([sets[i] for i in full], band_rows * bands, seed)):
                    signatures[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array(signatures, pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "signature"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def _band_keys(reps, band_rows):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).astype(np.uint64)
            rows = rows.reshape(batch.num_rows, -1, band_rows)
            keys = mix((rows * _FACTORS[:band_rows] + np.uint64(1)).sum(axis=2, dtype=np.uint64))
            keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * _FACTORS[0])
            flat = pa.array(keys.view(np.int64).ravel())
            offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.ListArray.from_arrays(offsets, flat)], ["node", "n", "keys"])

    packed = reps.select("node", F.col("n_shingles").cast("int").alias("n"), "signature").mapInArrow(run, "node long, n int, keys array<long>")
    return packed.select("node", "n", F.posexplode("keys").alias("band", "key"))


def _estimated(pairs, reps, threshold, size):
    """Pairs whose signatures do not rule out the threshold."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / size) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            near = pa.array((a == b).mean(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(near)

    left = reps.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _marked(nodes):
    """Bit field of fixed size over hashed ids: tells which documents cannot be among ``nodes``."""
    slots = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FIELD)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    field = np.zeros(FIELD // 64, np.int64)
    field[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return field.view(np.uint64)


def _sets(nodes, docs, reps, words):
    """``node``, ``shingles`` (binary, sorted) of the given nodes, written once.

    Sets are made where the texts are read; the bit field spares most other documents that work, the
    join with the nodes decides.
    """
    field = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def sets_of(batches):
        def possible():
            for batch in batches:
                slot = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array((field.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))

        for batch in chunks(possible()):
            found = shingle_sets(*bytes_of(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary()),
            ], ["node", "digest", "shingles"])

    slots = texts(docs).where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FIELD)).alias("slot"))
    wanted = reps.select("node", "digest").join(nodes, "node", "left_semi")
    sets = slots.mapInArrow(sets_of, "node long, digest binary, shingles binary").join(wanted, ["node", "digest"])
    return cut(sets.distinct().select("node", "shingles"))


def _similar(a, b, percent):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs, docs, reps, words, percent):
    """Pairs of nodes with 100 * intersection >= percent * union on their full shingle sets."""

    def compare(batches):
        for batch in batches:
            keep = [
                _similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                for a, b in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(nodes, docs, reps, words)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(compare, "a long, b long").distinct())


def _with_centres(buckets):
    """Adds each bucket's ``centre``: the member that meets most others over all its buckets, then the smallest.

    The original of many near copies is closer to each than they are to each other, so it meets most.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    degree = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("down"), F.col("n"))).alias("best"))
    return buckets.join(ranked.select("key", (-F.col("best.down")).alias("centre"), F.col("best.n").alias("centre_n")), "key")


def _links_in_block(table, percent, band_rows):
    """Confirmed links that join the components within one block of a bucket: at most one per class.

    Pairs are looked at here and never leave as pairs: only those of different components, of sizes
    that allow the similarity, in the first band that they share, and whose signatures allow it, are
    compared on their sets.
    """
    node, n, part = (table.column(c).to_numpy() for c in ("node", "n", "part"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(node), -1)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    root, threshold = table.column("root").to_numpy().copy(), percent / 100
    least = threshold - MARGIN * (threshold * (1 - threshold) / signature.shape[1]) ** 0.5
    low, high, band = (table.column(c)[0].as_py() for c in ("low", "high", "band"))
    out = []
    for i in range(len(node)):
        j = np.arange(i + 1, len(node))
        j = j[(root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if low != high:
            j = j[part[j] != part[i]]
        if not len(j):
            continue
        same = signature[j] == signature[i]
        first = same.reshape(len(j), -1, band_rows).all(axis=2).argmax(axis=1) == band
        for k in j[first & (same.mean(axis=1) >= least)].tolist():
            if root[k] != root[i] and _similar(sets[i], sets[k], percent):
                out.append((node[i], node[k]))
                root[root == root[k]] = root[i]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _links(buckets, reps, docs, words, percent, band_rows, bands):
    """Confirmed links that join every component among nodes that share a bucket, and their roots if known."""
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    rows = cut(_with_centres(buckets))
    pairs = rows.where((F.col("node") != F.col("centre")) & near("n", "centre_n"))
    pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = _confirmed(cut(_estimated(pairs, reps, percent / 100, band_rows * bands)), docs, reps, words, percent)
    roots = stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = _with_root(rows.where("node <> centre").select("key", "band", "node", "n"), roots, "node", "root")
    several = rows.groupBy("key").agg(F.min("root").alias("lowest"), F.max("root").alias("highest"), F.count("*").alias("size")).where("lowest < highest")
    rows = cut(rows.join(several.select("key", "size"), "key"))
    if rows.isEmpty():
        return links, roots
    # a bucket beyond one block is cut into parts, and every two parts meet in a block of their own
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.select("key", "band", "node", "n", "root", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int").alias("part"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    rows = rows.select("key", "band", "node", "n", "root", "part", F.inline(meets))
    held = _sets(rows.select("node").distinct(), docs, reps, words).join(reps.select("node", "signature"), "node")
    found = rows.join(held, "node").groupBy("key", "low", "high").applyInArrow(lambda t: _links_in_block(t, percent, band_rows), "a long, b long")
    more = cut(found.distinct())
    return (links, roots) if more.isEmpty() else (links.unionAll(more), None)


def components_of(docs: DataFrame, words=5, percent=80, band_rows=BAND_ROWS, bands=BANDS, seed=1) -> DataFrame:
    """Components of documents whose word-shingle sets are similar: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``digest``.

    Equal shingle sets form a class first, so copies never meet each other. Within a band's bucket
    every class is compared with the bucket's centre (linear in the bucket) and joined into
    components. Where a bucket still holds several components, its classes meet in blocks of bounded
    size, which give only the links that join components. No link between components is lost to a
    cap; a pair that shares no band is missed with probability (1 - s**band_rows)**bands.

    Null or empty texts have no shingles and are linked with nothing; fewer words than ``words``
    make one shingle. A null ``doc_id`` is linked with nothing (null component, kept). Rows that
    repeat an id are placed each by its own text. Ties go to the smaller id; other columns are
    ignored; an empty table gives an empty result.
    """
    if words > len(_FACTORS):
        raise ValueError(f"at most {len(_FACTORS)} words")
    sketch = cut(sketches(docs, words, band_rows, bands, seed))
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("digest").agg(F.min("doc_id").alias("node")))
    reps = cut(full.join(classes, ["digest"]).where("doc_id = node").select("node", "n_shingles", "digest", "signature").distinct())
    rows = _band_keys(reps, band_rows)
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(rows.join(shared.select("key"), "key"))
    links, roots = _links(buckets, reps, docs, words, percent, band_rows, bands)
    roots = roots if roots is not None else stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = _with_root(sketch.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left"), roots, "node", "root")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "digest",
    )


def near_duplicates(docs: DataFrame, words=5, percent=80, **how) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every document; see ``components_of``."""
    return components_of(docs, words, percent, **how).drop("digest")


def one_of_each(docs: DataFrame, words=5, percent=80, **how) -> DataFrame:
    """The documents, all columns, without those that are not the first of their component.

    Rows that repeat an id and its words are one document: they stay or go together.
    """
    gone = cut(components_of(docs, words, percent, **how).where("not kept").select(F.col("doc_id").alias("gone"), F.col("digest").alias("of")).distinct())
    tag = "_" * (1 + max((len(c) for c in docs.columns), default=0))

    def run(batches):
        for batch in chunks(batches):
            digests = pa.array([_digest(s) for s in shingle_sets(*bytes_of(batch.column("text")), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, tag])

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.mapInArrow(run, f"{schema}, `{tag}` binary")
    return marked.join(gone, (F.col("doc_id").cast("long") == F.col("gone")) & (F.col(tag) == F.col("of")), "left_anti").drop(tag)


def _with_root(df, roots, node, name):
    """Adds the root of a node; a node without one is its own."""
    known = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return df.join(known, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")
