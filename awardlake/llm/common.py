"""Helpers shared by the operators of this subpackage."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.sources.sinks import shared_dir

#: UTF-8 bytes handled at once inside a task; bounds numpy's temporary arrays whatever the batch.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1024

#: White space of the word definitions: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent in a local run (tests) a temporary folder is used. Spark removes the files
    when nothing refers to them if the cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark):
    """Whole texts can be long: hand at most ``BATCH_ROWS`` of them at once to Python (a session setting)."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), so that no other column can clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(column="doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by five (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string or binary array and the n + 1 offsets of its rows, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def chunks(batches, column="text", limit=CHUNK_BYTES, rows=1 << 14):
    """Split Arrow batches into slices of at most ``rows`` rows and about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = bytes_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


_POWERS = {}


def powers(n, base=_BASE):
    """The first ``n`` powers of ``base``; the longest table up to two chunks is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


class Rolling:
    """Polynomial hashes (modulo 2**64) of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.unshift = powers(n + 1, _INVERSE)

    def hash(self, starts, ends):
        return mix((self.sums[ends] - self.sums[starts]) * self.unshift[starts])

    def windows(self, size):
        """Hashes of all substrings of ``size`` bytes."""
        return mix((self.sums[size:] - self.sums[:-size]) * self.unshift[: len(self.sums) - size])


def mix(x):
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(data, ends, space=SPACE):
    """Starts, ends and row numbers of the words: maximal runs outside ``space`` that stay inside one row."""
    is_word = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], is_word[:-1]]) if len(data) else is_word
    after = np.concatenate([is_word[1:], [False]]) if len(data) else is_word
    first = np.flatnonzero(is_word & (~before | edge[:-1]))
    last = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return first, last, np.searchsorted(ends, first, "right") - 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label, per_class, classes=(0, 1), seed=1) -> DataFrame:
    """Bounded sample of labelled rows to learn from: ``text``, ``label``; at most ``per_class`` of each class.

    Ids are drawn from all labels by the order of a hash, held-out ids never; they are few, so they
    are broadcast and the texts do not move. Null or other labels are left out; of repeated labels of
    an id the largest counts.
    """
    known = labels.where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class) for c in classes]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionAll(part)
    ids = ids.select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label"))
    plain = texts(docs)
    return plain.join(F.broadcast(ids), plain["doc_id"] == ids["of"]).select("text", "label")
