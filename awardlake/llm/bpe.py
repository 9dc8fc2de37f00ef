"""Byte-level BPE by a monoid of encodings: halves are encoded apart and joined at their boundary.

Two encodings are joined by re-encoding a window around the boundary that grows until the tokens
next to it are stable. Stability is provable: a token sequence is the encoding of its bytes exactly
if every two neighbours are the encoding of their own bytes. (The first merge that would cross a
boundary between two tokens involves these two alone, so it would happen in the pair as well.)
Decoding concatenates up the same tree.
"""

import base64
import functools
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.llm.common import texts

#: Pieces up to this many bytes are leaves of the tree.
LEAF = 6
#: Entries of the cache from piece to ids (there are two: a full one and the one being filled), and of those of leaves and seams.
CACHE, SHORT = 1 << 16, 1 << 16
#: Documents handed back to Spark at once.
ROWS = 256


#: Stands for a pair that is no token.
NONE = 1 << 62


def read_ranks(path) -> bytes:
    """The raw rank file; a vocabulary has a fixed size, so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(256)
def _packer(n):
    return struct.Struct(f"<{n}I").pack


class Merges:
    """Encoder of single pieces for one table of ranks (every single byte must have a rank). Encodings are tuples of ids."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.short = functools.lru_cache(SHORT)(self._merge_short)
        self.seam = functools.lru_cache(SHORT)(self._seam)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge neighbours by lowest rank, leftmost first, until none is in the table."""
        return self.short(piece) if len(piece) <= 16 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        get, parts = ranks.get, [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NONE)
        return tuple([ranks[part] for part in parts])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over linked parts: n log n for long windows."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _seam(self, left: int, right: int) -> tuple[int, ...] | None:
        """The encoding of the joint bytes of two tokens; None if it is these two, that is, if they are stable."""
        found = self.merge(self.tokens[left] + self.tokens[right])
        return None if found == (left, right) else found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left + right
        seam, window = self.seam, self.seam(left[-1], right[0])
        if window is None:
            return left + right
        i = j = 1
        while True:
            left_ok = i == len(left) or seam(left[-i - 1], window[0]) is None
            right_ok = j == len(right) or seam(window[-1], right[j]) is None
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i = i if left_ok else min(len(left), 2 * i)
            j = j if right_ok else min(len(right), 2 * j)
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def tree(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= LEAF:
            return self.short(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def ids(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers; a piece that is a token stays whole."""
        whole = self.ranks.get(piece)
        found = self.tree(piece) if whole is None else (whole,)
        return _packer(len(found))(*found)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 12:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Pieces(dict):
    """Cache from piece to its ids; a full one is kept as the older one until the next is full, so that frequent pieces stay."""

    def __init__(self, merges):
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, piece):
        found = self.older.get(piece)
        if found is None:
            found = self.merges.ids(piece.encode())
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


@functools.lru_cache(2)
def _merges(raw):
    return Merges(raw)


@functools.lru_cache(2)
def _pieces(raw):
    return Pieces(_merges(raw))


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _encoding(shared, pattern):
    def run(batches):
        import regex

        find, pieces = regex.compile(pattern).findall, _pieces(shared.value)
        for batch in _slices(batches):
            ids = [b"".join(map(pieces.__getitem__, find(t))) for t in batch.column("text").to_pylist()]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoding(shared):
    def run(batches):
        merges = _merges(shared.value)
        for batch in _slices(batches):
            out = [merges.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks_path, pattern) -> DataFrame:
    """Encode whole texts: ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit).

    Each match of ``pattern`` is encoded by itself; no special tokens. A null or empty text has no
    ids. One row per input row, repeated rows included; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return texts(docs).mapInArrow(_encoding(shared, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path, keep=("doc_id",)) -> DataFrame:
    """Decode ``ids``: the kept columns, ``ids`` and ``decoded`` (binary). Null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    picked = encoded.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    return picked.mapInArrow(_decoding(shared), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, ranks_path, pattern) -> DataFrame:
    """What :func:`decode` makes of :func:`encode`: ``doc_id``, ``n_tokens``, ``ids``, ``decoded``.

    Both steps run in one Python process of a task. Two chained ones would each keep one, and executors
    hold on to idle processes, with all that they have grown to, through the stages that follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    encoding, decoding = _encoding(shared, pattern), _decoding(shared)
    return texts(docs).mapInArrow(lambda batches: decoding(encoding(batches)), "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path, pattern) -> DataFrame:
    """Round trip of every document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    decoded = decode(encode(docs, ranks_path, pattern), ranks_path, keep=("doc_id", "n_tokens"))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
