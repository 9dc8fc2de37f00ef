"""Repeated byte strings by a sparse, distributed suffix sort.

Every window of ``length`` bytes picks one anchor in itself by its content alone: the start of its
32-byte gram with the smallest hash. Equal windows pick equal grams, so only suffixes at anchors
(one byte in 35) are sorted, and of these only the ones whose gram occurs twice in the corpus:
shorter distinguishing prefixes never travel. An anchor stands for the run of windows that picked
it; that run's bytes are its sort key, grouped by gram.

Each task sorts its keys, drops what it has seen itself, and front-codes the run (length of the
prefix shared with the key before, then the rest). Runs go to the task of their gram, where a loser
tree merges them and compares two keys only beyond the prefix that they are known to share. In that
order the longest string that a key shares with any other is the one it shares with a neighbour: it
tells which windows of a key can repeat at all. Few keys of a gram are compared at once; from a gram
with many contexts those windows travel on as digests, so that no task holds the gram.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from awardlake.functions.batches import small_batches
from awardlake.llm.common import Rolling, bytes_of, chunks, mix

GRAM = 32
#: Windows looked at in one pass of numpy.
BLOCK = 1 << 18
#: Anchors or distinct keys that a task holds before it sends a sorted run.
HELD_ANCHORS, HELD_KEYS = 1 << 20, 1 << 16
#: Bytes of text whose anchors meet in one task.
PART_BYTES = 16 << 20
#: Distinct keys of one gram that are compared at once; spans and digests that a task holds before it sends them.
HELD_GRAM, HELD_SPANS = 1 << 16, 1 << 14
LAST_ID = (1 << 63) - 1

_POSITION = np.uint64((1 << 24) - 1)


def anchors(data, ends, length, gram=GRAM):
    """Anchors of the rows of a byte array: row, offset in the row, first and last window start, gram hash."""
    found = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)]
    width = length - gram + 1
    for start in range(0, len(data) - length + 1, BLOCK):
        stop = min(start + BLOCK, len(data) - length + 1)
        hashes = Rolling(data[start : stop + length - 1]).windows(gram)
        least, span = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = width - span
        if rest:
            least = np.minimum(least[: len(least) - rest], least[rest:])
        picked = (least & _POSITION).astype(np.int64)
        window = np.arange(start, stop)
        row = np.searchsorted(ends, window[[0, -1]], "right") - 1
        inside = ends[row[0] : row[1] + 2]
        row_end = np.repeat(inside[1:], np.diff(np.clip(inside, start, stop)))
        good = np.flatnonzero(window + length <= row_end)
        if not len(good):
            continue
        at = picked[good]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(good)]]) - 1
        rows = np.searchsorted(ends, good[first] + start, "right") - 1
        base = ends[rows] - start
        # the smallest hashes are picked, so they are scrambled once more before they deal grams out to parts
        for into, values in zip(found, (rows, at[first] - base, good[first] - base, good[last] - base, mix(hashes[at[first]]))):
            into.append(values)
    return [np.concatenate(x) for x in found]


def _ints(values, kind):
    return pa.array([values], pa.list_(kind))


_ANCHORS = "part int, hashes array<long>, known array<boolean>, rows array<int>, offsets array<int>, ids array<long>, ties array<long>"


def _send_anchors(length, parts):
    """Sorted gram hashes by part; of a gram that a task sees twice one goes to its part, the rest to any."""

    def packed(ids, ties, row, offset, hashes):
        order = np.argsort(hashes, kind="stable")
        row, offset, hashes = row[order], offset[order], hashes[order]
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        known = same | np.concatenate([same[1:], [False]])
        part = (hashes >> np.uint64(33)).astype(np.int64) * parts >> 31
        part[same] = (hashes[same] + offset[same].astype(np.uint64) * np.uint64(7919)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            take = order[bounds[p] : bounds[p + 1]]
            used, index = np.unique(row[take], return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([p], pa.int32()), _ints(hashes[take].view(np.int64), pa.int64()), _ints(known[take], pa.bool_()),
                _ints(index.astype(np.int32), pa.int32()), _ints(offset[take].astype(np.int32), pa.int32()),
                _ints(ids[used], pa.int64()), _ints(ties[used], pa.int64()),
            ], ["part", "hashes", "known", "rows", "offsets", "ids", "ties"])

    def run(batches):
        held, count, docs = [], 0, 0
        for batch in chunks(batches):
            row, offset, _, _, hashes = anchors(*bytes_of(batch.column("text")), length)
            if len(row):
                used, index = np.unique(row, return_inverse=True)
                ids, ties = (batch.column(c).to_numpy()[used] for c in ("id", "tie"))
                held.append((ids, ties, index + docs, offset, hashes))
                docs += len(used)
                count += len(row)
            if count >= HELD_ANCHORS:
                yield from packed(*map(np.concatenate, zip(*held)))
                held, count, docs = [], 0, 0
        if held:
            yield from packed(*map(np.concatenate, zip(*held)))

    return run


def _lists(column):
    """Offsets and flat values of an Arrow list array."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


_OFFSETS = "part int, ids array<long>, ties array<long>, counts array<int>, offsets array<int>"


def _by_document(ids, ties):
    """Order that brings rows of a document together, and where each document starts in it."""
    order = np.lexsort((ties, ids))
    ids, ties = ids[order], ties[order]
    return order, np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])]))


def _repeated_anchors(parts):
    """Of the anchors of a part, those whose gram occurs twice: packed by part of their documents."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        bounds, hashes = _lists(table.column("hashes"))
        hashes = hashes.to_numpy()
        again = _lists(table.column("known"))[1].to_numpy(zero_copy_only=False).copy()
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if not again.any():
            return
        docs, ids = _lists(table.column("ids"))
        row = (_lists(table.column("rows"))[1].to_numpy() + np.repeat(docs[:-1], np.diff(bounds)))[again]
        ids, ties = ids.to_numpy()[row], _lists(table.column("ties"))[1].to_numpy()[row]
        offset = _lists(table.column("offsets"))[1].to_numpy()[again]
        order, first = _by_document(ids, ties)
        ids, ties, offset, counts = ids[order][first], ties[order][first], offset[order], np.diff(np.append(first, len(order)))
        part = (mix(ids.view(np.uint64) ^ mix(ties.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
        starts = np.append(first, len(order))
        for p in np.unique(part):
            take = np.flatnonzero(part == p)
            picked = np.concatenate([offset[starts[i] : starts[i + 1]] for i in take])
            yield pa.RecordBatch.from_arrays([
                pa.array([p], pa.int32()), _ints(ids[take], pa.int64()), _ints(ties[take], pa.int64()),
                _ints(counts[take].astype(np.int32), pa.int32()), _ints(picked.astype(np.int32), pa.int32()),
            ], ["part", "ids", "ties", "counts", "offsets"])

    return run


def _gathered(batches):
    """One row per document with the offsets of its repeated anchors."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    ids, ties, counts, offsets = (
        np.concatenate([_lists(b.column(c))[1].to_numpy() for b in batches]) for c in ("ids", "ties", "counts", "offsets"))
    ids, ties = np.repeat(ids, counts), np.repeat(ties, counts)
    order, first = _by_document(ids, ties)
    lists = pa.ListArray.from_arrays(np.append(first, len(order)).astype(np.int32), pa.array(offsets[order].astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), pa.array(ties[order][first]), lists], ["id", "tie", "offsets"])


_RUNS = (
    "part int, shared array<int>, rest array<int>, bytes binary, backs array<int>, "
    "ids array<long>, ties array<long>, starts array<int>, ends array<int>"
)


def _shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two keys that share ``known`` bytes for certain."""
    size = min(len(a), len(b))
    differs = int.from_bytes(a[known:size]) ^ int.from_bytes(b[known:size])
    return size - (differs.bit_length() + 7) // 8 if differs else size


def _with_anchors(batch):
    """Rows that have anchors to look at, with the text of their document."""
    batch = batch.filter(batch.column("offsets").is_valid())
    columns = [*(batch.column(c) for c in ("id", "tie", "offsets")), batch.column("document").field("text")]
    return pa.RecordBatch.from_arrays(columns, ["id", "tie", "offsets", "text"])


def _send_runs(length, parts):
    """Front-coded sorted runs of distinct keys by part, and what the task itself already knows to be repeated."""

    def packed(held, spans):
        by_part = {}
        for key in sorted(held):
            by_part.setdefault((int.from_bytes(key[0][:4]) >> 1) * parts >> 31, []).append(key)
        for part, keys in by_part.items():
            shared, rest, before = [], [], b""
            for key, _ in keys:
                common = _shared_prefix(before, key, 0)
                shared.append(common)
                rest.append(key[common:])
                before = key
            ids, ties, starts, _ = zip(*(held[k] for k in keys))  # a key's length tells where it ends
            yield row(part, shared, [len(x) for x in rest], b"".join(rest), [k[1] for k in keys], ids, ties, starts, [])
        if spans:
            yield row(abs(hash(spans[0])) % parts, [], [], b"", [], *zip(*spans))

    def row(part, shared, rest, data, backs, ids, ties, starts, ends):
        int32, int64 = pa.int32(), pa.int64()
        return pa.RecordBatch.from_arrays([
            pa.array([part], int32), _ints(shared, int32), _ints(rest, int32), pa.array([data], pa.binary()), _ints(backs, int32),
            _ints(ids, int64), _ints(ties, int64), _ints(starts, int32), _ints(ends, int32),
        ], ["part", "shared", "rest", "bytes", "backs", "ids", "ties", "starts", "ends"])

    def run(batches):
        held, spans = {}, []
        for batch in chunks(map(_with_anchors, batches)):
            data, bounds = bytes_of(batch.column("text"))
            rows, offset, first, last, hashes = anchors(data, bounds, length)
            cuts, wanted = _lists(batch.column("offsets"))
            wanted = wanted.to_numpy().astype(np.int64) + (np.repeat(np.arange(batch.num_rows), np.diff(cuts)) << 32)
            take = np.flatnonzero(np.isin((rows << 32) + offset, wanted))
            raw, base = data.tobytes(), bounds[rows[take]]
            ids, ties = (batch.column(c).to_numpy()[rows[take]] for c in ("id", "tie"))
            columns = (hashes[take], ids, ties, base, first[take], offset[take], last[take] + length)
            for h, doc, tie, at, lo, x, end in zip(*(c.tolist() for c in columns)):
                key = (h.to_bytes(8) + raw[at + x : at + end] + b"\xff" + raw[at + lo : at + x][::-1], x - lo)
                place, old = (doc, tie, lo, end), held.get(key)
                if old is None:
                    held[key] = place
                else:
                    held[key] = min(old, place)
                    spans.append(max(old, place))
            if len(held) >= HELD_KEYS or len(spans) >= 2 * HELD_KEYS:
                yield from packed(held, spans)
                held, spans = {}, []
        yield from packed(held, spans)

    return run


class Run:
    """A front-coded run as arrays over what Arrow delivered; keys are decoded as the merge asks for them."""

    FIELDS = ("shared", "rest", "backs", "ids", "ties", "starts", "ends")

    def __init__(self, batch, row):
        columns = {c: batch.column(c) for c in self.FIELDS}
        self.arrays = [columns[c].values.to_numpy()[slice(*columns[c].offsets[row : row + 2].to_numpy())] for c in self.FIELDS]
        self.bytes = memoryview(batch.column("bytes")[row].as_buffer())

    def spans(self):
        """(id, tie, start, end) of a row that carries spans instead of keys."""
        return zip(*(a.tolist() for a in self.arrays[3:]))

    def __iter__(self, some=256):
        """(shared prefix, key, back length, place) in order."""
        before, at = b"", 0
        for i in range(0, len(self.arrays[0]), some):
            for shared, rest, back, doc, tie, start in zip(*(a[i : i + some].tolist() for a in self.arrays[:6])):
                before = before[:shared] + self.bytes[at : at + rest]
                at += rest
                yield shared, before, back, (doc, tie, start, start + len(before) - 9)


def merged(runs):
    """Merge sorted runs of (shared prefix with the key before, key, ...) by a loser tree.

    Every waiting key carries the length of its common prefix with the last key put out. The longer
    one wins unseen; only on a tie are the keys compared, beyond that prefix.
    """
    runs = [iter(r) for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size

    def play(a, b):
        """(winner, loser); the loser's prefix is set against the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        common = _shared_prefix(x[1], y[1], known[a])
        winner, loser = (a, b) if x[1][common:] <= y[1][common:] else (b, a)
        known[loser] = common
        return winner, loser

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        yield (known[top], *heads[top][1:])
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            known[top] = heads[top][0]
        node, winner = (top + size) // 2, top
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        top = winner


def _window(key, back, depth, length):
    """The window that starts ``depth`` bytes before the anchor; the bytes before it stand reversed behind the separator."""
    ahead = len(key) - 9 - back
    return key[8 : 8 + length - depth] + key[8 + ahead : 9 + ahead + depth]


def _depths(key, back, common, length):
    """Depths of a key's windows that can repeat: their bytes from the anchor on are shared with a neighbour in order."""
    return range(length - min(common, len(key) - 9 - back), back + 1)


def _spans_of_gram(group, length):
    """Repeated spans among the distinct keys of one gram: windows whose content has an earlier place.

    ``group`` has (key, back, place, bytes from the anchor on that a neighbour shares). Windows of one depth (bytes
    before the anchor) are looked at together; of each key only one bit per repeated window is kept,
    and runs of bits leave as one span.
    """
    again, by_depth = [0] * len(group), {}
    for i, (key, back, _, common) in enumerate(group):
        for depth in _depths(key, back, common, length):
            by_depth.setdefault(depth, []).append(i)
    for depth, members in by_depth.items():
        first = {}
        for i in members if len(members) > 1 else ():
            key, back, place, _ = group[i]
            at = (*place[:2], place[2] + back - depth, i)
            window = _window(key, back, depth, length)
            old = first.setdefault(window, at)
            if old is not at:
                if at < old:
                    first[window], at = at, old
                again[at[3]] |= 1 << (at[2] - group[at[3]][2][2])
    for bits, (_, _, place, _) in zip(again, group):
        at = place[2]
        while bits:
            skip = (bits & -bits).bit_length() - 1
            bits, at = bits >> skip, at + skip
            run = (~bits & (bits + 1)).bit_length() - 1
            yield (*place[:2], at, at + run - 1 + length)
            bits, at = bits >> run, at + run


def _keys_in_order(runs):
    """Distinct keys as (key, back, place, common), and spans of equal keys as (None, span); ``common`` is the longest
    prefix (of the bytes from the anchor on) shared with the distinct key before or behind."""
    held = None
    for shared, key, back, place in merged(runs):
        if held is not None and shared == len(key) == len(held[0]) and back == held[1]:
            old = held[2]
            held[2] = min(old, place)
            yield None, max(old, place)
            continue
        if held is not None:
            yield held[0], (*held[1:3], max(held[3], shared) - 8)
        held = [key, back, place, shared]
    if held is not None:
        yield held[0], (*held[1:3], held[3] - 8)


_SPANS = "id long, tie long, starts array<int>, ends array<int>, windows array<binary>"


class _Outbox:
    """Spans, and windows of grams with many contexts, by document; sent on before they become many."""

    def __init__(self):
        self.spans, self.windows, self.count = {}, [], 0

    def span(self, doc, tie, start, end):
        self.spans.setdefault((doc, tie), []).append((start, end))
        self.count += 1

    def window(self, place, starts, ends, digests):
        self.windows.append((*place[:2], starts, ends, digests))
        self.count += len(starts)

    def packed(self, least=HELD_SPANS):
        if self.count < least:
            return
        joined = [(*doc, *map(list, zip(*union(spans))), None) for doc, spans in self.spans.items()]
        joined += self.windows
        self.__init__()
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        for i in range(0, len(joined), 1024):
            columns = zip(*joined[i : i + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "tie", "starts", "ends", "windows"])


def _digest(window):
    return hashlib.blake2b(window, digest_size=16).digest()


def _merge_part(length, most):
    def run(batches):
        runs, out = [], _Outbox()
        for batch in batches:
            for row in range(batch.num_rows):
                found = Run(batch, row)
                if len(found.arrays[0]):
                    runs.append(found)
                else:
                    for span in found.spans():
                        out.span(*span)
                    yield from out.packed()
        group, gram, many = [], None, False

        def settle():
            if len(group) > 1 and not many:
                for span in _spans_of_gram(group, length):
                    out.span(*span)

        def digests(key, back, place, common):
            depths = _depths(key, back, common, length)
            if depths:
                starts = [place[2] + back - d for d in depths]
                out.window(place, starts, [p + length for p in starts], [_digest(_window(key, back, d, length)) for d in depths])

        for key, found in _keys_in_order(runs):
            if key is None:
                out.span(*found)
                continue
            if key[: 8 + GRAM] != gram:
                settle()
                group, gram, many = [], key[: 8 + GRAM], False
            if many:
                digests(key, *found)
            else:
                group.append((key, *found))
                if len(group) > most:
                    for member in group:
                        digests(*member)
                    group, many = [], True
            yield from out.packed()
        settle()
        yield from out.packed(least=1)

    return run


def _again(found: DataFrame) -> DataFrame:
    """Spans of the windows among ``found`` (rows with digests) whose content has an earlier place."""
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("windows").alias("window"))
    # the outer form: a plain one would put a filter below the shuffle, which then is another one
    each = found.select("id", "tie", F.inline_outer(zipped)).where(F.col("window").isNotNull())
    place = F.struct("id", "tie", "start", "end")
    firsts = each.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = each.join(firsts.select("window", "first"), "window").where(place != F.col("first"))
    return later.select("id", "tie", F.array("start").alias("starts"), F.array("end").alias("ends"))


def union(spans):
    """Maximal spans covered by (start, end) pairs."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def repeated_spans(docs: DataFrame, length=100, at_once=HELD_GRAM) -> DataFrame:
    """Bytes covered by a string of ``length`` bytes that also starts earlier: ``document`` (all columns), ``starts``, ``ends``.

    Places are ordered by ``doc_id`` (null last), then by start; strings never cross documents and
    are judged on the input. ``starts`` and ``ends`` are byte spans of the UTF-8 text; they may touch
    or overlap, and are null where nothing repeats. A null text is empty. Rows that repeat an id are
    ordered by a hash of their texts; rows that repeat id and text are one document and get the same
    spans. One row per input row; column names of the input cannot clash. Of a gram with more than
    ``at_once`` contexts no task holds more than that many.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    tag = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(tag + "id"), F.xxhash64("text").alias(tag + "tie")]
    keyed = docs.select("*", *key)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    plain = keyed.select(F.col(tag + "id").alias("id"), F.col(tag + "tie").alias("tie"), F.col("text").alias("text"))
    sent = plain.mapInArrow(_send_anchors(length, parts), _ANCHORS).repartition(parts, "part")
    packed = sent.mapInArrow(_repeated_anchors(parts), _OFFSETS).repartition(parts, "part")
    wanted = packed.mapInArrow(_gathered, "id long, tie long, offsets array<int>")
    wanted = wanted.select(F.col("id").alias("wid"), F.col("tie").alias("wtie"), "offsets")
    # both joins are outer ones that need the same columns, so that one shuffle of the texts serves both
    chosen = keyed.join(wanted, (F.col(tag + "id") == F.col("wid")) & (F.col(tag + "tie") == F.col("wtie")), "left")
    document = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    chosen = chosen.select(document, F.col(tag + "id").alias("id"), F.col(tag + "tie").alias("tie"), "offsets")
    runs = chosen.mapInArrow(_send_runs(length, parts), _RUNS).repartition(parts, "part")
    # spans and windows are read from one shuffle: neither side filters or drops columns before it; it has as
    # many parts as the join with the texts, which so need no second one
    known = F.col("id").isNotNull() & F.col("tie").isNotNull()  # what the join below asks of some of the sides
    found = runs.mapInArrow(_merge_part(length, at_once), _SPANS).where(known).repartition("id", "tie")
    alone = lambda c: F.when(F.col("windows").isNull(), F.col(c)).alias(c)
    spans = found.select("id", "tie", alone("starts"), alone("ends")).unionAll(_again(found))
    spans = spans.groupBy("id", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    spans = spans.select(F.col("id").alias(tag + "sid"), F.col("tie").alias(tag + "stie"), F.col("starts").alias(tag + "starts"), F.col("ends").alias(tag + "ends"))
    found = keyed.join(spans, (F.col(tag + "id") == F.col(tag + "sid")) & (F.col(tag + "tie") == F.col(tag + "stie")), "left")
    return found.select(document, F.col(tag + "starts").alias("starts"), F.col(tag + "ends").alias("ends"))


def _kept(text: bytes, spans):
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    parts.append(text[at:])
    return b"".join(parts)


def digests(docs: DataFrame, length=100, at_once=HELD_GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every document without its repeated bytes."""

    def run(batches):
        for batch in chunks(batches):
            rows = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                spans = union(zip(starts or [], ends or []))
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
            n, removed, count, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_spans(docs.select("doc_id", "text"), length, at_once)
    text = F.coalesce(F.col("document.text"), F.lit("")).cast("binary").alias("text")
    flat = found.select(F.col("document.doc_id").cast("long").alias("doc_id"), text, "starts", "ends")
    return flat.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length=100) -> DataFrame:
    """The documents, all columns, with repeated bytes cut out of ``text``; characters are never split."""
    found = repeated_spans(docs, length)

    def run(batches):
        for batch in chunks(batches):
            out = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                spans = []
                for start, end in union(zip(starts or [], ends or [])):
                    while start < end and text[start] & 0xC0 == 0x80:
                        start += 1
                    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                        end -= 1
                    spans.append((start, end))
                out.append(None if text is None else _kept(text, spans).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(out, pa.string())], ["document", "kept"])

    schema = f"document {found.schema['document'].dataType.simpleString()}, kept string"
    carried = found.select("document", F.col("document.text").cast("binary").alias("text"), "starts", "ends").mapInArrow(run, schema)
    return carried.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"document.`{c}`") for c in docs.columns))
