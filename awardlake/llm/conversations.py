"""Repair of conversation structure by a Viterbi search with coalescing survivors.

A conversation's rows are edited at least cost until the first letters of its roles read
``(s?(ua)+)?``. The search keeps one survivor per state (nothing yet, system, user, assistant) in a
tree of backpointers. A node without survivors below it is dropped; as soon as all survivors share
an ancestor, the edits up to it are final and leave the tree. Equal costs are decided by the whole
strings of edits: survivors are kept in that order, so a tie needs no walk back through the tree.

Three steps, none of which holds a conversation's texts: narrow rows (first letter of the role,
fault, digest of the text) are sorted by conversation and searched; the edits, one per row that stays,
are sorted together with the texts; the repaired rows stream out in order.
"""

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from awardlake.llm.common import small_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: Faults of a row.
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
#: What the letters so far end with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
LAST_LONG = (1 << 63) - 1


class Node:
    """Edits of one row, the deletions that follow in all strings below, and the row."""

    __slots__ = ("parent", "children", "edits", "row")

    def __init__(self, parent, edits, row):
        self.parent, self.edits, self.row, self.children = parent, edits, row, []
        if parent is not None:
            parent.children.append(self)


class Search:
    """Cheapest edits of one conversation; ``settled`` takes (edits of a row, row) in order as soon as they are final."""

    def __init__(self, settled):
        self.settled = settled
        self.root = Node(None, "", None)
        #: state: (cost, rank among the survivors by their strings of edits, node)
        self.survivors = {NOTHING: (0, 0, self.root)}

    def delete(self):
        """A row that must go. Deletions stand before insertions in the least string, so nothing is inserted before it."""
        for state, (cost, rank, node) in self.survivors.items():
            self.survivors[state] = (cost + DELETE, rank, node)
            if node is self.root:
                self.settled("D", None)
            else:
                node.edits += "D"

    def read(self, initial, truncated, row):
        """A row that may stay, by the first letter of its role."""
        extra = TRUNCATED * truncated
        ways = {
            USER: ("K", extra) if initial == "u" else ("R", extra + REROLE),
            ASSISTANT: ("K", extra) if initial == "a" else ("R", extra + REROLE),
        }
        best = {}

        def offer(state, cost, rank, edits, node):
            new = (cost, rank, edits, node)
            if state not in best or new[:3] < best[state][:3]:
                best[state] = new

        for state, (cost, rank, node) in self.survivors.items():
            offer(state, cost + DELETE, rank, "D", node)
            if state == NOTHING and initial == "s":
                offer(SYSTEM, cost + extra, rank, "K", node)
            for target, (edit, price) in ways.items():
                # a user follows anything but a user, an assistant follows a user; one insertion helps
                if (state == USER) == (target == ASSISTANT):
                    offer(target, cost + price, rank, edit, node)
                else:
                    offer(target, cost + price + INSERT, rank, "I" + edit, node)
        self._without_hopeless(best)
        order = sorted(best, key=lambda s: best[s][1:3])
        before = {id(node): node for _, _, node in self.survivors.values()}
        self.survivors = {s: (best[s][0], place, Node(best[s][3], best[s][2], row)) for place, s in enumerate(order)}
        for node in before.values():
            self._release(node)
        self._settle()

    @staticmethod
    def _without_hopeless(best):
        """Drop states from which every end costs more than from another one, so that survivors meet."""
        far = float("inf")
        cost = {s: best[s][0] if s in best else far for s in range(4)}
        # after an assistant, or a user and an insertion, all goes on as after nothing, but for a system row that is to go
        if min(cost[ASSISTANT], cost[USER] + INSERT) + DELETE < cost[NOTHING]:
            best.pop(NOTHING, None)
        if min(cost[ASSISTANT], cost[USER] + INSERT) < cost[SYSTEM]:
            best.pop(SYSTEM, None)
        if cost[USER] + INSERT < cost[ASSISTANT]:
            best.pop(ASSISTANT, None)
        if cost[ASSISTANT] + INSERT < cost[USER]:
            best.pop(USER, None)

    def _release(self, node):
        while not node.children and node is not self.root:
            parent = node.parent
            parent.children.remove(node)
            node = parent

    def _settle(self):
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.settled(self.root.edits, self.root.row)

    def end(self):
        """Settle what is left; the least cost."""
        tails = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
        cost, _, tail, node = min((c + tails[s][0], rank, tails[s][1], n) for s, (c, rank, n) in self.survivors.items())
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.settled(node.edits, node.row)
        if tail:
            self.settled(tail, None)
        return cost


def plain(conversations: DataFrame) -> DataFrame:
    """Rows as the search takes them: ``conv_id``, ``turn``, ``role``, ``text`` (nulls: one space), ``copy``, ``dropped``."""
    return conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of ``conv_id:turn`` (nulls: one space), as ``plain`` gives them.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out, 3 repeats the row, 4 makes
    its role ``user``. Dropped rows stay as a mark of their conversation.
    """
    rows = plain(conversations)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def _digest():
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without texts, those of a conversation together and in order: by turn, role, digest, copy."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(CUT_SHORT)
    live = [F.when(~F.col("dropped"), F.col(c)).alias(c) for c in ("turn", "role")]
    narrow = rows.select("conv_id", *live, F.when(~F.col("dropped"), _digest()).alias("digest"), "copy", "dropped", fault.alias("fault"))
    # one shuffle: both the window and the search need a conversation's rows in one task
    narrow = narrow.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when((F.col("fault") != BLANK) & again & ~F.col("dropped"), DUPLICATE).otherwise(F.col("fault"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy"]
    return narrow.select("conv_id", "turn", "role", "digest", "copy", "dropped", fault.alias("fault")).sortWithinPartitions(*order)


def _each(batches, *columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_EDIT_FIELDS = [
    ("place", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("tag", pa.int32()), ("edits", pa.string()),
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()),
]
_EDITS = (
    "place int, turn long, role string, digest binary, tag int, edits string, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
#: Where a line of the edits stands among the lines of its conversation.
SUMMARY, ROWS, TAIL = range(3)
_SENT = 4096


def _edit_lines(rows):
    """Lines of the edits of all conversations in ``rows``: those of rows that stay, insertions at the end, a summary."""
    none = (None,) * 7
    for conv, members in groupby(rows, key=lambda r: r[0]):
        audit, lines = [], []

        def settled(edits, row, audit=audit, lines=lines):
            audit.append(edits)
            if edits.strip("D"):
                lines.append((SUMMARY + 1, *row, 0, edits) if row else (TAIL, None, None, None, 0, edits))

        search = Search(settled)
        counts, illegal, before = [0, 0, 0, 0], 0, None
        first = last = None
        turns = 0
        for _, turn, role, digest, dropped, fault in members:
            if dropped:
                continue
            initial = role[:1]
            counts[fault] += 1
            if before is not None and before + initial not in LEGAL:
                illegal += 1
            before = initial
            if turn is not None and turn != last:
                first = turn if first is None else first
                last, turns = turn, turns + 1
            if fault in (BLANK, DUPLICATE):
                search.delete()
            else:
                search.read(initial, fault == CUT_SHORT, (turn, role, digest))
            if lines:
                for line in lines:
                    yield (conv, *line, *none)
                lines.clear()
        cost = search.end()
        for line in lines:
            yield (conv, *line, *none)
        gaps = 0 if first is None else min(last - first + 1 - turns, LAST_LONG)
        yield (conv, SUMMARY, None, None, None, 0, None, gaps, *counts[1:], illegal, cost, "".join(audit))


def edits(rows: DataFrame) -> DataFrame:
    """Cheapest edits of every conversation of ``plain`` or ``damaged`` rows.

    Lines of ``place`` 0 sum a conversation up (``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``); of 1
    say how a row stays (``turn``, ``role``, ``digest``; ``edits`` is K or R behind the insertions before it, and D for each row that
    goes after it); of 2 hold insertions at the end.
    Rows of one turn are ordered by role and digest of the text. A role without a first letter can't be kept as it is.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held = []
        for line in _edit_lines(_each(batches, "conv_id", "turn", "role", "digest", "dropped", "fault")):
            held.append(line)
            if len(held) == _SENT:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(lines):
        conv, *columns = zip(*lines)
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _EDIT_FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array(conv), *arrays], ["conv_id", *(n for n, _ in _EDIT_FIELDS)])

    return _narrow(rows).select("conv_id", "turn", "role", "digest", "dropped", "fault").mapInArrow(run, f"conv_id {kind}, {_EDITS}")


def _with_texts(rows: DataFrame) -> DataFrame:
    """Lines of the edits and texts of the rows, a conversation's together: its summary first, an edit just before its text."""
    live = rows.where(~F.col("dropped") & (F.rtrim("text", F.lit(SPACES)) != ""))
    given = live.select("conv_id", F.lit(ROWS).alias("place"), "turn", "role", _digest(), F.lit(1).alias("tag"), "text")
    both = edits(rows).unionByName(given, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "place", F.asc_nulls_first("turn"), "role", "digest", "tag")


def _applied(batches):
    """(conversation, summary or None, new row or None) out of sorted lines and texts."""
    names = ("conv_id", "place", "turn", "role", "digest", "tag", "edits", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    state, wanted = NOTHING, None
    for conv, place, turn, role, digest, tag, todo, text, *summary in _each(batches, *names):
        if place == SUMMARY:
            state, wanted = NOTHING, None
            yield conv, summary, None
        elif tag == 0:
            for _ in range(todo.count("I")):
                state = ASSISTANT if state == USER else USER
                yield conv, None, ("I", None, ROLES[state], "")
            # deletions of later rows may stand behind the edit of this one
            wanted = (turn, role, digest, todo.rstrip("D")[-1]) if place == ROWS else None
        elif wanted is not None and wanted[:3] == (turn, role, digest):
            edit, wanted = wanted[3], None
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            else:
                state = ASSISTANT if state == USER else USER
                role = ROLES[state]
            yield conv, None, (edit, turn, role, text)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``seq`` (from 0), ``edit`` (K, R, I), ``turn`` (null: inserted), ``role``, ``text``.

    Takes ``plain`` or ``damaged`` rows. A conversation of which nothing stays has no rows.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def numbered():
            seq = 0
            for conv, summary, row in _applied(batches):
                if summary is not None:
                    seq = 0
                else:
                    yield (conv, seq, *row)
                    seq += 1

        held, size = [], 0
        for line in numbered():
            held.append(line)
            size += len(line[-1])
            if len(held) == _SENT or size > 1 << 20:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(lines):
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), types)], ["conv_id", "seq", "edit", "turn", "role", "text"])

    return _with_texts(rows).mapInArrow(run, f"conv_id {kind}, seq long, edit string, turn long, role string, text string")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``plain`` or ``damaged`` rows: faults, cost, edits, digest of the repaired conversation.

    ``conv_id`` (null is a conversation of its own), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired_sha256``. Zeros, no edits and the digest of an empty string without rows. Turns that lie more than 2**63 apart
    count as that many gaps. Repeated rows are duplicates; other columns are ignored; an empty table gives an empty result.
    A conversation passes through one task, row by row: its digest depends on all of it in order.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def lines():
            known, sha, first = None, None, True
            for conv, summary, row in _applied(batches):
                if summary is not None:
                    if known is not None:
                        yield (*known, sha.hexdigest())
                    known, sha, first = (conv, *summary), hashlib.sha256(), True
                else:
                    sha.update((f"{row[2]}:" if first else f"\n{row[2]}:").encode())
                    sha.update(row[3].encode())
                    first = False
            if known is not None:
                yield (*known, sha.hexdigest())

        held = []
        for line in lines():
            held.append(line)
            if len(held) == _SENT:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(lines):
        types = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), types)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _with_texts(rows).mapInArrow(run, schema)
