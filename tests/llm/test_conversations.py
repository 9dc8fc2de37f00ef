"""Conversation repair against all edit sequences of small conversations; bounded tree, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

from awardlake.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def plain_faults(rows):
    """Fault of each (turn, role, text) row in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[ \t-\r]", "", text)
        fault = c.BLANK if not body else c.DUPLICATE if (role, text) in seen else 0 if body[-1] in ".!?" else c.CUT_SHORT
        seen.add((role, text))
        out.append(fault)
    return out


def plain_best(rows, inserts):
    """(cost, edits, repaired) of the best of all sequences: up to ``inserts`` insertions before each row and at the end."""
    faults, best = plain_faults(rows), None
    fills = [g for k in range(inserts + 1) for g in itertools.product("ua", repeat=k)]
    choices = [["D"] if f in (c.BLANK, c.DUPLICATE) else ["D", "K", "Ru", "Ra"] for f in faults]
    for ops in itertools.product(*choices):
        for filled in itertools.product(fills, repeat=len(rows) + 1):
            stay = ["" if op == "D" else row[1][:1] or "?" if op == "K" else op[1:] for op, row in zip(ops, rows)]
            roles = "".join("".join(fill) + x for fill, x in zip(filled, (*stay, "")))
            if not GOAL.match(roles):
                continue
            cost = sum(5 * len(fill) for fill in filled)
            cost += sum(2 if op == "D" else (op != "K") + 5 * (fault == c.CUT_SHORT) for op, fault in zip(ops, faults))
            audit = "".join("I" * len(fill) + op[:1] for fill, op in zip(filled, (*ops, "")))
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, applied(rows, filled, ops))
    return best


def applied(rows, filled, ops):
    names = {"u": "user", "a": "assistant"}
    out = []
    for fill, op, row in zip(filled, (*ops, "D"), (*rows, None)):
        out += [(names[x], "") for x in fill]
        if op != "D":
            out.append((row[1] if op == "K" else names[op[1]], row[2]))
    return out


def plain_strings(rows):
    """(cost, edits) with whole strings kept per ending, for longer conversations."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def with_inserts(best):
        for _ in range(3):
            for end, (cost, edits) in list(best.items()):
                for x in set(follow[end]) & set("ua"):
                    best[x] = min(best.get(x, (9**9,)), (cost + 5, edits + "I"))
        return best

    for row, fault in zip(rows, plain_faults(rows)):
        new = {}
        for end, (cost, edits) in with_inserts(best).items():
            ways = [(end, 2, "D")]
            if fault not in (c.BLANK, c.DUPLICATE):
                extra = 5 * (fault == c.CUT_SHORT)
                ways += [(x, extra, "K") for x in follow[end] if x == row[1][:1]] + [(x, extra + 1, "R") for x in follow[end] if x != "s"]
            for x, price, edit in ways:
                new[x] = min(new.get(x, (9**9,)), (cost + price, edits + edit))
        best = new
    best = with_inserts(best)
    return min(best[end] for end in ("", "a") if end in best)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    return sorted(((t, r, x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def plain_audit(rows):
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, *(faults.count(f) for f in (c.BLANK, c.DUPLICATE, c.CUT_SHORT)), sum(p not in ("su", "ua", "au") for p in pairs))


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def searched(rows):
    """Cost and edits of the search alone, and the largest tree."""
    out, largest = [], 0
    search = c.Search(lambda edits, row: out.append(edits))
    for row, fault in zip(rows, plain_faults(rows)):
        search.delete() if fault in (c.BLANK, c.DUPLICATE) else search.read(row[1][:1], fault == c.CUT_SHORT, row)
        size, todo = 0, [search.root]
        while todo:
            node = todo.pop()
            size, todo = size + 1, todo + node.children
        largest = max(largest, size)
    return search.end(), "".join(out), largest


def test_search_finds_the_least_of_all_edits():
    rng = random.Random(7)
    for _ in range(160):
        n = rng.choice([1, 2, 2, 3, 3])
        rows = [(t, rng.choice(["system", "user", "assistant", "assistant", "tool", ""]), rng.choice(["Hi.", "Yes!", "and so", " ", "What?"])) for t in range(n)]
        cost, audit, _ = plain_best(rows, inserts=2 if n < 3 else 1)
        assert searched(rows)[:2] == plain_strings(rows) == (cost, audit), rows


def test_long_ties_are_decided_by_the_whole_string():
    rng = random.Random(8)
    for _ in range(400):
        roles, ends = rng.choice([["tool"], ["tool", "user"], ["system", "tool", "user", "assistant"]]), rng.choice([".", ".?", ".a"])
        rows = [(t, rng.choice(roles), rng.choice(["", "same", f"{t}", f"{t}"]) + rng.choice(ends)) for t in range(rng.randrange(30))]
        assert searched(rows)[:2] == plain_strings(rows), rows
    # unknown roles: which row is deleted stays open to the end
    assert searched([(t, "tool", f"{t}.") for t in range(501)])[1] == "D" + "R" * 500
    assert searched([(t, "tool", f"{t}.") for t in range(500)])[1] == "R" * 500


def test_tree_stays_small_over_a_long_conversation():
    rng = random.Random(9)
    rows = [(t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", ".", ".", ""])) for t in range(5000)]
    assert searched(rows)[2] < 200


def test_query_on_damaged_rows(spark):
    rng = random.Random(10)
    rows = []
    for conv in [None, *range(40)]:
        for turn in rng.sample([None, 0, 1, 2, 3, 7], rng.choice([1, 2, 2, 3])):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", None]), rng.choice(["Yes. No", "Ok.", "é!", None, "\t\n", "So. "])))
    found = {r.conv_id: r for r in c.audits(c.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()}
    new = c.repaired(c.damaged(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "seq").collect()
    convs = {r[0] for r in rows}
    assert set(found) == convs
    for conv in convs:
        mine = in_order([r for r in plain_damage(rows) if r[0] == conv])
        cost, audit, out = plain_best(mine, inserts=1 if len(mine) > 2 else 2)
        row = found[conv]
        assert tuple(row)[1:6] == plain_audit(mine), mine
        assert (row.cost, row.audit, row.repaired_sha256) == (cost, audit, digest(out)), mine
        assert [(r.role, r.text) for r in new if r.conv_id == conv] == out


def test_repeats_ties_long_texts_clashing_columns_and_empty_tables(spark):
    long = "wörter " * 200_000 + "."
    rows = [(1, 5, "user", long), (1, 5, "user", long), (1, 5, "user", long), (1, 6, "assistant", "A."), (2, None, "user", "a."), (2, None, "assistant", "b."), (3, -(1 << 63), "user", "x."), (3, (1 << 63) - 1, "assistant", "y.")]
    frame = spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA + ", copy int, digest string")
    found = {r.conv_id: r for r in c.audits(c.plain(frame)).collect()}
    assert found[1].audit == "KDDK" and found[1].cost == 4 and found[1].repaired_sha256 == digest([("user", long), ("assistant", "A.")])
    assert found[2].audit == plain_strings(in_order([r for r in rows if r[0] == 2]))[1] and found[2].gaps == 0
    assert found[3].gaps == (1 << 63) - 1
    assert c.audits(c.damaged(frame.limit(0))).collect() == [] and c.repaired(c.plain(frame.limit(0))).collect() == []


def test_a_kept_row_before_a_deleted_one_keeps_its_role(spark):
    rows = [(1, 0, "unicorn", "What?"), (1, 1, "a", "Hi."), (1, 2, "user", " "), (2, 0, "system", "S."), (2, 1, "system", "S."), (2, 2, "user", "U."), (2, 3, "assistant", "A.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: r for r in c.audits(c.plain(frame)).collect()}
    assert found[1].audit == "KKD" and found[1].repaired_sha256 == digest([("unicorn", "What?"), ("a", "Hi.")])
    assert found[2].audit == "KDKK" and found[2].repaired_sha256 == digest([("system", "S."), ("user", "U."), ("assistant", "A.")])
    assert [r.edit for r in c.repaired(c.plain(frame)).orderBy("conv_id", "seq").collect()] == list("KKKKK")
