"""I-Match against a plain computation with the xxhash library."""

import hashlib
import random
import struct

import regex
import xxhash

from awardlake.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_long(value, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed % (1 << 64))


def terms(text):
    return list(dict.fromkeys(signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t))


def brute(texts):
    counts = {}
    for t in texts:
        for slot in {h % imatch.SLOTS for h in terms(t)}:
            counts[slot] = counts.get(slot, 0) + 1
    low, high = (max(2, share * len(texts)) for share in imatch.BAND)
    lexicon = {s for s, c in counts.items() if low <= c <= high}

    def fingerprint(text):
        others = sorted(h for h in terms(text) if h % imatch.SLOTS not in lexicon)
        kept = [h for h in terms(text) if h % imatch.SLOTS in lexicon] + others[: -(-len(others) // imatch.OUTSIDE)]
        subsets, base = {}, 0
        for parts, used in imatch.FAMILIES:
            for h in kept:
                cell = signed(xxhash.xxh64_intdigest(struct.pack("<i", parts), of_long(h))) % parts
                if cell < used:
                    subsets.setdefault(base + cell, []).append(h)
            base += used
        out = {}
        for cell, members in subsets.items():
            seed = 42
            for h in sorted(members):
                seed = of_long(h, seed)
            out[cell] = seed & 0xFFFFFFFF
        return out

    return fingerprint


def near(a, b):
    either = len(a.keys() | b.keys())
    return sum(b.get(c) == h for c, h in a.items()) / either if either else 1.0


def as_text(parts):
    return ".".join(f"{(cell << 32) | h:x}" for cell, h in sorted(parts.items()))


def check(spark, rows):
    tie = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    fingerprint = brute([t or "" for _, t in rows])
    want = {}
    for i, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = fingerprint(text), fingerprint(edited)
        want[doc, text] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), round(near(own, changed), 9), round(near(own, fingerprint(after)), 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = imatch.fingerprints(docs).collect()
    assert sorted((r[0] or 0, *r[1:5], round(r[5], 9), round(r[6], 9)) for r in found) == sorted((k[0] or 0, *v) for k, v in want.items())


def test_matches_a_plain_computation(spark):
    rng = random.Random(8)
    words = [f"w{chr(233)}{i}" for i in range(500)] + ["the", "OF", "and"]
    rows = [(i * 37 % 1009 - 300, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 60, 200]))) + rng.choice(["", ".", "🙂"])) for i in range(120)]
    check(spark, rows + [(None, "w1 the w2"), (5000, None)])


def test_many_rows_without_an_id_or_with_one_id(spark):
    rng = random.Random(10)
    rows = [(rng.choice([None, None, 3, 4, 9]), " ".join(rng.choices([f"w{i}" for i in range(80)], k=rng.randint(1, 40))) + f" {i}") for i in range(150)]
    check(spark, rows)
    spread = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is null").groupBy("bucket").count().collect()
    assert len(spread) > 1


def test_near_copies_of_a_large_group_stay_alike(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(4000)]
    base = rng.sample(pool, 200)
    rows = []
    for i in range(1000):
        words = list(base) if i % 10 < 3 else rng.choices(pool, k=200)
        words[rng.randrange(200)] = rng.choice(pool)
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.near_next for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = [v for i, v in found.items() if i % 10 in (1, 2)]
    others = [v for i, v in found.items() if i % 10 > 3]
    assert min(copies) > 0.6 and max(others) < 0.2


def test_one_document_equal_texts_and_empty_tables(spark):
    check(spark, [(7, "one two three four")])
    docs = spark.createDataFrame([(1, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 3), (3, "", 4), (4, None, 5), (5, "z " * 100000, 6)], "doc_id long, text string, place int")
    got = imatch.fingerprints(docs).collect()
    assert len(got) == 6 and len({r.fingerprint for r in got if r.doc_id < 3}) == 1
    assert all(r.fingerprint == "" for r in got if r.doc_id in (3, 4))
    assert imatch.fingerprints(docs.limit(0)).collect() == []


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    plan = imatch.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_copies_do_not_push_their_terms_out_of_the_band(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(3000)], k=40))) for i in range(100)]
    words = [f"copy{j}" for j in range(60)]
    rows += [(1000 + i, " ".join(words)) for i in range(50)] + [(2000, " ".join([*words, rows[0][1].split()[0]]))]
    parts = {}
    for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        parts[r.doc_id] = {int(x, 16) >> 32: int(x, 16) for x in r.fingerprint.split(".")}
    assert near(parts[1000], parts[2000]) > 0.9 and near(parts[1000], parts[0]) < 0.1
