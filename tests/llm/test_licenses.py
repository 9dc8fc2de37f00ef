"""License scans against a plain search."""

import random
import re

from awardlake.llm import licenses


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split(" ")
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_match_a_plain_search(spark):
    rng = random.Random(4)
    bits = ["gnu", "General", "public", "LICENSE", "apache", "license", "cc", "by", "cc-by", "mit", "MIT License", "GNU general\npublic license", "é", "licenſe", "x1"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(300)] + [(301, None), (None, "MIT license"), (302, "q " * 50000 + "mit license")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_notices_with_changed_words_and_clean_texts(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3.", "a"),
        (2, "Permission is hereby granted, free of charge, to every single person obtaining a copy of this software and associated documentation files", "b"),
        (3, "they are licensed to drive under the public version of general rules", "c"),
        (4, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "d"),
        (4, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "e"),
        (5, "", "f"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert got[1] == ("gpl,gpl-3.0", 1.0) and got[2][0] == "mit-text" and 0.75 <= got[2][1] < 1
    assert got[3] == ("", 0.0) and got[5] == ("", 0.0) and got[4][0] == "cc-by,cc-by-nc-4.0,mit,mit-notice"
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).count() == 6
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
