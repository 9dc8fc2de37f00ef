"""Price mentions: positions and windows against plain Python; time that grows with the text."""

import random
import re
import time

from pyspark.sql import functions as F

from awardlake import vocab
from awardlake.operators import claims


def plain_mentions(text):
    """(position, miles) as one scan of the pattern finds them."""
    for pattern in (claims.NEAR_KEYWORD, claims.ANY_NUMBER):
        found = [(m.start(), int(re.sub(r"\D", "", m.group(1)))) for m in re.finditer(pattern, text)]
        found = [(p, v) for p, v in found if vocab.MIN_PROSE_MILES <= v <= vocab.MAX_PROSE_MILES]
        if found:
            return found
    return []


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["45,000 miles", "1,234", "99999", "12 345 pts", "7000points", "1,000,000", "4000", "é€😀", "word", "x" * 90, "from home to Tokyo", ".", "123456789"]
    for _ in range(n):
        yield re.sub(r"\s+", " ", rng.choice([" ", "", ", "]).join(rng.choices(parts, k=rng.choice([1, 5, 40, 300])))).strip()


def test_positions_of_any_text(spark):
    rows = list(enumerate(texts(120)))
    got = {}
    for r in claims.find_price_mentions(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.miles))
    for i, text in rows:
        assert sorted(got.get(i, [])) == plain_mentions(text), text


def test_windows_reach_as_far_as_they_should(spark):
    rows = list(enumerate(texts(60, seed=2)))
    df = claims._cut(spark.createDataFrame(rows, "doc_id int, text string"), "text", "doc_id")
    for r in claims._windows(df, "doc_id").collect():
        text = rows[r.doc_id][1]
        want = [(text[max(p - claims.BEFORE, 0) : p], text[p : p + claims.TAIL], v) for p, v in plain_mentions(text)]
        assert [(w.before, w.tail, w.miles) for w in r.around] == want


def test_time_grows_with_the_text(spark):
    def seconds(n, run):
        text = " ".join(f"{10000 + i % 80000} miles" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        start = time.perf_counter()
        assert run(df).count() >= 0
        return time.perf_counter() - start

    for run in (claims.find_price_mentions, claims.extract_price_claims):
        seconds(1000, run)
        assert seconds(100_000, run) < 20  # the windows of a scan from the start would take minutes
