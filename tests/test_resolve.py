"""Places and prices: search against plain Python, and plans that read every input once."""

import random
import re

from awardlake.checks import load
from awardlake.operators import resolve

SF = "/root/testdata/sf0.001"


def plain_score(q, code, city, name):
    code, city, name = code.upper(), (city or "").upper(), (name or "").upper()
    if code == q:
        return 1000
    if code.startswith(q):
        return 900 - (len(code) - len(q))
    return 800 if city.startswith(q) else 700 if q in city else 600 if q in name else None


def plain_search(queries, places, k):
    out = set()
    for q in {x.strip().upper() for x in queries} - {""}:
        best = {}
        for code, city, name in places:
            score = plain_score(q, code, city, name)
            if score is not None:
                best[code] = max(best.get(code, 0), score)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, code, score, rank) for rank, (code, score) in enumerate(ranked, 1)}
    return out


def test_place_search_and_its_stored_index(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcd é", k=n))
    places = [(word(3) + str(i % 40), rng.choice([None, word(5)]), rng.choice([None, word(9)])) for i in range(300)]
    queries = [word(rng.randint(1, 5)) for _ in range(200)] + ["", " ", "a", "b ", "zz"]
    frame = spark.createDataFrame(places, "code string, city string, name string")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    for k in (1, 4):
        want = plain_search(queries, places, k)
        assert {tuple(r) for r in resolve.place_search(asked, frame, k).collect()} == want
        index = resolve.place_index(frame, 4).cache()
        assert index.groupBy("piece").count().agg({"count": "max"}).first()[0] <= 4
        assert {tuple(r) for r in resolve.place_search(asked, frame, k, index).collect()} == want


def test_each_task_keeps_the_first_places_only(spark):
    frame = spark.createDataFrame([("abc", "x", "y")], "code string, city string, name string")
    text = resolve.place_index(frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def count(text, word):
    return len(re.findall(rf"(?<![A-Za-z]){word}", text))


def test_price_resolution_reads_every_input_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reused exchanges show in the plan
    try:
        text = load()[0]["resolve_award_miles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    text = text.split("Subqueries")[0]
    # orders, part, suppliers, suppliers twice for the union that makes the zones, and their count for the routes
    assert count(text, "FileScan") <= 6 and count(text, "Exchange hashpartitioning") <= 6


def test_bands_of_any_width_answer(spark):
    """A band over the whole globe, one of a single mile, one turned round, one beyond the globe."""
    bands = [("p", "s", None, None, "reg", "reg", "first", 10_000 + i, False, lo, hi, i) for i, (lo, hi) in enumerate([(3000, 1), (0, 999_999), (99_999, 999_999), (0, 0)])]
    schema = (
        "program string, source_name string, origin_airport string, dest_airport string, region_a string, region_b string, cabin string, "
        "miles long, roundtrip boolean, distance_min long, distance_max long, band_ord long"
    )
    airports = spark.createDataFrame([("A", "reg", 0.0, 0.0), ("B", "reg", 0.0, 180.0), ("C", "reg", 0.0, 0.0)], "code string, region string, lat double, lon double")
    routes = spark.createDataFrame([("far", "A", "B", "first"), ("none", "A", "C", "first")], "route_key string, origin string, dest string, cabin string")
    zones = spark.createDataFrame([], "program string, code string, zone int")
    got = resolve.resolve_award_miles(routes, spark.createDataFrame(bands, schema), airports, zones).collect()
    assert {r.route_key: (r.miles, r.how) for r in got} == {"far": (10_001, "distance"), "none": (10_001, "distance")}
