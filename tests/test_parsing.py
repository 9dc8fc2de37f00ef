"""Labels, chart shapes, documents and prose claims on hand-written inputs."""

import math

import pytest
from pyspark.sql import functions as F

from awardlake import functions as fn
from awardlake.operators import charts, claims, documents, tables
from awardlake.sources.documents import read_documents


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_regions(spark):
    texts = ["North_America", "us", "australia", "Hawaii (Zone 5)", "Asia 2, Russia 3 (Zone 4)", "Southern South America coast", "", None, "within North America"]
    assert values(spark, texts, fn.canonicalize_region) == [
        "north_america", "north_america", "oceania", "north_america", None, "south_america", None, None, "north_america",
    ]


def test_zone_pairs(spark):
    texts = ["Between North America and Atlantic", "Within North America", "Europe to Europe", "Between Europe and Atlantis", "Japan vs India"]
    got = [tuple(v) if v else None for v in values(spark, texts, fn.canonicalize_zone_pair)]
    assert got == [("north_america", "europe"), ("north_america", "north_america"), None, None, ("north_asia", "south_asia")]


def test_distance_bands(spark):
    texts = ["0–4,000 mi", "6,001+ mi", "over 500", "900", "5000-100", "any"]
    got = [tuple(v) if v else None for v in values(spark, texts, fn.parse_distance_band)]
    assert got == [(0, 4000), (6001, 999999), (500, 999999), (900, 900), (100, 5000), None]


@pytest.mark.parametrize(
    "mode, expected",
    [("digits", [25000, 3500045000, None, 85, None]), ("wide", [25000, 35000, None, 85, None]), ("matrix", [25000, 35000, None, 8500, None])],
)
def test_miles_cells(spark, mode, expected):
    assert values(spark, ["25,000", "35,000-45,000", "—", "8.5", "n/a"], lambda c: fn.parse_miles_cell(c, mode)) == expected


def test_dates(spark):
    texts = ["2024-05-01", "2024-05-01T10:00:00+02:00", "Wed, 1 May 2024 10:00:00 +0200", "2024-05-01T10:00:00", "1 May", None]
    got = values(spark, texts, lambda c: F.unix_seconds(fn.parse_source_date(c)))
    assert got == [1714521600, 1714550400, 1714550400, 1714557600, None, None]


def test_programs(spark):
    texts = ["ANA", "turkish miles&smiles", "Singapore Airlines KrisFlyer", "ana or avianca", "eva", "hilton"]
    assert values(spark, texts, fn.canonicalize_program) == ["ana", "turkish", "krisflyer", "lifemiles", "eva", None]


def test_sql_functions(spark):
    assert "route_key" in fn.register_sql_functions(spark)
    row = spark.sql("SELECT route_key('lax', 'ist', 'business') k, cents_per_point(500L, 0L) z, portal_points_needed(100L, 1.25D) p, great_circle_miles(33.94D, -118.41D, 40.64D, -73.78D) d").first()
    a, b = math.radians(33.94), math.radians(40.64)
    central = math.acos(math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(math.radians(118.41 - 73.78)))
    assert tuple(row)[:3] == ("LAX-IST-business", 0.0, 80) and row["d"] == pytest.approx(3958.7613 * central)


def pages(spark, *html):
    return tables.with_tables(spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string"))


def table(header, *body):
    line = lambda cells, t: "<tr>" + "".join(f"<{t}>{c}</{t}>" for c in cells) + "</tr>"
    return "<table>" + line(header, "th") + "".join(line(r, "td") for r in body) + "</table>"


def test_tables_with_context_and_nesting(spark):
    html = "<p>intro</p><h2>Big  chart</h2><style>x{}</style>" + "<table><tr><td></td></tr><tr><th>A</th><th>B</th></tr><tr><td>1<td>2</td></tr></table>" + "text<table><tr><td>x</td></tr>"
    got = [tuple(r) for r in pages(spark, html, "no table").select("page_id", F.inline("tables")).collect()]
    assert got == [(0, 0, [""], [["A", "B"], ["2"]], "intro Big chart", "Big chart")]


def test_wide_chart_drops_and_counts_unknown_zones(spark):
    docs = pages(spark, table(["Menu"], ["x"]) + table(["From", "To", "Economy", "Business"], ["North America", "Europe", "30,000-40,000", "—"], ["Middle-earth", "Europe", "1", "2"]))
    got = charts.parse_chart_wide(docs.withColumn("program", F.lit("LifeMiles")))
    assert [(r["program"], r["region_b"], r["cabin"], r["miles"]) for r in got.rows.collect()] == [("lifemiles", "europe", "economy", 30000)]
    assert charts.drop_counters(got, "wide").first().asDict() == {"page_id": 0, "kept": 1, "dropped": 1, "parser": "wide"}


def test_destination_table_is_exact_per_airport(spark):
    docs = pages(spark, table(["Destination", "Code", "EconomyPromo", "Business"], ["Los Angeles", "LAX", "50,000", "100,000"], ["Chicago", "ord", "45,000", "–"], ["Home", "IST", "1", "1"], ["Nowhere", "", "9", "9"]))
    got = charts.parse_chart_destination(docs.withColumns({"program": F.lit("turkish"), "hub": F.lit("IST")}))
    assert sorted((r["dest_airport"], r["cabin"], r["miles"]) for r in got.rows.collect()) == [("LAX", "business", 100000), ("LAX", "economy", 50000), ("ORD", "economy", 45000)]
    assert got.dropped.count() == 1


def test_upgrade_matrix_is_rejected(spark):
    grid = table(["", "Zone 1", "Zone 2"], ["Zone 1", "10", "20.5"])
    docs = pages(spark, "<h3>Economy to Business Class</h3>" + grid, "<h3>Economy Class</h3>" + grid).withColumn("program", F.lit("SQ"))
    got = charts.parse_zone_matrix(docs).rows.collect()
    assert [(r["page_id"], r["region_a"], r["region_b"], r["miles"]) for r in got] == [(1, "sq_zone_1", "sq_zone_1", 10000), (1, "sq_zone_1", "sq_zone_2", 20500)]


def test_unsupported_shapes_give_nothing(spark):
    docs = pages(spark, table(["Distance", "Economy", "Business"], ["1-650", "6,000", "9,000"])).withColumns({"program": F.lit("avios"), "hub": F.lit("LHR")})
    for parse in (charts.parse_chart_long, charts.parse_chart_wide, charts.parse_chart_destination, charts.parse_zone_matrix, charts.parse_seasonal_zones):
        assert parse(docs).rows.count() == 0


def test_json_awards(spark):
    text = '{"availability":[{"program":"Turkish","origin":"lax","dest":"ist","cabin":"business","miles":"45,000","seats":2,"updated_at":"2024-05-01"},{"program":"x","miles":0},"junk"]}'
    df = spark.createDataFrame([(1, text), (2, "not json"), (3, None)], "doc_id int, text string")
    got = documents.parse_award_json(df).collect()
    assert [(r["doc_id"], r["program"], r["origin"], r["miles"], r["seats"]) for r in got] == [(1, "turkish", "LAX", 45000, 2)]


def test_mail_prefers_html_and_skips_attachments(spark):
    raw = (
        b"From: News <Deals" + b"\x40" + b"Ex.org>\r\nSubject: Hi\r\nDate: Wed, 01 May 2024 10:00:00 +0200\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n"
        b"--b\r\nContent-Type: text/html\r\nContent-Disposition: attachment\r\n\r\n<p>no</p>\r\n--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>yes</p>\r\n--b--\r\n"
    )
    row = documents.parse_mail_documents(spark.createDataFrame([(1, bytearray(raw))], "doc_id int, raw binary")).first()
    assert row["source_name"].endswith("ex.org") and row["body"].strip() == "<p>yes</p>" and row["received_at"] == "2024-05-01T08:00:00+00:00"


def test_read_documents_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.JSON").write_bytes("café".encode("utf-8"))
    got = {r["content_type"]: r["text"] for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"text/html": "café", "application/json": "café"}


def claim_rows(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = claims.extract_price_claims(df, **options).orderBy("claim_ord").collect()
    return [(r["program"], r["region_a"], r["region_b"], r["cabin"], r["miles"], r["roundtrip"]) for r in got]


def test_claims_in_prose(spark):
    text = (
        "<p>Earn a welcome offer of 75,000 points.</p><p>Turkish Miles&amp;Smiles business class from the US to\n Europe for just 45,000 miles one way.</p>"
        "<p>The clause of a price ends sixty characters behind its number, so this line keeps the next offer out.</p>"
        "<p>KrisFlyer first to Southeast Asia: 140 000 points round trip.</p>"
    )
    assert claim_rows(spark, text) == [
        ("turkish", "north_america", "europe", "business", 45000, False), ("krisflyer", "north_america", "southeast_asia", "first", 140000, True),
    ]


def test_claims_need_every_signal_and_fall_back_to_bare_numbers(spark):
    assert claim_rows(spark, "Aeroplan business to Japan, priced at 75,000.") == [("aeroplan", "north_america", "north_asia", "business", 75000, False)]
    assert claim_rows(spark, "Aeroplan to Japan for 75,000 miles") == []
    assert claim_rows(spark, "business to Japan for 75,000 miles, says Aeroplan") == []


def test_claim_word_boundary_option(spark):
    text = "Canada to Japan in business for 60,000 miles"
    assert claim_rows(spark, text) == [("ana", "north_america", "north_asia", "business", 60000, False)]
    assert claim_rows(spark, text, word_boundary=True) == []


def test_long_text_is_read_to_its_end(spark):
    text = "filler words " * 20000 + "LifeMiles economy to Brazil for 25,000 miles. " * 1
    assert claim_rows(spark, text) == [("lifemiles", "north_america", "south_america", "economy", 25000, False)]


def test_number_heavy_document(spark):
    text = "LifeMiles economy to Brazil: " + " ".join(f"{n:,} miles" for n in range(10000, 12000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert claims.find_price_mentions(df).count() == 2000


def test_markup_is_read_to_its_end(spark):
    from awardlake.functions import markup

    pages = ["<p>Hello</p> tail text 45,000 miles AT&T", "<p>open <b>tag &x", "<style>a{}</style>x<script>if (a<b) y()</script> z", None, "plain"]
    assert values(spark, pages, documents.html_to_text) == ["Hello  tail text 45,000 miles AT&T", "open  tag &x", "x  z", None, "plain"]
    assert list(markup.attribute(markup.events("<a href=' u '>x</a><a>y</a><a href=z"), "a", "href")) == ["u"]
    found = tables._tables_of("<h2>One <i>two</i></h2><table><tr><th>A</th></tr><tr><td>1<table><tr><td>in</td></tr></table></td></tr></table>rest<table><tr><td>2</td></tr></table>")
    assert [(t["header"], t["preceding_heading"]) for t in found] == [(["a"], "One two"), (["2"], "One two")]
    assert found[1]["preceding_text"] == "rest"


def test_no_silent_limits(spark):
    entries = spark.createDataFrame([("f", f"u{i}", i) for i in range(30)], "feed string, url string, entry_ord int")
    seen = spark.createDataFrame([("f", "u0", "2024-01-01")], "feed string, url string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    assert claims.new_items_only(entries, seen, "2024-01-02").count() == 29
    assert [r.url for r in claims.new_items_only(entries, seen, "2024-01-02", limit=1).collect()] == ["u1"]
    text = "a" * 3000 + "\x01" * 3000
    assert values(spark, [text, text[:3000]], fn.looks_undecoded) == [True, False]


def test_registered_text_queries_read_documents_with_markup(spark, tmp_path):
    from awardlake.checks import load

    texts = {1: "<p>fly for 45,000 miles</p> rest &amp; end", 2: "a < b and c > d for 52,000 points", 3: "plain 61,000 miles", 4: None, 5: "<script>var x = '71,000 miles'</script>x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(20).write.parquet(f"{tmp_path}/part.parquet")
    queries = load()[0]
    got = {r.doc_id: r.text and " ".join(r.text.split()) for r in queries["html_to_text"](spark, str(tmp_path)).collect() if r.doc_id in texts}
    assert got == {1: "fly for 45,000 miles rest & end", 2: "a < b and c > d for 52,000 points", 3: "plain 61,000 miles", 4: None, 5: "x"}
    found = [tuple(r) for r in queries["find_price_mentions"](spark, str(tmp_path)).collect() if r.doc_id >= 1_000_000]
    assert sorted(found) == [(1000001, 45000), (1000002, 52000), (1000003, 61000)]


def test_whole_text_of_pages_by_brute_force(spark):
    import html
    import re

    def plain(page):
        page = re.sub(r"<!--.*?-->", " ", re.sub(r"<(script|style)\b.*?</\1>", " ", page, flags=re.S), flags=re.S)
        return html.unescape(re.sub(r"</?[a-zA-Z!][^>]*>", " ", page)).split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", documents.html_to_text(F.col("html")).alias("text")).collect()
    assert len(rows) == 50 and all(r.text.split() == plain(r.html) for r in rows)


@pytest.mark.parametrize("name, module, operator, at", [("read_stale_programs", "catalogue", "read_discovered_rows", 0), ("check_targets_resolved_charts", "resolve", "resolve_award_miles", 1)])
def test_registered_queries_read_every_part(spark, monkeypatch, name, module, operator, at):
    from awardlake.checks import load, quality_checks, source_checks

    queries, read = load()[0], []
    owner = getattr(source_checks if module == "catalogue" else quality_checks, module)
    inner = getattr(owner, operator)
    monkeypatch.setattr(owner, operator, lambda *a, **b: (read.append(a[at].count()), inner(*a, **b))[1])
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
    assert read == [spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()]
