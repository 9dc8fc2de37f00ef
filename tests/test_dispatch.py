"""Documents by format: grids and text charts are read or counted, mails are parsed once."""

import pytest
from pyspark.sql import functions as F

from awardlake.checks import load
from awardlake.operators import charts, documents, intake

SCHEMA = f"doc_id int, format string, program string, hub string, text string, updated_at string, grids {charts.GRIDS}"
WIDE = [(0, ["from", "to", "economy", "business"], [["North America", "Europe", "30,000", "63,000"], ["Nowhere", "Europe", "1,000", "2,000"]], "")]
NOTHING = [(0, ["name", "value"], [["a", "b"]], "")]
TRIANGLE = "Star Alliance chart\nMexico X 10,000 20,000\nO 30,000 40,000\n"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [
        (1, "pdf", "lifemiles", None, "", "2024-01-01", WIDE), (2, "pdf", "another", None, "", None, NOTHING), (3, "pdf", "lifemiles", None, TRIANGLE, None, []),
        (4, "pdf", "another", None, TRIANGLE, None, None), (5, "pdf", " LifeMiles ", None, "no chart at all", None, None), (6, "pdf", None, None, None, None, None),
        (7, "docx", "x", None, "text", None, None), (8, None, None, None, None, None, None), (9, "html_table", None, None, "<p>no table</p>", None, None),
        (10, "json", None, None, "{}", None, None), (11, "json", None, None, '[{"program":"P","from":"Europe","to":"Africa","cabin":"First","miles":"5 000"}]', None, None),
    ]
    return intake.parse_chart_documents(spark.createDataFrame(rows, SCHEMA))


def test_a_grid_document_of_a_target_gives_rows(parsed):
    got = [(r.program, r.region_a, r.region_b, r.cabin, r.miles, r.updated_at) for r in parsed.rows.where("doc_id = 1").orderBy("miles").collect()]
    assert got == [("lifemiles", "north_america", "europe", "economy", 30000, "2024-01-01"), ("lifemiles", "north_america", "europe", "business", 63000, "2024-01-01")]


def test_documents_with_rows_and_drops_add_up_to_all(parsed):
    kept = {r.doc_id for r in parsed.rows.select("doc_id").distinct().collect()}
    lost = {r.doc_id: r.parser for r in parsed.dropped.collect()}
    assert kept == {1, 3, 11} and kept | set(lost) == set(range(1, 12)) and not kept & set(lost)
    assert {i: lost[i] for i in (2, 4, 5, 6, 7, 8)} == {2: "grid", 4: "text", 5: "text", 6: "empty", 7: "docx", 8: "none"}


def test_every_mail_is_parsed_once(spark, monkeypatch):
    calls, plain = [], documents.parse_mail_documents
    monkeypatch.setattr(documents, "parse_mail_documents", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    found = load()[0]["follow_mail"](spark, "/root/testdata/sf0.001")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert calls == [1] and "part.parquet" not in text
    # what is left reads the documents that were written: neither mails nor their links are read again
    assert "_mail_batch" not in text and "_anchor_batch" not in text and found.where(F.col("miles").isNull()).count() == 0
