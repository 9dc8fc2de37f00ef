"""Grids of many rows: labels filled down in time that grows with the rows."""

import time

import pytest

from awardlake.operators import charts

GRID = "array<struct<table_ord:int,header:array<string>,rows:array<array<string>>,preceding_heading:string,preceding_text:string,page_text:string>>"


def docs(spark, header, rows, page, program):
    return spark.createDataFrame([(1, program, [(0, header, rows, "", "", page)], page)], f"doc_id int, program string, grids {GRID}, page_text string")


def timed(df):
    start = time.perf_counter()
    n = df.count()
    return n, time.perf_counter() - start


@pytest.mark.parametrize("n", [1000, 50_000])
def test_distance_bands_are_filled_down(spark, n):
    rows = [[f"{i * 100} - {i * 100 + 99}" if i % 5 == 0 else "", "All other partners", f"Starting at {i % 90 + 1},000 pts"] for i in range(n)]
    page = "chart\nBetween North America and Atlantic zones\nprices"
    got = charts.parse_distance_grid(docs(spark, ["distance (miles)", "operated by", "economy"], rows, page, "ac"))
    count, seconds = timed(got.rows.where(f"distance_min = (band_ord >> 16 & {(1 << 28) - 1}) div 5 * 500"))
    assert count == n and seconds < 15


@pytest.mark.parametrize("n", [1000, 50_000])
def test_blocks_are_filled_down(spark, n):
    rows = [[str(i // 4 % 9 + 1) if i % 4 == 0 else "", f"{i % 50 + 1}.5", "7"] for i in range(n)]
    got = charts.parse_matrix_blocks(docs(spark, ["zone", "1", "2"], rows, "saver award chart", "sq"))
    count, seconds = timed(got.rows.where("region_a = concat('sq_zone_', cast((band_ord >> 16 & 268435455) div 4 % 9 + 1 AS string))"))
    assert count == 2 * n and seconds < 15


def test_rows_before_the_first_band_are_dropped(spark):
    rows = [["", "All other partners", "5,000 pts"], ["1 - 99", "All other partners", "6,000 pts"], ["", "All other partners", "7,000 pts"]]
    page = "chart\nBetween North America and Atlantic zones\nprices"
    got = charts.parse_distance_grid(docs(spark, ["distance (miles)", "operated by", "economy"], rows, page, "ac"))
    assert sorted(r.miles for r in got.rows.collect()) == [6000, 7000] and got.dropped.count() == 1
