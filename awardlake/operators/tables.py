"""HTML pages -> their tables. The only Python step of chart parsing: one Arrow pass per page."""

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from awardlake.functions import markup
from awardlake.functions.batches import by_value
from awardlake.functions.rows import inline_rows
from awardlake.operators import charts

TABLE_TYPE = (
    "struct<table_ord:int,header:array<string>,rows:array<array<string>>,"
    "preceding_text:string,preceding_heading:string>"
)
TABLES_ARROW = pa.list_(pa.struct([
    ("table_ord", pa.int32()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))),
    ("preceding_text", pa.string()), ("preceding_heading", pa.string()),
]))
# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADING = re.compile("h[1-6]$")
CELL = frozenset(("td", "th"))


def _tidy(texts):
    return re.sub(r"\s+", " ", " ".join(texts)).strip()


def _grid(log):
    """Rows of cell texts among the events of one table; inner tables add to the cell and row they stand in."""
    rows, cell = [[]], None
    for kind, tag, value in log:
        if kind == markup.TEXT:
            if cell is not None:
                cell.append(value)
        elif tag in CELL and kind == markup.OPEN:
            cell = []
        elif tag in CELL:
            rows[-1].append("".join(cell or ()).strip())
            cell = None
        elif tag == "tr" and kind == markup.CLOSE:
            rows.append([])
    return [row for row in rows if row]


def _shown(log):
    """Texts outside script and style, blank ones too."""
    inside = 0
    for kind, tag, value in log:
        if kind == markup.TEXT and not inside:
            yield value
        elif tag in markup.UNSEEN:
            inside = max(0, inside + (1 if kind == markup.OPEN else -1))


def _last_heading(log, before):
    """Text of the last heading that ends among these events, or the one before."""
    opened = None
    for at, (kind, tag, _) in enumerate(log):
        if tag is not None and HEADING.match(tag):
            if kind == markup.OPEN:
                opened = at
            elif opened is not None:
                before, opened = _tidy(_shown(log[opened:at])), None
    return before


def _tables_of(html):
    log, found, end, heading = markup.events(html), [], 0, ""
    for start, stop in markup.outermost(log, "table"):
        between = log[end : start - 1]
        heading = _last_heading(between, heading)
        head, *body = _grid(log[start:stop]) or [[]]
        found.append({
            "table_ord": len(found), "header": [c.lower() for c in head], "rows": body,
            "preceding_text": _tidy(_shown(between)), "preceding_heading": heading,
        })
        end = stop + 1
    return found


def _tables_udf(html):
    return by_value(_tables_of, TABLES_ARROW, f"array<{TABLE_TYPE}>")(html)


def with_tables(pages: DataFrame, html_col="html") -> DataFrame:
    """Pages with their tables as one array column ``tables``; pages without ``<table`` skip Python."""
    has = F.contains(F.lower(html_col), F.lit("<table"))
    marked = F.when(has, F.col(html_col))
    return pages.withColumn("tables", F.coalesce(_tables_udf(marked), F.array().cast(f"array<{TABLE_TYPE}>")))


def extract_html_tables(pages: DataFrame, html_col="html", id_col="page_id") -> DataFrame:
    """One row per outermost table of each page."""
    hit = pages.where(F.contains(F.lower(html_col), F.lit("<table"))).select(id_col, html_col)
    return inline_rows(with_tables(hit, html_col), [id_col], F.col("tables"), "table_ord")


def profile_table_shapes(pages: DataFrame, id_col="page_id", first=3) -> DataFrame:
    """Per page with a ``tables`` column: table count, headers, sizes, the ``first`` rows, accepting parsers."""
    t = F.col("tables")
    accepted = lambda test: F.transform(F.filter(t, test), lambda x: x["table_ord"])
    return pages.select(
        id_col,
        F.size(t).alias("tables"),
        F.transform(t, lambda x: F.array_join(x["header"], "|")).alias("headers"),
        F.transform(t, lambda x: F.size(x["rows"])).alias("row_counts"),
        F.transform(t, lambda x: F.slice(x["rows"], 1, first)).alias("first_rows"),
        accepted(charts.is_long).alias("long_tables"),
        accepted(charts.is_wide).alias("wide_tables"),
        accepted(charts.is_destination).alias("destination_tables"),
        accepted(charts.is_zone_matrix).alias("matrix_tables"),
        accepted(charts.is_seasonal).alias("seasonal_tables"),
    )
