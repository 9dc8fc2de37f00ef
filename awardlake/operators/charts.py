"""Tables -> chart rows, as column expressions over a page's ``tables`` array.

Each ``*_rows`` builder maps one page row to an array of price structs. Nothing here shuffles: a
page is parsed where it was read. A table row whose geography is not known gives one struct with
``dropped`` true, so drops are counted in the same pass; cells that match no selector give nothing.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions import labels
from awardlake.functions.rows import inline_rows
from awardlake.sources.sinks import materialize

ROW_TYPE = (
    "struct<band_ord:bigint,program:string,region_a:string,region_b:string,cabin:string,miles:bigint,"
    "roundtrip:boolean,distance_min:bigint,distance_max:bigint,origin_airport:string,"
    "dest_airport:string,dropped:boolean>"
)
#: Tables of a document without markup.
GRIDS = "array<struct<table_ord:int,header:array<string>,rows:array<array<string>>,page_text:string>>"
NO_ROWS = f"cast(array() as array<{ROW_TYPE}>)"
LONG_TITLES = ("program", "from", "to", "cabin", "miles")


class ParsedCharts(NamedTuple):
    """Chart rows, and one row per dropped table row (doc_id, parser)."""

    rows: DataFrame
    dropped: DataFrame


def _lower(header):
    return F.transform(header, lambda h: F.lower(F.trim(h)))


def _has(header, *names):
    return F.arrays_overlap(header, F.array(*[F.lit(n) for n in names]))


def _last(header, name):
    """1-based position of the last column with this title, NULL when there is none."""
    back = F.array_position(F.reverse(header), name)
    return F.when(back > 0, (F.size(header) - back + 1).cast("int"))


def _first(header, name):
    pos = F.array_position(header, name)
    return F.when(pos > 0, pos.cast("int"))


def _cell(cells, pos):
    return F.trim(F.try_element_at(cells, pos))


def _titles(header, mode, last=False):
    """(position, cabin) of every cabin column, in header order."""
    cols = F.transform(
        header,
        lambda h, i: F.struct(
            (_last(header, h) if last else i + 1).cast("int").alias("pos"),
            labels.cabin_of(h, mode).alias("cabin"),
        ),
    )
    return F.filter(cols, lambda c: c["cabin"].isNotNull())


def _ord(table_ord, row_ord, cell_ord):
    """Place of a cell: 16 bits for the cell, 28 for the row, the rest for the table."""
    return F.shiftleft(table_ord.cast("bigint"), 44) + F.shiftleft(row_ord.cast("bigint"), 16) + cell_ord


def _price(band_ord, program, cabin, miles, a=None, b=None, roundtrip=None, lo=None, hi=None, origin=None, dest=None, dropped=None):
    text, num = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    pick = lambda v, none: none if v is None else v
    return F.struct(
        band_ord.cast("bigint").alias("band_ord"), program.alias("program"),
        pick(a, text).alias("region_a"), pick(b, text).alias("region_b"), cabin.alias("cabin"),
        miles.cast("bigint").alias("miles"), pick(roundtrip, F.lit(False)).alias("roundtrip"),
        pick(lo, num).cast("bigint").alias("distance_min"), pick(hi, num).cast("bigint").alias("distance_max"),
        pick(origin, text).alias("origin_airport"), pick(dest, text).alias("dest_airport"),
        pick(dropped, F.lit(False)).alias("dropped"),
    )


def _drop(band_ord, program):
    none = F.lit(None)
    return F.array(_price(band_ord, program, none.cast("string"), none, dropped=F.lit(True)))


def _rows(*arrays):
    return [a.cast(f"array<{ROW_TYPE}>") for a in arrays]


def _none():
    return F.expr(NO_ROWS)


def _with(items, keep, **fields):
    """Structs with the ``keep`` fields plus computed ones, so later lambdas read and not recompute."""
    return F.transform(
        items,
        lambda t: F.struct(*[t[n].alias(n) for n in keep], *[fn(t).alias(k) for k, fn in fields.items()]),
    )


def _under_marks(body, marks, place):
    """``place(row, index, mark)`` of every row with the last mark at or before it; rows before the first have a null one.

    ``marks`` hold the index ``i`` of their row. The rows are cut at the marks, so each is looked at once.
    """
    size, none = F.size(body), F.get(marks, F.lit(-1))
    head = F.slice(body, F.lit(1), F.coalesce(F.get(marks, F.lit(0))["i"], size))

    def stretch(m, j):
        end = F.coalesce(F.get(marks, j + 1)["i"], size)
        return F.transform(F.slice(body, m["i"] + 1, end - m["i"]), lambda r, k: place(r, m["i"] + k, m))

    return F.concat(F.transform(head, lambda r, k: place(r, k, none)), F.flatten(F.transform(marks, stretch)))


# --- which tables a parser accepts -------------------------------------------------------------


def is_long(t):
    """Header holds all of program, from, to, cabin, miles."""
    return F.size(F.array_except(F.array(*[F.lit(n) for n in LONG_TITLES]), t["header"])) == 0


def is_wide(t):
    """From, to or distance, and at least one cabin column."""
    h = _lower(t["header"])
    return _has(h, "from") & _has(h, "to", "distance") & F.exists(h, lambda x: labels.cabin_of(x, "wide").isNotNull())


def is_destination(t):
    """One destination per row: no from column, a place column and a cabin column."""
    h = _lower(t["header"])
    return (
        ~_has(h, "from") & _has(h, "code", "destination", "airport")
        & F.exists(h, lambda x: labels.cabin_of(x, "destination").isNotNull())
    )


def _axis(header):
    return F.transform(F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(0))), labels.zone_key)


def _numeric(keys):
    return F.forall(keys, lambda k: F.coalesce(k.rlike(r"^\d+$"), F.lit(False)))


def is_numeric_matrix(t):
    return _numeric(_axis(t["header"]))


def matrix_shape(t, keys, row_keys):
    """Whether a grid with these column and row keys is a zone x zone matrix."""
    h = _lower(t["header"])
    labelled = F.size(F.array_compact(row_keys))
    return (
        (F.size(t["header"]) >= 3) & ~_has(h, "from", "to", "distance") & ~is_destination(t)
        & F.forall(keys, lambda k: k.isNotNull())
        & F.when(_numeric(keys), F.size(t["rows"]) >= 1).otherwise(labelled >= 2)
    )


def _row_keys(t):
    return F.transform(t["rows"], lambda r: labels.zone_key(F.try_element_at(r, F.lit(1))))


def is_zone_matrix(t):
    """Every column title after the first is a zone, and so are the row labels."""
    return matrix_shape(t, _axis(t["header"]), _row_keys(t))


def is_seasonal(t):
    h = _lower(t["header"])
    return F.coalesce(F.try_element_at(h, F.lit(1)) == "season", F.lit(False)) & F.exists(
        h, lambda x: labels.cabin_of(x, "season").isNotNull()
    )


def _zone_title_columns(t):
    h = _lower(t["header"])
    return _has(h, "zone name") & _has(h, "zone number")


# --- one builder per table shape ---------------------------------------------------------------


def long_rows(tables):
    """All long tables: one price per row."""
    titles = {f"c_{n}": (lambda t, n=n: _last(t["header"], n)) for n in (*LONG_TITLES, "roundtrip")}
    first = _with(F.filter(tables, is_long), ["table_ord", "rows"], **titles)

    def of_table(t):
        def of_row(cells, i):
            cell = lambda n: _cell(cells, t[f"c_{n}"])
            return F.struct(
                _ord(t["table_ord"], i, 0).alias("o"), F.size(cells).alias("n"), F.lower(cell("program")).alias("program"),
                labels.canonicalize_region(cell("from")).alias("a"), labels.canonicalize_region(cell("to")).alias("b"),
                F.lower(cell("cabin")).alias("cabin"), labels.parse_miles_cell(cell("miles"), "digits").alias("miles"),
                labels.to_bool_token(cell("roundtrip")).alias("rt"),
            )

        kept = F.filter(
            F.transform(t["rows"], of_row),
            lambda r: (r["n"] >= len(LONG_TITLES)) & r["miles"].isNotNull() & r["cabin"].isin(*vocab.CABINS),
        )
        return F.transform(
            kept,
            lambda r: _price(
                r["o"], r["program"], r["cabin"], r["miles"], r["a"], r["b"], r["rt"],
                dropped=r["a"].isNull() | r["b"].isNull(),
            ),
        )

    return F.flatten(F.transform(first, of_table))


def _price_cells(r, cabins, program, mode, **fields):
    """One struct per readable cabin cell of a row."""
    cells = F.transform(
        cabins,
        lambda c, j: _price(
            r["o"] + j, program, c["cabin"], labels.parse_miles_cell(F.try_element_at(r["cells"], c["pos"]), mode), **fields
        ),
    )
    return F.filter(cells, lambda p: p["miles"].isNotNull())


def wide_rows(tables, program):
    """All wide tables: zone pair (from/to) or zone pair and mile band (from/distance) per row."""
    prog = F.lower(F.trim(program))

    first = _with(
        _with(F.filter(tables, is_wide), ["table_ord", "rows"], h=lambda t: _lower(t["header"])),
        ["table_ord", "rows"],
        cabins=lambda t: _titles(t["h"], "wide", last=True), banded=lambda t: ~_has(t["h"], "to"),
        from_pos=lambda t: _last(t["h"], "from"),
        zone_pos=lambda t: F.coalesce(_last(t["h"], "to"), _last(t["h"], "distance")),
    )

    def of_table(t):
        cabins, banded = t["cabins"], t["banded"]

        def of_row(cells, i):
            a, b = _cell(cells, t["from_pos"]), _cell(cells, t["zone_pos"])
            return F.struct(
                _ord(t["table_ord"], i, 0).alias("o"), cells.alias("cells"), a.alias("ta"), b.alias("tb"),
                F.when(banded, labels.canonicalize_zone_pair(a)).otherwise(
                    F.struct(labels.canonicalize_region(a).alias("a"), labels.canonicalize_region(b).alias("b"))
                ).alias("pair"),
                F.when(banded, labels.parse_distance_band(b)).alias("band"),
            )

        rows = F.filter(F.transform(t["rows"], of_row), lambda r: (r["ta"] != "") & (r["tb"] != ""))

        def prices(r):
            unknown = r["pair"]["a"].isNull() | r["pair"]["b"].isNull() | (banded & r["band"].isNull())
            hit = _price_cells(
                r, cabins, prog, "wide", a=r["pair"]["a"], b=r["pair"]["b"], lo=r["band"]["lo"], hi=r["band"]["hi"]
            )
            return F.when(unknown, *_rows(_drop(r["o"], prog))).otherwise(*_rows(hit))

        return F.flatten(F.transform(rows, prices))

    return F.flatten(F.transform(first, of_table))


def destination_rows(tables, program, hub):
    """Every destination table of a hub: exact airport pairs."""
    prog, home = F.lower(F.trim(program)), F.upper(F.trim(hub))
    code_shape = "^[A-Z]{3}$"

    guides = _with(
        _with(F.filter(tables, is_destination), ["table_ord", "rows"], h=lambda t: _lower(t["header"])),
        ["table_ord", "rows"],
        cabins=lambda t: _titles(t["h"], "destination"),
        code_pos=lambda t: F.coalesce(_last(t["h"], "code"), _last(t["h"], "airport")),
    )

    def of_table(t):
        cabins, code_pos = t["cabins"], t["code_pos"]

        def of_row(cells, i):
            shaped = F.filter(F.transform(cells, lambda c: F.upper(F.trim(c))), lambda c: c.rlike(code_shape))
            named = F.upper(_cell(cells, code_pos))
            return F.struct(
                _ord(t["table_ord"], i, 0).alias("o"), cells.alias("cells"),
                F.when(named.rlike(code_shape), named).otherwise(F.try_element_at(shaped, F.lit(1))).alias("code"),
            )

        def prices(r):
            hit = _price_cells(r, cabins, prog, "wide", origin=home, dest=r["code"])
            return (
                F.when(r["code"].isNull(), *_rows(_drop(r["o"], prog)))
                .when(r["code"] == home, _none()).otherwise(*_rows(hit))
            )

        return F.flatten(F.transform(F.transform(t["rows"], of_row), prices))

    found = F.flatten(F.transform(guides, of_table))
    return F.when(F.coalesce(home.rlike(code_shape), F.lit(False)), found).otherwise(_none())


def _zone_token(program, key):
    return F.when(key.rlike(r"^\d+$"), F.concat(program, F.lit("_zone_"), key)).otherwise(key)


def _matrices(tables, keep, cabin, block):
    """Zone matrices with their column keys, keyed body rows, cabin and block of cabins."""
    keyed = _with(
        tables, [*keep, "table_ord", "header", "rows"],
        keys=lambda t: _axis(t["header"]), row_keys=_row_keys,
    )
    grids = F.filter(keyed, lambda t: matrix_shape(t, t["keys"], t["row_keys"]))
    body = lambda t: F.filter(
        F.transform(
            t["rows"],
            lambda cells, i: F.struct(
                cells.alias("cells"), F.when(F.trim(cells[0]) != "", F.get(t["row_keys"], i)).alias("key")
            ),
        ),
        lambda r: F.size(r["cells"]) >= 2,
    )
    made = _with(grids, ["table_ord", "keys"], body=body, cabin=cabin, block=block)
    marks = lambda t: F.filter(
        F.transform(t["body"], lambda r, i: F.struct(i.alias("i"), r["key"].alias("key"))), lambda m: m["key"].isNotNull()
    )
    return _with(made, ["table_ord", "keys", "body", "cabin", "block"], marks=marks)


def _matrix_prices(t, program):
    """Unpivot one matrix: every row its own zone, or blocks of cabin rows under one label."""
    several = F.size(t["block"]) > 1
    placed = _under_marks(
        t["body"], t["marks"],
        lambda r, i, mark: F.struct(i.alias("i"), r["cells"].alias("cells"), r["key"].alias("key"), mark.alias("mark")),
    )
    rows = F.transform(
        placed,
        lambda r: F.struct(
            _ord(t["table_ord"], r["i"], 0).alias("o"), r["cells"].alias("cells"),
            _zone_token(program, F.when(several, r["mark"]["key"]).otherwise(r["key"])).alias("origin"),
            F.when(several, F.try_element_at(t["block"], (r["i"] - r["mark"]["i"] + 1).cast("int")))
            .otherwise(t["cabin"]).alias("cabin"),
        ),
    )

    def prices(r):
        hit = F.transform(
            t["keys"],
            lambda k, j: _price(
                r["o"] + j, program, r["cabin"],
                labels.parse_miles_cell(F.try_element_at(r["cells"], (j + 2).cast("int")), "matrix"),
                r["origin"], _zone_token(program, k),
            ),
        )
        return F.when(r["origin"].isNull(), *_rows(_drop(r["o"], program))).otherwise(
            *_rows(F.filter(hit, lambda p: p["miles"].isNotNull() & p["cabin"].isNotNull()))
        )

    return F.flatten(F.transform(rows, prices))


def zone_matrix_rows(tables, program):
    """Matrices under an exact cabin heading."""
    prog = F.lower(F.trim(program))
    headed = F.filter(
        _with(
            tables, ["table_ord", "header", "rows"],
            heading_cabin=lambda t: labels.cabin_of(t["preceding_heading"], "heading"),
        ),
        lambda t: t["heading_cabin"].isNotNull(),
    )
    found = _matrices(headed, ["heading_cabin"], lambda t: t["heading_cabin"], lambda t: F.expr("cast(array() as array<string>)"))
    return F.flatten(F.transform(found, lambda t: _matrix_prices(t, prog)))


def matrix_block_rows(grids, program):
    """Matrices of a document: blocks of cabin rows when the page names its fare kind, else one cabin."""
    prog = F.lower(F.trim(program))
    cabins = lambda *names: F.array(*[F.lit(n) for n in names])

    def block(t):
        page, numeric = F.lower(t["page_text"]), _numeric(t["keys"])
        return (
            F.when(numeric & F.contains(page, F.lit("saver award")), cabins(*vocab.CABINS))
            .when(numeric & F.contains(page, F.lit("advantage award")), cabins("economy", "business", "first"))
            .otherwise(F.expr("cast(array() as array<string>)"))
        )

    def cabin(t):
        return labels.cabin_of(F.concat_ws(" ", t["page_text"], F.array_join(t["header"], " ")), "page")

    found = F.filter(
        _matrices(grids, ["page_text"], cabin, block), lambda t: (F.size(t["block"]) > 0) | t["cabin"].isNotNull()
    )
    return F.flatten(F.transform(found, lambda t: _matrix_prices(t, prog)))


def seasonal_rows(tables, program):
    """Low-season round-trip prices between two zones that a legend table names."""
    prog = F.lower(F.trim(program))
    zone_shape = vocab.ZONE_SHAPE

    def legend_of(t):
        h = _lower(t["header"])
        name_at, num_at = _first(h, "zone name"), _first(h, "zone number")
        entries = F.transform(
            t["rows"],
            lambda r: F.struct(
                F.regexp_extract(F.coalesce(F.try_element_at(r, num_at), F.lit("")), zone_shape, 1).try_cast("int").alias("zone"),
                labels.canonicalize_region(F.try_element_at(r, name_at)).alias("region"),
            ),
        )
        return F.filter(entries, lambda e: e["zone"].isNotNull() & e["region"].isNotNull())

    legend = F.flatten(F.transform(F.filter(tables, _zone_title_columns), legend_of))
    seasons = _with(
        F.filter(tables, is_seasonal), ["table_ord", "rows"],
        cabins=lambda t: _titles(_lower(t["header"]), "season"),
        nums=lambda t: F.regexp_extract_all(t["preceding_text"], F.lit(zone_shape), F.lit(1)),
    )

    def of_table(t, known):
        cabins, nums = t["cabins"], t["nums"]
        at = lambda i: F.when(F.size(nums) >= 2, F.try_element_at(nums, F.lit(i))).try_cast("int")
        region = lambda n: F.try_element_at(F.filter(known, lambda e: e["zone"] == n), F.lit(1))["region"]
        pair = F.struct(region(at(-2)).alias("a"), region(at(-1)).alias("b"))
        o = _ord(t["table_ord"], F.lit(0), 0)

        def low(p):
            rows = F.filter(
                F.transform(t["rows"], lambda cells, i: F.struct(_ord(t["table_ord"], i, 0).alias("o"), cells.alias("cells"))),
                lambda r: F.contains(F.lower(F.try_element_at(r["cells"], F.lit(1))), F.lit("low")),
            )
            return F.flatten(
                F.transform(rows, lambda r: _price_cells(r, cabins, prog, "wide", a=p["a"], b=p["b"], roundtrip=F.lit(True)))
            )

        return F.flatten(
            F.transform(
                F.array(pair),
                lambda p: F.when(p["a"].isNull() | p["b"].isNull(), *_rows(_drop(o, prog))).otherwise(*_rows(low(p))),
            )
        )

    return F.flatten(
        F.transform(
            F.filter(F.array(legend), lambda known: F.size(known) > 0),
            lambda known: F.flatten(F.transform(seasons, lambda t: of_table(t, known))),
        )
    )


def _distance_titles(header):
    """(first position, cabin) of the price columns of a distance grid."""
    def cabin(h):
        return F.when(F.contains(h, F.lit("premium")) & F.contains(h, F.lit("economy")), "premium_economy").when(
            h.isin("economy", "business", "first"), h
        )

    cols = F.transform(_lower(header), lambda h, i: F.struct((i + 1).cast("int").alias("pos"), cabin(h).alias("cabin")))
    return F.filter(
        cols,
        lambda c: c["cabin"].isNotNull()
        & ~F.exists(cols, lambda x: x["cabin"].eqNullSafe(c["cabin"]) & (x["pos"] < c["pos"])),
    )


def is_distance_grid(t):
    text = F.array_join(t["header"], " ")
    return F.contains(text, F.lit("distance")) & F.contains(text, F.lit("operated")) & (F.size(_distance_titles(t["header"])) > 0)


def distance_grid_rows(grids, program):
    """Distance-band grids: band cells filled down, only the rows for all other partners."""
    prog = F.lower(F.trim(program))

    found = _with(
        F.filter(grids, is_distance_grid), ["table_ord", "rows"],
        cabins=lambda t: _distance_titles(t["header"]),
        op_pos=lambda t: F.array_position(
            F.transform(t["header"], lambda h: F.contains(h, F.lit("operated"))), F.lit(True)
        ).cast("int"),
        pair=lambda t: labels.canonicalize_zone_pair(F.trim(F.regexp_extract(t["page_text"], vocab.PAGE_PAIR, 1))),
    )
    found = _with(
        F.filter(found, lambda t: t["pair"].isNotNull()), ["table_ord", "cabins", "op_pos", "pair"],
        body=lambda t: F.transform(
            F.filter(t["rows"], lambda r: F.size(r) >= t["op_pos"]),
            lambda cells, i: F.struct(i.alias("i"), cells.alias("cells"), labels.parse_distance_band(cells[0]).alias("band")),
        ),
    )
    found = _with(
        found, ["table_ord", "cabins", "op_pos", "pair", "body"],
        marks=lambda t: F.filter(t["body"], lambda r: r["band"].isNotNull()),
    )

    def of_table(t):
        cabins, op_pos, body, marks = t["cabins"], t["op_pos"], t["body"], t["marks"]
        partner = F.filter(
            _under_marks(
                body, marks,
                lambda r, i, mark: F.struct(
                    _ord(t["table_ord"], i, 0).alias("o"), r["cells"].alias("cells"), mark["band"].alias("band"),
                ),
            ),
            lambda r: F.contains(F.lower(F.try_element_at(r["cells"], op_pos)), F.lit("all other partners")),
        )
        clean = F.transform(
            partner,
            lambda r: F.struct(
                r["o"].alias("o"), r["band"].alias("band"),
                F.transform(r["cells"], lambda c: F.when(~F.contains(F.lower(c), F.lit("median")), c)).alias("cells"),
            ),
        )

        return F.flatten(
            F.transform(
                clean,
                lambda r: F.when(r["band"].isNull(), *_rows(_drop(r["o"], prog))).otherwise(
                    *_rows(_price_cells(r, cabins, prog, "digits", a=t["pair"]["a"], b=t["pair"]["b"], lo=r["band"]["lo"], hi=r["band"]["hi"]))
                ),
            )
        )

    return F.flatten(F.transform(found, of_table))


# --- DataFrame operators -----------------------------------------------------------------------


def emit(docs: DataFrame, rows, parser, id_col) -> ParsedCharts:
    """Rows and drops of a builder's array over ``docs``."""
    meta = [c for c in ("source_name", "updated_at") if c in docs.columns]
    flat = inline_rows(docs, [id_col, *meta], rows.cast(f"array<{ROW_TYPE}>"), "band_ord")
    kept = flat.where(~F.col("dropped")).drop("dropped")
    return ParsedCharts(kept, flat.where("dropped").select(id_col, F.lit(parser).alias("parser"), "band_ord"))


def parse_chart_long(docs: DataFrame, id_col="page_id") -> ParsedCharts:
    """program/from/to/cabin/miles tables; the first per page."""
    return emit(docs, long_rows(F.col("tables")), "long", id_col)


def parse_chart_wide(docs: DataFrame, id_col="page_id") -> ParsedCharts:
    """from/(to|distance)/cabin tables of the page's ``program``; the first per page."""
    return emit(docs, wide_rows(F.col("tables"), F.col("program")), "wide", id_col)


def parse_chart_destination(docs: DataFrame, id_col="page_id") -> ParsedCharts:
    """All destination tables of the page's ``program`` and ``hub``."""
    return emit(docs, destination_rows(F.col("tables"), F.col("program"), F.col("hub")), "destination", id_col)


def parse_zone_matrix(docs: DataFrame, id_col="page_id") -> ParsedCharts:
    """Zone x zone tables under an exact cabin heading."""
    return emit(docs, zone_matrix_rows(F.col("tables"), F.col("program")), "zone_matrix", id_col)


def parse_seasonal_zones(docs: DataFrame, id_col="page_id") -> ParsedCharts:
    """Season x cabin tables with a zone legend."""
    return emit(docs, seasonal_rows(F.col("tables"), F.col("program")), "seasonal", id_col)


def parse_matrix_blocks(docs: DataFrame, id_col="doc_id") -> ParsedCharts:
    """Matrices of grid documents, several cabin rows under one label."""
    return emit(docs, matrix_block_rows(F.col("grids"), F.col("program")), "zone_matrix", id_col)


def parse_distance_grid(docs: DataFrame, id_col="doc_id") -> ParsedCharts:
    """Distance-band grids of grid documents."""
    return emit(docs, distance_grid_rows(F.col("grids"), F.col("program")), "distance", id_col)


def parse_triangular_text(docs: DataFrame, text_col="page_text", id_col="doc_id") -> DataFrame:
    """Lower-triangular matrix written as lines: ``Region X n n n`` and ``X n n n`` of the same origin."""
    amounts = r"((?:\d{1,3}+(?:,\d{3})*+\s*+)++)$"
    line = F.trim(F.col("line"))
    lines = docs.select(id_col, "program", F.posexplode(F.split(text_col, "\n")).alias("line_ord", "line")).select(
        id_col, "program", "line_ord", line.alias("line")
    )
    skip = F.lit(False)
    for prefix in vocab.TRIANGLE_SKIP_PREFIXES:
        skip = skip | line.startswith(prefix)
    named = r"^(.+?)\s+([XIO])\s+" + amounts
    plain = r"^([XIO])\s+" + amounts
    got = lambda p, g: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    heading = F.when(
        ~line.rlike(r"\d") & (F.length(line) > 2) & (line != "Oceania"), F.col("line")
    )
    read = lines.where((line != "") & ~skip).select(
        id_col, "program", "line_ord",
        F.coalesce(F.trim(got(named, 1)), heading).alias("origin_here"),
        F.coalesce(got(named, 2), got(plain, 1)).alias("code"),
        F.coalesce(got(named, 3), got(plain, 2)).alias("amounts"),
    )
    w = Window.partitionBy(id_col).orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = read.withColumn("origin", F.last("origin_here", ignorenulls=True).over(w)).where(F.col("code").isNotNull())
    regions = F.array(*[F.lit(r) for _, r in vocab.TRIANGLE_REGIONS])
    titles = F.array(*[F.lit(t) for t, _ in vocab.TRIANGLE_REGIONS])
    start = F.array_position(titles, F.col("origin")).cast("int")
    values = F.regexp_extract_all("amounts", F.lit(r"\d{1,3}(?:,\d{3})*"), F.lit(0))
    return (
        filled.where(start > 0)
        .select(id_col, "program", "line_ord", "code", start.alias("start"), F.posexplode(values).alias("j", "amount"))
        .where(F.col("start") + F.col("j") <= len(vocab.TRIANGLE_REGIONS))
        .select(
            id_col, (F.shiftleft(F.col("line_ord").cast("bigint"), 16) + F.col("j")).alias("band_ord"), "program",
            F.element_at(regions, F.col("start")).alias("region_a"),
            F.element_at(regions, F.col("start") + F.col("j")).alias("region_b"),
            labels.lookup(vocab.TRIANGLE_CABINS, F.col("code")).alias("cabin"),
            F.regexp_replace("amount", ",", "").cast("bigint").alias("miles"), F.lit(False).alias("roundtrip"),
        )
    )


def route_grid_parsers(docs: DataFrame, text_programs=vocab.TRIANGLE_PROGRAMS, id_col="doc_id") -> ParsedCharts:
    """Rows (with ``route``) of the first parser that yields any: wide, distance grid, matrix, then triangular text.

    ``docs``: id, program, grids array, page_text. The choice is made inside the document row. Triangular text is a
    shape of ``text_programs`` alone. Every other document gets one drop row, so that documents with rows and
    drop rows add up to all documents: ``grid`` where grids were there to read, ``text`` where only a text was,
    else ``empty``.
    """
    def kept(rows):
        return F.filter(rows.cast(f"array<{ROW_TYPE}>"), lambda r: ~r["dropped"])

    def offer(name, rows):
        tagged = F.array(F.struct(F.lit(name).alias("route"), kept(rows).alias("rows")))
        return F.try_element_at(F.filter(tagged, lambda x: F.size(x["rows"]) > 0), F.lit(1))

    grids, program = F.col("grids"), F.col("program")
    choice = F.coalesce(
        offer("wide", wide_rows(grids, program)),
        offer("distance", distance_grid_rows(grids, program)),
        offer("zone_matrix", matrix_block_rows(grids, program)),
    )
    meta = [c for c in ("source_name", "updated_at") if c in docs.columns]
    chosen = docs.select(id_col, *meta, "program", "page_text", (F.size("grids") > 0).alias("with_grids"), choice.alias("c"))
    chosen = materialize(chosen, "grid-rows")  # the parsers run once, for rows and for what is left over
    grid = inline_rows(chosen, [id_col, *meta, "c.route"], F.col("c.rows"), "band_ord").drop("dropped")
    rest = chosen.where(F.col("c").isNull())
    text = parse_triangular_text(rest.where(F.lower(F.trim("program")).isin(*text_programs)).select(id_col, "program", "page_text"), id_col=id_col)
    if meta:
        text = text.join(docs.select(id_col, *meta), id_col)
    why = F.when(F.coalesce("with_grids", F.lit(False)), "grid").when(F.trim("page_text") != "", "text").otherwise("empty")
    unread = rest.select(id_col, why.alias("parser"), F.lit(0).cast("bigint").alias("band_ord")).join(text.select(id_col).distinct(), id_col, "left_anti")
    rows = grid.unionByName(text.withColumn("route", F.lit("text")), allowMissingColumns=True)
    return ParsedCharts(rows, unread)


def drop_counters(parsed: ParsedCharts, parser: str, id_col="page_id") -> DataFrame:
    """Rows kept and dropped per document."""
    one = lambda df, kept: df.select(id_col, F.lit(kept).alias("kept"), F.lit(1 - kept).alias("dropped"))
    return one(parsed.rows, 1).unionByName(one(parsed.dropped, 0)).groupBy(id_col).agg(
        F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped")
    ).withColumn("parser", F.lit(parser))
