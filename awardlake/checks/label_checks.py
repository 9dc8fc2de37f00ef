"""Queries over the scalar functions."""

from pyspark.sql import functions as F

from awardlake import vocab
from awardlake.checks.base import NOW, NOW_SQL, joined, query, r6, sql_values, view
from awardlake.functions import labels, points, text


def pick(values, index, engine):
    """SQL text that picks from constant texts by a 0-based index."""
    lits = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    if engine == "spark":
        return f"element_at(array({lits}), cast({index} AS int) + 1)"
    return f"([{lits}])[{index} + 1]"


ALIASES = vocab.region_alias_pairs()
NAMES = [a for a, _ in ALIASES] + ["atlantis", "zone 4", "us virgin", "australian coast", ""]


def label_text(engine):
    """Region labels in many spellings, from part rows."""
    name = pick(NAMES, f"p_partkey % {len(NAMES)}", engine)
    return (
        f"CASE p_size % 7 WHEN 0 THEN upper({name}) WHEN 1 THEN {name} || ' (Zone ' || cast(p_size AS varchar(20)) || ')' "
        f"WHEN 2 THEN replace({name}, ' ', '-') WHEN 3 THEN 'From ' || {name} || ' area' WHEN 4 THEN '[x] ' || {name} "
        f"WHEN 5 THEN '  ' || {name} || '!! ' ELSE {name} END"
    )


NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
REGION_SQL = f"""
al AS {sql_values(ALIASES, ['alias', 'region'])},
lab AS (SELECT DISTINCT label, {NORM.format('label')} AS n1, {NORM.format("regexp_replace(label, '[(\\[][^)\\]]*[)\\]]', ' ', 'g')")} AS n2
        FROM (SELECT {{label}} AS label FROM {{source}})),
cand AS (SELECT label, region, CASE WHEN n1 = alias THEN 1000 WHEN contains(alias, ' ') AND contains(n1, alias) THEN 500 + length(alias)
                WHEN n2 = alias THEN 400 WHEN contains(alias, ' ') AND contains(n2, alias) THEN length(alias) ELSE 0 END AS score
         FROM lab CROSS JOIN al),
reg AS (SELECT label, arg_max(region, score) FILTER (WHERE score > 0) AS region FROM cand GROUP BY label)
"""


@query("canonicalize_region", f"""
WITH {REGION_SQL.format(label=label_text('duck'), source='@part')}
SELECT p_partkey, region FROM @part JOIN reg ON reg.label = {label_text('duck')}
""")
def _region(d):
    df = d.sql(f"SELECT p_partkey, {label_text('spark')} AS label FROM @part")
    return df.select("p_partkey", labels.canonicalize_region(F.col("label")).alias("region"))


PAIR_WORDS = [" and ", " to ", " vs ", " or ", " / "]


def pair_text(engine):
    a = pick(NAMES, f"p_partkey % {len(NAMES)}", engine)
    b = pick(NAMES, f"(p_partkey * 7 + p_size) % {len(NAMES)}", engine)
    word = pick(PAIR_WORDS, "p_size % 5", engine)
    return (
        f"CASE p_size % 6 WHEN 0 THEN 'Within ' || {a} WHEN 1 THEN {a} ELSE 'Between ' || {a} || {word} || {b} END"
    )


SIDE = "list_filter(string_split_regex({0}, '\\b(and|to|vs|or)\\b'), lambda x: trim(x) <> '')"


@query("canonicalize_zone_pair", f"""
WITH p AS (SELECT p_partkey, {NORM.format(pair_text('duck'))} AS n FROM @part),
parts AS (SELECT p_partkey, n, CASE WHEN starts_with(n, 'within ') THEN [n[8:]] ELSE {SIDE.format("regexp_replace(n, '^between ', '')")} END AS sides FROM p),
ex AS (SELECT p_partkey, n, unnest(sides) AS label, generate_subscripts(sides, 1) AS pos FROM parts),
src AS (SELECT DISTINCT trim(label) AS label FROM ex),
{REGION_SQL.format(label='label', source='src')},
hit AS (SELECT p_partkey, region, min(pos) AS pos FROM ex JOIN reg ON reg.label = trim(ex.label) WHERE region IS NOT NULL GROUP BY ALL),
agg AS (SELECT p_partkey, list(region ORDER BY pos) AS r FROM hit GROUP BY 1)
SELECT p.p_partkey, CASE WHEN starts_with(n, 'within ') THEN r[1] WHEN len(r) = 2 THEN r[1] END AS a,
       CASE WHEN starts_with(n, 'within ') THEN r[1] WHEN len(r) = 2 THEN r[2] END AS b
FROM p LEFT JOIN agg ON agg.p_partkey = p.p_partkey
""")
def _pair(d):
    df = d.sql(f"SELECT p_partkey, {pair_text('spark')} AS label FROM @part")
    return df.select("p_partkey", labels.canonicalize_zone_pair(F.col("label")).alias("z")).select("p_partkey", "z.a", "z.b")


BAND = """CASE p_size % 6 WHEN 0 THEN cast(p_size * 100 AS varchar(20)) || '-' || cast(p_partkey * 3 AS varchar(20)) || ' miles'
 WHEN 1 THEN cast(p_size AS varchar(20)) || ',001+ mi' WHEN 2 THEN 'over ' || cast(p_partkey AS varchar(20)) WHEN 3 THEN 'up to ' || cast(p_partkey AS varchar(20))
 WHEN 4 THEN 'any' ELSE cast(p_size AS varchar(20)) || ',500 – 9,000' END"""


@query("parse_distance_band", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN least(p_size * 100, p_partkey * 3) WHEN 1 THEN p_size * 1000 + 1 WHEN 2 THEN p_partkey WHEN 3 THEN p_partkey
         WHEN 4 THEN NULL ELSE least(p_size * 1000 + 500, 9000) END AS lo,
       CASE p_size % 6 WHEN 0 THEN greatest(p_size * 100, p_partkey * 3) WHEN 1 THEN 999999 WHEN 2 THEN 999999 WHEN 3 THEN p_partkey
         WHEN 4 THEN NULL ELSE greatest(p_size * 1000 + 500, 9000) END AS hi
FROM @part
""")
def _band(d):
    df = d.sql(f"SELECT p_partkey, {BAND} AS label FROM @part")
    return df.select("p_partkey", labels.parse_distance_band(F.col("label")).alias("b")).select("p_partkey", "b.lo", "b.hi")


PROGRAMS = [(p, k) for k, phrases in vocab.PROGRAM_ALIASES.items() for p in phrases]
PHRASES = [p for p, _ in PROGRAMS] + ["eva", "united", "banana club", ""]


def program_text(engine):
    name = pick(PHRASES, f"p_partkey % {len(PHRASES)}", engine)
    other = pick(PHRASES, f"(p_partkey + p_size) % {len(PHRASES)}", engine)
    return f"CASE p_size % 4 WHEN 0 THEN upper({name}) WHEN 1 THEN {name} || ' or ' || {other} WHEN 2 THEN 'the ' || {name} || ' club' ELSE ' ' || {name} END"


@query("canonicalize_program", f"""
WITH al AS {sql_values(PROGRAMS, ['phrase', 'id'])},
t AS (SELECT p_partkey, lower(trim({program_text('duck')})) AS low FROM @part),
s AS (SELECT p_partkey, id, row_number() OVER (PARTITION BY p_partkey ORDER BY (low = phrase OR low = id) DESC, length(phrase) DESC, strpos(low, phrase)) AS rn
      FROM t JOIN al ON low = id OR contains(low, phrase))
SELECT t.p_partkey, id AS program FROM t LEFT JOIN s ON s.p_partkey = t.p_partkey AND rn = 1
""")
def _program(d):
    df = d.sql(f"SELECT p_partkey, {program_text('spark')} AS label FROM @part")
    return df.select("p_partkey", labels.canonicalize_program(F.col("label")).alias("program"))


MILES_CELL = """CASE p_size % 6 WHEN 0 THEN cast(p_size AS varchar(20)) || ',500 miles' WHEN 1 THEN cast(p_size AS varchar(20)) || ',000-' || cast(p_size + 5 AS varchar(20)) || ',000'
 WHEN 2 THEN '—' WHEN 3 THEN cast(p_size AS varchar(20)) || '.5' WHEN 4 THEN 'N/A' ELSE cast(p_partkey + 600 AS varchar(20)) END"""


@query("parse_miles_cell", """
SELECT p_partkey,
  CASE p_size % 6 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN cast(p_size || '000' || (p_size + 5) || '000' AS bigint) WHEN 3 THEN cast(p_size || '5' AS bigint) WHEN 5 THEN p_partkey + 600 END AS digits,
  CASE p_size % 6 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size * 1000 WHEN 3 THEN cast(p_size || '5' AS bigint) WHEN 5 THEN p_partkey + 600 END AS wide,
  CASE p_size % 6 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size * 1000 WHEN 3 THEN p_size * 1000 + 500 WHEN 5 THEN p_partkey + 600 END AS matrix
FROM @part
""")
def _miles(d):
    df = d.sql(f"SELECT p_partkey, {MILES_CELL} AS cell FROM @part")
    return df.select("p_partkey", *[labels.parse_miles_cell(F.col("cell"), m).alias(m) for m in ("digits", "wide", "matrix")])


TOKENS = ["1", "TRUE", "yes ", "Y", "rt", "RoundTrip", "0", "no", "", "one-way"]


@query("to_bool_token", f"SELECT p_partkey, p_partkey % {len(TOKENS)} < 6 AS flag FROM @part")
def _bool(d):
    df = d.sql(f"SELECT p_partkey, {pick(TOKENS, f'p_partkey % {len(TOKENS)}', 'spark')} AS token FROM @part")
    return df.select("p_partkey", labels.to_bool_token(F.col("token")).alias("flag"))


CABIN_CASES = [
    ("Premium Economy", "premium_economy", "premium_economy", "premium_economy", None),
    ("Business", "business", "business", "business", None),
    ("First Class", "first", "first", "first", "first"),
    ("EconomySaver", None, "economy", None, None),
    ("First/SuitesSaver", None, "first", "first", None),
    ("Economy Class", None, "economy", "economy", "economy"),
    ("Economy to Business Class", None, "business", "business", None),
    ("Star Alliance Business Award Chart", None, "business", "business", "business"),
    ("Saver Economy Award Chart", None, "economy", "economy", None),
    ("Premium", "premium_economy", None, None, None),
    ("Note", None, None, None, None),
]


@query("cabin_of", f"""
SELECT p_partkey, wide, destination, page, heading FROM @part
JOIN {sql_values([(i, *c[1:]) for i, c in enumerate(CABIN_CASES)], ['i', 'wide', 'destination', 'page', 'heading'])} c ON c.i = p_partkey % {len(CABIN_CASES)}
""")
def _cabin(d):
    df = d.sql(f"SELECT p_partkey, {pick([c[0] for c in CABIN_CASES], f'p_partkey % {len(CABIN_CASES)}', 'spark')} AS title FROM @part")
    return df.select("p_partkey", *[labels.cabin_of(F.col("title"), m).alias(m) for m in ("wide", "destination", "page", "heading")])


ZONE_LABEL = """CASE p_size % 5 WHEN 0 THEN 'Zone ' || cast(p_size AS varchar(20)) WHEN 1 THEN ' ' || cast(p_size AS varchar(20)) || ' '
 WHEN 2 THEN 'Japan (zone' || cast(p_size AS varchar(20)) || ')' WHEN 3 THEN 'Japan' ELSE 'Nowhere 9' END"""


@query("zone_key", "SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN 'north_asia' WHEN 4 THEN NULL ELSE cast(p_size AS varchar) END AS zone FROM @part")
def _zone(d):
    return d.sql(f"SELECT p_partkey, {ZONE_LABEL} AS label FROM @part").select("p_partkey", labels.zone_key(F.col("label")).alias("zone"))


@query("parse_source_date", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 0 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM @events
""")
def _date(d):
    ts = F.col("ts").cast("timestamp")
    form = lambda t, p: F.date_format(t, p)
    kind = F.col("event_id") % 5
    shown = (
        F.when(kind == 0, form(ts, "yyyy-MM-dd"))
        .when(kind == 1, F.concat(form(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 2, F.concat(form(ts + F.expr("interval 2 hours"), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(kind == 3, form(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit("next Tuesday"))
    )
    return d.table("events").select("event_id", F.unix_micros(labels.parse_source_date(shown)).alias("micros"))


@query("route_key", "SELECT s_suppkey, upper(s_name) || '-' || upper('b' || s_suppkey) || '-first' AS route_key FROM @supplier")
def _route_key(d):
    return d.table("supplier").select(
        "s_suppkey", points.route_key(F.col("s_name"), F.concat(F.lit("b"), F.col("s_suppkey").cast("string")), F.lit("first")).alias("route_key")
    )


@query("cents_per_point", """
SELECT o_orderkey, round(CASE WHEN pts > 0 THEN cents / pts ELSE 0 END, 6) AS cpp, cast(ceil(cents / 1.25E0) AS bigint) AS portal_points,
       CASE WHEN ratio > 0 THEN cast(ceil(pts / ratio) AS bigint) END AS source_points,
       round(CASE WHEN ratio > 0 AND ceil(pts / ratio) > 0 THEN cents / ceil(pts / ratio) ELSE 0 END, 6) AS transfer_cpp, ratio * 0.5 * 2 AS compound
FROM (SELECT o_orderkey, cast(floor(o_totalprice * 100) AS bigint) AS cents, o_custkey % 50 * 1000 AS pts, (o_orderkey % 5) * 0.25E0 AS ratio FROM @orders)
""")
def _cpp(d):
    df = d.table("orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") * 100).alias("cents"), (F.col("o_custkey") % 50 * 1000).alias("pts"),
        ((F.col("o_orderkey") % 5) * 0.25).alias("ratio"),
    )
    c = F.col
    return df.select(
        "o_orderkey", r6(points.cents_per_point(c("cents"), c("pts"))).alias("cpp"),
        points.portal_points_needed(c("cents"), F.lit(1.25)).alias("portal_points"),
        points.source_points_for_award(c("pts"), c("ratio")).alias("source_points"),
        r6(points.transfer_cpp(c("cents"), c("pts"), c("ratio"))).alias("transfer_cpp"),
        points.compound_ratio(F.array(c("ratio"), F.lit(0.5), F.lit(2.0))).alias("compound"),
    )


@query("freshness", f"""
SELECT ord, round(age, 6) AS age_days, round(greatest(0, least(1, confidence * pow(0.5, age / 60.0E0))), 6) AS confidence, age > 120 AS stale
FROM (SELECT ord, miles, confidence, greatest(0, (epoch_us({NOW_SQL}) - epoch_us(CASE WHEN ord % 10 = 3 THEN fetched_at ELSE source_updated_at END)) / 86400e6) AS age FROM @@award_quotes q)
""")
def _fresh(d):
    own = F.when(F.col("ord") % 10 != 3, F.col("source_updated_at"))
    df = d.view("award_quotes").withColumn("f", points.freshness(F.col("confidence"), own, F.col("fetched_at"), NOW))
    return df.select("ord", r6(F.col("f.age_days")).alias("age_days"), r6(F.col("f.confidence")).alias("confidence"), F.col("f.stale").alias("stale"))


@query("within_bounds", """
SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN m BETWEEN 3000 AND 200000 WHEN 1 THEN m BETWEEN 5000 AND 250000 WHEN 2 THEN m BETWEEN 10000 AND 400000
  WHEN 3 THEN m BETWEEN 15000 AND 700000 ELSE m BETWEEN 1 AND 10000000 END AS ok, m * 60 BETWEEN 1000 AND 5000000 AS fare_ok
FROM (SELECT *, cast(floor(l_extendedprice) AS bigint) AS m FROM @lineitem)
""")
def _bounds(d):
    cabin = F.element_at(F.array(*[F.lit(c) for c in (*vocab.CABINS, "sleeper")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    m = F.floor("l_extendedprice")
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", points.within_bounds(cabin, m).alias("ok"), points.fare_within_bounds(m * 60).alias("fare_ok")
    )


@query("portal_cpp_of", "SELECT request_id, CASE card WHEN 'venture_x' THEN 1.25E0 ELSE 1.0E0 END AS rate FROM @@requests q")
def _portal(d):
    return d.view("requests").select("request_id", points.portal_cpp_of(F.col("card")).alias("rate"))


DIGITS = r"""list_sort(list_distinct(list_filter(
 list_transform(regexp_extract_all(replace({0}, chr(160), ' '), '(\d+(?:\.\d+)?)\s*[kK]\b', 1), lambda x: cast(round_even(cast(x AS double) * 1000, 0) AS bigint))
 || list_transform(regexp_extract_all(replace({0}, chr(160), ' '), '\d{{1,3}}(?:[,\s]\d{{3}})+|\d+'), lambda x: try_cast(regexp_replace(x, '[^0-9]', '', 'g') AS bigint)),
 lambda x: x IS NOT NULL)))"""
NUMBER_TEXT = """concat('book ', cast(p_partkey * 50 AS varchar(20)), ' or ', cast(p_size AS varchar(20)), '.5k and ', cast(p_size AS varchar(20)), ' 000 miles, ', cast(p_size AS varchar(20)), ',250 pts')"""


@query("digit_runs", f"""
SELECT p_partkey AS id, array_to_string({DIGITS.format(NUMBER_TEXT)}, '|') AS runs FROM @part
UNION ALL SELECT 1000000000 + doc_id, array_to_string({DIGITS.format('text')}, '|') FROM @documents
""")
def _digits(d):
    parts = d.sql(f"SELECT p_partkey AS id, {NUMBER_TEXT} AS text FROM @part")
    docs = d.table("documents").select((F.col("doc_id") + 1_000_000_000).alias("id"), "text")
    runs = F.array_join(F.array_sort(text.digit_runs(F.col("text"))).cast("array<string>"), "|")
    return parts.unionByName(docs).select("id", runs.alias("runs"))


@query("number_is_grounded", """
SELECT p_partkey, p_size % 3 = 0 AND p_partkey > 0 OR list_contains([p_size * 1000 + 500, p_size, p_size * 1000, p_size * 1000 + 250, p_partkey * 50, 5], CASE p_size % 3 WHEN 0 THEN p_partkey * 50 WHEN 1 THEN p_size * 1000 + 500 ELSE p_partkey * 50 + 7 END)
  AND CASE p_size % 3 WHEN 0 THEN p_partkey * 50 WHEN 1 THEN 1 ELSE p_partkey * 50 + 7 END > 0 AS grounded FROM @part
""")
def _grounded(d):
    df = d.sql(f"SELECT p_partkey, {NUMBER_TEXT} AS text, CASE p_size % 3 WHEN 0 THEN p_partkey * 50 WHEN 1 THEN p_size * 1000 + 500 ELSE p_partkey * 50 + 7 END AS miles FROM @part")
    return df.select("p_partkey", text.number_is_grounded(F.col("miles"), F.col("text")).alias("grounded"))


RAW = "CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[aeiou]', {0}{1}) ELSE text END"


@query("looks_undecoded", f"""
SELECT doc_id, length(s) > 0 AND (length(regexp_replace(s, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g')) / length(s)) < 0.85 AS undecoded
FROM (SELECT doc_id, {RAW.format("chr(1)", ", 'g'")} AS s FROM @documents)
""")
def _undecoded(d):
    df = d.sql(f"SELECT doc_id, {RAW.format('char(1)', '')} AS text FROM @documents")
    return df.select("doc_id", text.looks_undecoded(F.col("text")).alias("undecoded"))
