"""Round trips of document formats, links and prose claims."""

from pyspark.sql import functions as F

from awardlake import vocab
from awardlake.checks.base import joined, query, r6, sql_values
from awardlake.checks.chart_checks import FROM_I, PAGE, TO_I, label, region
from awardlake.checks.label_checks import pick
from awardlake.operators import claims, documents, intake
from awardlake.sources.documents import decode_documents


def text_docs(d, record, open_text, close_text, glue=",", size=PAGE, where="true"):
    """Documents whose text joins one SQL-built record per part row."""
    rows = d.sql(f"SELECT {size} AS doc_id, p_partkey, {record} AS r FROM @part WHERE {where}")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))), lambda x: x["r"]), glue)
    return rows.groupBy("doc_id").agg(F.concat(F.lit(open_text), body, F.lit(close_text)).alias("text"))


@query("decode_documents", """
SELECT url, html AS text, CASE page_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS content_type FROM
 (SELECT page_id, 'p' || page_id || (['.JSON', '.html', '.pdf', '.md'])[page_id % 4 + 1] AS url, html FROM @pages)
""")
def _decode(d):
    latin = F.col("html").rlike(r"^[\x00-\xff]*$") & (F.col("page_id") % 2 == 0)
    end = F.element_at(F.array(*[F.lit(x) for x in (".JSON", ".html", ".pdf", ".md")]), (F.col("page_id") % 4 + 1).cast("int"))
    raw = d.table("pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), end).alias("path"),
        F.when(latin, F.encode(F.when(latin, F.col("html")), "ISO-8859-1")).otherwise(F.encode("html", "UTF-8")).alias("content"),
    )
    return decode_documents(raw).select("url", "text", "content_type")


AWARD_JSON = """concat('{"program":" P', cast(p_partkey % 3 AS string), '","origin":"lax","dest":"', CASE WHEN p_size % 11 = 0 THEN '' ELSE concat('d', cast(p_size AS string)) END,
 '","cabin":"', CASE WHEN p_size % 5 = 4 THEN 'crew' ELSE 'Business' END, '","miles":', CASE WHEN p_size % 3 = 0 THEN concat('"', cast(p_size AS string), ',500"') ELSE cast(p_size * 1000 AS string) END,
 ',"seats":', CASE WHEN p_size % 4 = 0 THEN '"2"' WHEN p_size % 4 = 1 THEN 'null' ELSE cast(p_size AS string) END, ',"roundtrip":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '"no"' END,
 CASE WHEN p_size % 2 = 0 THEN ',"updated_at":"2024-05-01"' ELSE ',"last_seen":"2024-04-01"' END, '}')"""
AWARD_JSON_SQL = """'p' || p_partkey % 3 AS program, 'LAX' AS origin, 'D' || p_size AS dest, 'business' AS cabin,
       cast(CASE WHEN p_size % 3 = 0 THEN p_size * 1000 + 500 ELSE p_size * 1000 END AS bigint) AS miles, cast(CASE WHEN p_size % 4 >= 2 THEN p_size END AS bigint) AS seats,
       p_size % 2 = 0 AS roundtrip, CASE WHEN p_size % 2 = 0 THEN '2024-05-01' ELSE '2024-04-01' END AS updated_at
FROM @part WHERE p_size % 11 <> 0 AND p_size % 5 <> 4"""
AWARD = ["doc_id", "program", "origin", "dest", "cabin", "miles", "seats", "roundtrip", "updated_at"]


@query("parse_award_json", f"SELECT {PAGE} AS doc_id, {AWARD_JSON_SQL}")
def _award_json(d):
    docs = text_docs(d, AWARD_JSON, '{"availability":[3,', "]}").withColumn(
        "text", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.regexp_replace("text", r'^\{"availability":', ""), r"\}$", "")).otherwise(F.col("text"))
    )
    broken = d.table("documents").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    return documents.parse_award_json(docs.unionByName(broken)).select(AWARD)


CHART_JSON = f"""concat('{{"program":"P', cast(p_partkey % 3 AS string), '","from":"', {label(FROM_I)}, '","to":"', {label(TO_I)}, '","cabin":"First","miles":"', cast(p_size AS string), ' 000","roundtrip":"rt","updated_at":"2024-01-0', cast(p_size % 9 + 1 AS string), '"}}')"""
CHART_JSON_SQL = f"""'p' || p_partkey % 3 AS program, {region(FROM_I)} AS region_a, {region(TO_I)} AS region_b, 'first' AS cabin, cast(p_size * 1000 AS bigint) AS miles, true AS roundtrip"""
CHART = ["doc_id", "program", "region_a", "region_b", "cabin", "miles", "roundtrip", "updated_at"]


@query("parse_chart_json", f"""
SELECT {PAGE} AS doc_id, {CHART_JSON_SQL}, '2024-01-0' || (p_size % 9 + 1) AS updated_at, false AS dropped FROM @part WHERE {region(FROM_I)} IS NOT NULL AND {region(TO_I)} IS NOT NULL
UNION ALL
SELECT {PAGE} AS doc_id, {CHART_JSON_SQL}, '2024-01-0' || (p_size % 9 + 1), true FROM @part WHERE {region(FROM_I)} IS NULL OR {region(TO_I)} IS NULL
""")
def _chart_json(d):
    kept, dropped = documents.parse_chart_json(text_docs(d, CHART_JSON, '{"charts":[', "]}"))
    return kept.select(*CHART, F.lit(False).alias("dropped")).unionByName(dropped.select(*CHART, F.lit(True).alias("dropped")))


FEED_HEAD = '<?xml version="1.0"?><rss xmlns:m="urn:x"><channel><title>feed</title>'
FEED_ITEM = f"""concat('<item><title>offer &amp; news ', cast(p_partkey AS string), '</title><link> https://b.example/', cast(p_partkey AS string), ' </link><pubDate>day ', cast(p_size AS string),
 '</pubDate><m:data>', CASE p_size % 3 WHEN 0 THEN regexp_replace({AWARD_JSON}, '^.', '{{"kind":"award",') WHEN 1 THEN regexp_replace(regexp_replace({CHART_JSON}, '^.', '{{"kind":"chart",'), '"updated_at":"[^"]*"', '"x":1') ELSE 'no json' END, '</m:data></item>')"""


@query("parse_feed_payloads", f"""
SELECT {PAGE} AS doc_id, 'award' AS kind, program, dest AS a, '' AS b, miles, updated_at FROM (SELECT p_partkey, p_size AS sz, {AWARD_JSON_SQL}) WHERE sz % 3 = 0
UNION ALL
SELECT {PAGE}, 'chart', program, region_a, region_b, miles, 'day ' || p_size FROM (SELECT p_partkey, p_size, {CHART_JSON_SQL} FROM @part) WHERE p_size % 3 = 1 AND region_a IS NOT NULL AND region_b IS NOT NULL
""")
def _payloads(d):
    docs = text_docs(d, FEED_ITEM, FEED_HEAD, "</channel></rss>", glue="\n")
    docs = docs.unionByName(d.table("pages").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.col("html").alias("text")))
    chart, award, _ = documents.parse_feed_payloads(docs)
    return award.select("doc_id", F.lit("award").alias("kind"), "program", F.col("dest").alias("a"), F.lit("").alias("b"), "miles", "updated_at").unionByName(
        chart.select("doc_id", F.lit("chart").alias("kind"), "program", F.col("region_a").alias("a"), F.col("region_b").alias("b"), "miles", "updated_at")
    )


def feed_docs(d):
    atom = """concat('<entry><title>clip ', cast(p_partkey AS string), '</title><link rel="x" href="https://v.example/', cast(p_partkey AS string), '"/><yt:videoId>v', cast(p_partkey AS string),
     '</yt:videoId><published>2024-0', cast(p_size % 9 + 1 AS string), '-01</published><updated>2025</updated></entry>')"""
    rss = text_docs(d, FEED_ITEM, FEED_HEAD, "</channel></rss>", where="p_partkey % 50 < 25")
    entries = text_docs(d, atom, '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="urn:yt">', "</feed>", where="p_partkey % 50 >= 25")
    return rss.unionByName(entries)


@query("parse_feed_entries", f"""
SELECT {PAGE} AS doc_id, row_number() OVER (PARTITION BY {PAGE} ORDER BY p_partkey) - 1 AS entry_ord,
       CASE WHEN p_partkey % 50 < 25 THEN 'https://b.example/' ELSE 'https://v.example/' END || p_partkey AS url,
       CASE WHEN p_partkey % 50 < 25 THEN 'offer & news ' ELSE 'clip ' END || p_partkey AS title,
       CASE WHEN p_partkey % 50 < 25 THEN 'day ' || p_size ELSE '2024-0' || (p_size % 9 + 1) || '-01' END AS published
FROM @part
""")
def _entries(d):
    junk = d.table("documents").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    return documents.parse_feed_entries(feed_docs(d).unionByName(junk)).withColumn("entry_ord", F.col("entry_ord").cast("bigint"))


@query("parse_channel_feed", f"""
SELECT {PAGE} AS doc_id, 'v' || p_partkey AS video_id, 'clip ' || p_partkey AS title, '2024-0' || (p_size % 9 + 1) || '-01' AS published FROM @part WHERE p_partkey % 50 >= 25
""")
def _channel(d):
    return documents.parse_channel_feed(feed_docs(d)).drop("entry_ord")


@query("captions_to_text", """
SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^[0-9]+$')), lambda x: regexp_replace(trim(x), '<[^>]+>', '', 'g')), ' ') || ' end' AS text
FROM @conversations
""")
def _captions(d):
    vtt = F.concat(
        F.lit("WEBVTT\n\n12\n00:01.000 --> 00:02.000\n"), F.regexp_replace("text", "\n", "\n00:03.000 --> 00:04.000\n<c.x></c>"), F.lit("\r\n7\n<b>end</b>\n")
    )
    return d.table("conversations").select("conv_id", "turn", documents.captions_to_text(vtt).alias("text"))


@query("html_to_text", """
SELECT doc_id, CASE WHEN contains(text, '<') AND contains(text, '>') THEN NULL ELSE text END AS text FROM @documents
UNION ALL SELECT 1000000 + p_partkey, p_name || ' & ' || p_type || ' line ' || p_size FROM @part
""")
def _html_text(d):
    """All documents; the SQL has no text for those with markup, which ``tests/test_parsing.py`` compares."""
    docs = d.table("documents").select("doc_id", "text")
    pages = d.sql(
        "SELECT 1000000 + p_partkey AS doc_id, concat('<p>', p_name, '</p> <style>b {}</style><script>if (a<b) x()</script><i>&amp;</i><b>', p_type, '</b>\\n<p>line ', cast(p_size AS string), '</p>') AS text FROM @part"
    )
    return docs.unionByName(pages).select("doc_id", documents.html_to_text(F.col("text")).alias("text"))


@query("html_pages_to_text", """
SELECT page_id, html LIKE '%<title>%' AS has_title, regexp_matches(html, 'track\\(') AS has_script, false AS script_left FROM @pages
""")
def _page_text(d):
    text = documents.html_to_text(F.col("html"))
    return d.table("pages").select("page_id", F.contains("html", F.lit("<title>")).alias("has_title"), F.contains("html", F.lit("track(")).alias("has_script"), text.alias("t")).select(
        "page_id", "has_title", "has_script", F.contains("t", F.lit("track(")).alias("script_left")
    )


MAIL = r"""concat('From: "Deals ', cast(p_partkey AS string), '" <Deals', cast(p_partkey % 7 AS string), char(64), 'Mail.example>\r\nSubject: offer ', cast(p_partkey AS string),
 '\r\nDate: Mon, 2 Aug 1999 10:0', cast(p_size % 10 AS string), ':00 +0200\r\nMIME-Version: 1.0\r\n', CASE WHEN p_size % 2 = 0 THEN concat('Content-Type: multipart/mixed; boundary="zz"\r\n\r\n--zz\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nplain ', p_name,
 '\r\n--zz\r\nContent-Type: text/html; charset=utf-8\r\nContent-Disposition: attachment; filename="a.html"\r\n\r\n<b>attached</b>\r\n--zz\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>', p_name, '</p>\r\n--zz--\r\n')
 ELSE concat('Content-Type: text/plain; charset=utf-8\r\n\r\nonly ', p_name) END)"""


@query("parse_mail_documents", """
SELECT p_partkey AS doc_id, 'email:deals' || p_partkey % 7 || chr(64) || 'mail.example' AS source_name, 'offer ' || p_partkey AS subject,
       CASE WHEN p_size % 2 = 0 THEN '<p>' || p_name || '</p>' ELSE 'only ' || p_name END AS body, '1999-08-02T08:0' || p_size % 10 || ':00+00:00' AS received_at FROM @part
""")
def _mail(d):
    raw = d.sql(f"SELECT p_partkey AS doc_id, encode({MAIL}, 'UTF-8') AS raw FROM @part")
    return documents.parse_mail_documents(raw).withColumn("body", F.trim("body"))


LINKS = [
    "https://blog.example/post-{k}", "http://youtu.be/vid{k}?t=3", "https://www.youtube.com/watch?v=w{k}&x=1", "https://m.youtube.com/shorts/s{k}/more",
    "https://img.example/{k}.PNG", "https://www.facebook.com/p{k}", "https://list.example/unsubscribe?u={k}", "mailto:a{k}",
]
KINDS = ["article", "video", "video", "video", "noise", "noise", "noise", None]
IDS = [None, "vid{k}", "w{k}", "s{k}", None, None, None, None]


def link_sql(i, values):
    """SQL text for link i of a row; ``{k}`` becomes the part key."""
    cases = " ".join(
        f"WHEN {n} THEN " + ("NULL" if v is None else "'" + v.replace("{k}", "' || cast(p_partkey AS varchar(20)) || '") + "'") for n, v in enumerate(values)
    )
    return f"CASE {i} {cases} END"


L1, L2 = "p_partkey % 8", "(p_partkey + p_size) % 8"


def link_docs(d):
    a, b = link_sql(L1, LINKS), link_sql(L2, LINKS)
    body = (
        f"concat('<p>see <a class=\"x\" href=\"', replace({a}, '&', '&amp;'), '\">here</a> or <!-- <a href=\"https://hidden.example/\"> --> ', "
        f"'<a href=\"https://www.google.com/url?q=https%3A%2F%2Fgo.example%2F', cast(p_partkey AS string), '&amp;s=1\">go</a> ', {b}, '.</p> and again ', {b}, ')')"
    )
    return d.sql(f"SELECT p_partkey AS doc_id, regexp_replace({body}, 'https://hidden.example/', 'x') AS body FROM @part")


# An escaped link (``&amp;``) is read twice: once as an anchor, once as plain text in the markup.
LINK_ROWS = f"""
l AS (SELECT p_partkey AS doc_id, 0.0 AS k, {link_sql(L1, LINKS)} AS url, {link_sql(L1, KINDS)} AS kind, {link_sql(L1, IDS)} AS video_id FROM @part
      UNION ALL SELECT p_partkey, 1, 'https://go.example/' || p_partkey, 'article', NULL FROM @part
      UNION ALL SELECT p_partkey, 1.5, replace({link_sql(L1, LINKS)}, '&', '&amp;'), 'video', 'w' || p_partkey FROM @part WHERE {L1} = 2
      UNION ALL SELECT p_partkey, 2, {link_sql(L2, LINKS)}, {link_sql(L2, KINDS)}, {link_sql(L2, IDS)} FROM @part),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY k) AS rn FROM l WHERE NOT starts_with(url, 'mailto')),
links AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, url, kind, video_id FROM u WHERE rn = 1)
"""


@query("extract_links", f"WITH {LINK_ROWS} SELECT doc_id, ord, url FROM links")
def _links(d):
    return documents.extract_links(link_docs(d)).withColumn("ord", F.col("ord").cast("bigint"))


@query("follow_every_link", f"""
WITH {LINK_ROWS} SELECT doc_id, ord, kind <> 'noise' AND row_number() OVER (PARTITION BY doc_id, kind, coalesce(video_id, url) ORDER BY ord) = 1 AS followed FROM links
""")
def _follow(d):
    return documents.classify_links(documents.extract_links(link_docs(d))).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "followed")


@query("classify_links", f"""
WITH {LINK_ROWS},
f AS (SELECT *, kind <> 'noise' AND row_number() OVER (PARTITION BY doc_id, kind, coalesce(video_id, url) ORDER BY ord) = 1 AS fresh FROM links)
SELECT doc_id, ord, kind, video_id, fresh AND sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) <= 2 AS followed FROM f
""")
def _classify(d):
    links = documents.extract_links(link_docs(d))
    return documents.classify_links(links, limit=2).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "kind", "video_id", "followed")


# --- prose ----------------------------------------------------------------------------------------

PROSE_PROGRAMS = ["Turkish Miles&Smiles", "Air Canada Aeroplan", "LifeMiles", "KrisFlyer", "EVA Air"]
PROSE_IDS = ["turkish", "aeroplan", "lifemiles", "krisflyer", "eva"]
PROSE_CABINS = ["business class", "premium economy", "First", "coach"]
CABIN_IDS = ["business", "premium_economy", "first", "economy"]
PLACES = ["Tokyo", "Southeast Asia", "Brazil", "Nairobi", "Doha"]
PLACE_IDS = ["north_asia", "southeast_asia", "south_america", "africa", "middle_east"]
MILES = "cast(cast(3 + p_size AS bigint) * 1000 + p_partkey % 10 * 100 AS bigint)"
SENTENCE = (
    f"concat('Book ', {pick(PROSE_PROGRAMS, 'p_partkey % 5', 'spark')}, ' ', {pick(PROSE_CABINS, 'p_size % 4', 'spark')}, '\\n from ', "
    f"CASE WHEN p_size % 3 = 0 THEN 'London to ' ELSE 'home to ' END, {pick(PLACES, '(p_partkey + p_size) % 5', 'spark')}, ' for ', "
    f"format_number({MILES}, 0), CASE WHEN p_size % 2 = 0 THEN ' points' ELSE ' miles' END, CASE WHEN p_size % 5 = 0 THEN ' round-trip. ' ELSE '. ' END)"
)
FILLER = "'Filler words follow here and they are long enough to keep every offer well apart from the next one, so that no window reaches across, while nothing in this part names a price or a place that would count as a signal of its own here at all. '"


def prose_docs(d):
    """Five offers per document, some of them mere sign-up rewards."""
    record = f"concat(CASE WHEN p_partkey % 7 = 3 THEN concat('Earn a bonus of ', format_number({MILES}, 0), ' points after you spend. ') ELSE {SENTENCE} END, {FILLER})"
    return text_docs(d, record, "<p>Hello readers</p> ", "", glue="\n", size="cast(floor(p_partkey / 5) AS bigint)")


CLAIMS_SQL = f"""
c AS (SELECT cast(floor(p_partkey / 5) AS bigint) AS doc_id, p_partkey, {pick(PROSE_IDS, 'p_partkey % 5', 'duck')} AS program,
       CASE WHEN p_size % 3 = 0 THEN 'europe' ELSE 'north_america' END AS region_a, {pick(PLACE_IDS, '(p_partkey + p_size) % 5', 'duck')} AS region_b,
       {pick(CABIN_IDS, 'p_size % 4', 'duck')} AS cabin, {MILES} AS miles, p_size % 5 = 0 AS roundtrip FROM @part WHERE p_partkey % 7 <> 3)
"""
CLAIM = ["doc_id", "program", "region_a", "region_b", "cabin", "miles", "roundtrip"]


@query("extract_price_claims", f"WITH {CLAIMS_SQL} SELECT {', '.join(CLAIM)} FROM c")
def _claims(d):
    return claims.extract_price_claims(prose_docs(d)).select(CLAIM)


def by_document(sql):
    """The same offer text, built from document keys instead of part keys."""
    return sql.replace("p_partkey", "doc_id").replace("p_size", "(n_chars % 40)")


@query("extract_price_claims_documents", by_document(f"WITH {CLAIMS_SQL} SELECT {', '.join(CLAIM)} FROM c").replace(
    "cast(floor(doc_id / 5) AS bigint) AS doc_id, doc_id,", "doc_id,").replace("FROM @part WHERE doc_id % 7 <> 3", "FROM @documents"))
def _claims_documents(d):
    offer = by_document(SENTENCE)
    docs = d.sql(f"SELECT doc_id, concat(text, '. ', {offer}) AS text FROM @documents")
    return claims.extract_price_claims(docs).select(CLAIM)


@query("find_price_mentions", f"""
SELECT cast(floor(p_partkey / 5) AS bigint) AS doc_id, {MILES} AS miles FROM @part
UNION ALL
SELECT 1000000 + doc_id, unnest(list_filter(list_transform(CASE WHEN len(near) > 0 THEN near ELSE anyn END, lambda x: cast(regexp_replace(x, '[^0-9]', '', 'g') AS bigint)), lambda m: m BETWEEN 3000 AND 400000))
FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '(?i)(\\d{{1,3}}(?:[,\\s]\\d{{3}})+|\\d{{4,6}})\\s*(?:miles|points|pts)\\b', 1), lambda x: cast(regexp_replace(x, '[^0-9]', '', 'g') AS bigint) BETWEEN 3000 AND 400000) AS near,
             regexp_extract_all(text, '(\\d{{1,3}}(?:[,\\s]\\d{{3}})+|\\d{{4,6}})', 1) AS anyn FROM @documents WHERE NOT (contains(text, '<') AND contains(text, '>')))
""")
def _mentions(d):
    """All documents; the SQL leaves out those with markup, which ``tests/test_parsing.py`` compares."""
    docs = d.table("documents").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    return claims.find_price_mentions(prose_docs(d).unionByName(docs)).select("doc_id", "miles")


@query("new_items_limited", """
SELECT feed, url FROM (SELECT o_custkey AS feed, o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM @orders
  WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate > timestamp '1992-06-02 00:00:00')) WHERE rn <= 2
""")
def _new_limited(d):
    """With a limit, the newest two of what is new: seen entries do not use it up."""
    o = d.table("orders")
    entries = o.select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("url"), (-F.col("o_orderkey")).alias("entry_ord"))
    seen = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    return claims.new_items_only(entries, seen, "1992-07-02 00:00:00", limit=2).select("feed", "url")


@query("dedupe_claims", """
SELECT l_suppkey AS doc_id, 'p' || l_linenumber AS program, 'a' AS region_a, 'b' AS region_b, 'business' AS cabin, l_quantity::bigint AS miles, arg_max(l_returnflag = 'A', (l_orderkey, l_extendedprice)) AS roundtrip
FROM @lineitem GROUP BY ALL
""")
def _dedupe(d):
    rows = d.table("lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("program"),
        F.lit("a").alias("region_a"), F.lit("b").alias("region_b"), F.lit("business").alias("cabin"), F.floor("l_quantity").alias("miles"),
        (F.col("l_returnflag") == "A").alias("roundtrip"), F.struct("l_orderkey", "l_extendedprice").alias("claim_ord"),
    )
    return claims.dedupe_claims(rows).drop("claim_ord")


@query("ground_rows", f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 AND p_size % 4 = 0 THEN 'program' WHEN p_size % 6 = 5 THEN 'cabin' WHEN p_size % 7 = 2 THEN 'miles' WHEN p_size % 7 = 3 THEN 'ungrounded'
       WHEN {region(FROM_I)} IS NULL OR {region(TO_I)} IS NULL THEN 'region' ELSE 'kept' END AS outcome FROM @part
""")
def _ground(d):
    names = pick([*PROSE_PROGRAMS[:4], "Eva Air"], "p_partkey % 5", "spark")
    df = d.sql(
        f"SELECT p_partkey AS doc_id, concat('pay ', cast(p_size * 10 AS string), ',000 now') AS text, CASE WHEN p_partkey % 5 = 4 AND p_size % 4 = 0 THEN 'Hilton' ELSE {names} END AS program, "
        f"{label(FROM_I)} AS `from`, {label(TO_I)} AS `to`, CASE WHEN p_size % 6 = 5 THEN 'sleeper' ELSE ' Business ' END AS cabin, "
        "CASE WHEN p_size % 7 = 2 THEN 'lots' WHEN p_size % 7 = 3 THEN '77777' ELSE cast(p_size * 10000 AS string) END AS miles, false AS roundtrip FROM @part"
    )
    kept, rejected = claims.ground_rows(df.drop("text"), df.select("doc_id", "text"))
    return kept.select(F.col("doc_id").alias("p_partkey"), F.lit("kept").alias("outcome")).unionByName(rejected.select(F.col("doc_id").alias("p_partkey"), F.col("reason").alias("outcome")))


TITLES = ["Turkish devaluation ahead", "Award chart change at Air Canada", "Avianca LifeMiles devalued", "Canada devalues", "New lounge", "SINGAPORE devaluation", "United devaluation"]
TITLE_IDS = ["turkish", "aeroplan", "lifemiles", "ana", None, "krisflyer", None]


@query("detect_devaluations", f"SELECT p_partkey AS doc_id, {pick(TITLE_IDS, 'p_partkey % 7', 'duck')} AS program FROM @part WHERE p_partkey % 7 NOT IN (4, 6)")
def _devaluations(d):
    docs = d.sql(f"SELECT p_partkey AS doc_id, {pick(TITLES, 'p_partkey % 7', 'spark')} AS title FROM @part")
    return claims.detect_devaluations(docs)


INTAKES = ["email", "blog", "yt", "email_link:blog", "email_link:yt"]


def intake_docs(d):
    meta = d.sql(
        f"SELECT p_partkey AS doc_id, {SENTENCE} AS text, {pick(TITLES, 'p_partkey % 7', 'spark')} AS title, {pick(INTAKES, 'p_partkey % 5', 'spark')} AS intake, "
        "CASE WHEN p_partkey % 5 IN (1, 2) THEN concat('creator ', cast(p_size % 3 AS string)) ELSE concat('email:', cast(p_size AS string)) END AS origin, "
        "concat('u', cast(p_partkey AS string)) AS url, '2024-01-01' AS published FROM @part"
    )
    creators = d.sql("SELECT 'creator 0' AS name, 0.2E0 AS trust UNION ALL SELECT 'creator 1', 0.9E0")
    return meta, creators


DISCOVERED_SQL = f"""
WITH {CLAIMS_SQL.replace('WHERE p_partkey % 7 <> 3', '').replace('p_partkey, ', 'p_partkey, p_size, ', 1)}
SELECT p_partkey AS doc_id, program, miles, CASE WHEN p_partkey % 5 = 0 THEN 'email:' || p_size WHEN p_partkey % 5 IN (1, 2) THEN (['blog', 'yt'])[p_partkey % 5] || ':creator ' || p_size % 3
       ELSE (['email_link:blog', 'email_link:yt'])[p_partkey % 5 - 2] || ':email:' || p_size END AS source_name, 'u' || p_partkey AS source_url,
       CASE WHEN p_partkey % 5 = 0 THEN 0.3E0 WHEN p_partkey % 5 > 2 THEN 0.28E0 WHEN p_size % 3 = 0 THEN 0.2E0 ELSE 0.3E0 END AS trust FROM c
"""


@query("attach_discovery_provenance", DISCOVERED_SQL)
def _provenance(d):
    docs, creators = intake_docs(d)
    out = claims.attach_discovery_provenance(claims.extract_price_claims(docs), docs, creators)
    return out.select("doc_id", "program", "miles", "source_name", "source_url", "trust")


@query("run_discovery", f"""
SELECT 'rows' AS kind, split_part(source_name, ':', 1) AS k, count(*) AS n FROM ({DISCOVERED_SQL}) GROUP BY ALL
UNION ALL SELECT DISTINCT 'stale', {pick(TITLE_IDS, 'p_partkey % 7', 'duck')}, 1 FROM @part WHERE p_partkey % 7 NOT IN (4, 6)
""")
def _discovery(d):
    docs, creators = intake_docs(d)
    part = lambda c: docs.where(c)
    got = claims.run_discovery(part("intake LIKE 'email%'"), part("intake = 'blog'"), part("intake = 'yt'"), creators)
    return got.counts.select(F.lit("rows").alias("kind"), F.col("intake").alias("k"), F.col("rows").alias("n")).unionByName(
        got.stale.select(F.lit("stale").alias("kind"), F.col("program").alias("k"), F.lit(1).cast("bigint").alias("n"))
    )


LINKING = r"""concat('From: Deals <Deals', cast(p_partkey % 7 AS string), char(64), 'mail.example>\r\nSubject: look\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>look <a href="',
 CASE WHEN p_size % 2 = 0 THEN 'https://blog.example/post-' ELSE 'https://youtu.be/vid' END, cast(p_partkey AS string), '">here</a> or <a href="https://gone.example/x">there</a> <img src="https://img.example/x.png"></p>')"""


@query("follow_mail", f"""
WITH {CLAIMS_SQL.replace('WHERE p_partkey % 7 <> 3', '').replace('p_partkey, ', 'p_partkey, p_size, ', 1)}
SELECT p_partkey || ':0' AS doc_id, program, miles, CASE WHEN p_size % 2 = 0 THEN 'email_link:blog:' ELSE 'email_link:yt:' END || 'email:deals' || p_partkey % 7 || chr(64) || 'mail.example' AS source_name,
       CASE WHEN p_size % 2 = 0 THEN 'https://blog.example/post-' ELSE 'https://youtu.be/vid' END || p_partkey AS source_url, 0.28E0 AS trust FROM c
""")
def _follow_mail(d):
    """Mail to links to fetched posts and captions to claims, with the link's provenance."""
    mails = d.sql(f"SELECT p_partkey AS doc_id, encode({LINKING}, 'UTF-8') AS raw FROM @part")
    posts = d.sql(f"SELECT concat('https://blog.example/post-', cast(p_partkey AS string)) AS url, concat('<p>', {SENTENCE}, '</p>') AS text, 'post' AS title, '2024-01-01' AS published FROM @part")
    captions = d.sql(
        f"SELECT concat('vid', cast(p_partkey AS string)) AS video_id, concat('WEBVTT\n\n1\n00:01.000 --> 00:02.000\n', {SENTENCE}) AS text, 'clip' AS title, '2024-01-01' AS published FROM @part"
    )
    docs = intake.follow_mail(mails, posts, captions)
    none = docs.limit(0)
    return claims.run_discovery(docs, none, none).rows.select("doc_id", "program", "miles", "source_name", "source_url", "trust")


@query("new_items_only", """
SELECT o_custkey AS feed, o_orderkey AS url FROM @orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate > timestamp '1998-12-02 00:00:00')
""")
def _new(d):
    o = d.table("orders")
    entries = o.select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("url"), (-F.col("o_orderkey")).alias("entry_ord"))
    seen = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    return claims.new_items_only(entries, seen, "1999-01-01 00:00:00").select("feed", "url")


@query("run_extractor", f"""
SELECT doc_id, miles, outcome FROM (SELECT p_partkey AS doc_id, {MILES} AS miles, 'kept' AS outcome FROM @part
UNION ALL SELECT p_partkey, {MILES} + 1, 'ungrounded' FROM @part)
""")
def _extractor(d):
    """A backend that reads the number and also invents one; the guard drops the invention."""
    def backend(batches):
        for pdf in batches:
            read = pdf["text"].str.extract(r"for ([0-9,]+)")[0].str.replace(",", "").astype(int)
            fields = {"program": "ana", "from": "Japan", "to": "Europe", "cabin": "first", "roundtrip": False}
            for shift in (0, 1):
                yield pdf[["doc_id"]].assign(miles=(read + shift).astype(str), **fields)

    docs = d.sql(f"SELECT p_partkey AS doc_id, {SENTENCE} AS text FROM @part")
    kept, rejected = claims.run_extractor(docs, backend)
    return kept.select("doc_id", "miles", F.lit("kept").alias("outcome")).unionByName(rejected.select("doc_id", "miles", F.col("reason").alias("outcome")))
