"""Fetched documents of catalogued targets -> chart rows and award rows, by the target's format."""

from pyspark.sql import DataFrame, functions as F

from awardlake.functions.batches import spread
from awardlake.operators import charts, documents
from awardlake.operators.tables import with_tables
from awardlake.sources.sinks import materialize


def parse_chart_documents(docs: DataFrame, text_col="text", id_col="doc_id") -> charts.ParsedCharts:
    """Chart rows of every document in the way its ``format`` asks for.

    ``docs``: id, format, program, hub, text, and for ``pdf`` documents ``grids``, the tables of their pages (their text
    holds what stands outside). All HTML shapes are read in one pass; a document without
    a programme is filed under ``source_name``. A document that no parser reads, or whose parser finds nothing to
    read, gives one drop row, so that documents with rows and documents with drops add up to all documents.
    """
    named = docs.withColumn("program", F.coalesce("program", "source_name") if "source_name" in docs.columns else F.col("program"))
    pages = with_tables(named.where(F.col("format").startswith("html_table")), text_col).drop(text_col)
    pages = materialize(pages.drop("grids"), "pages")  # rows and drops both read them
    tables, program = F.col("tables"), F.col("program")
    shapes = {
        "html_table": charts.long_rows(tables),
        "html_table_wide": charts.wide_rows(tables, program),
        "html_table_destination": charts.destination_rows(tables, program, F.col("hub")),
        "html_table_zone_matrix": charts.zone_matrix_rows(tables, program),
        "html_table_seasonal_zones": charts.seasonal_rows(tables, program),
    }
    rows = F.lit(None).cast(f"array<{charts.ROW_TYPE}>")
    for name, built in shapes.items():
        rows = F.when(F.col("format") == name, built.cast(f"array<{charts.ROW_TYPE}>")).otherwise(rows)
    html = charts.emit(pages, rows, "html", id_col)
    kept, unknown = documents.parse_chart_json(docs.where("format = 'json'"), text_col, id_col)
    feed, _, lost = documents.parse_feed_payloads(docs.where("format = 'rss'"), text_col, id_col)
    drop = lambda rows, parser, ord_: rows.select(id_col, F.lit(parser).alias("parser"), ord_.cast("bigint").alias("band_ord"))
    paper = named.where("format = 'pdf'")
    if "grids" not in docs.columns:
        paper = paper.withColumn("grids", F.lit(None).cast(charts.GRIDS))
    meta = [c for c in ("source_name", "updated_at") if c in docs.columns]
    grids = charts.route_grid_parsers(paper.select(id_col, *meta, "program", "grids", F.col(text_col).alias("page_text")), id_col=id_col)
    drops = drop(unknown, "json", F.col("band_ord")).unionByName(drop(lost, "rss", F.col("item_ord"))).unionByName(grids.dropped)
    extra = kept.unionByName(feed.withColumnRenamed("item_ord", "band_ord"))
    found = html.rows.unionByName(extra.withColumn("band_ord", F.col("band_ord").cast("bigint")), allowMissingColumns=True)
    # written once: which documents are left over is asked of both
    found = materialize(found.unionByName(grids.rows.drop("route"), allowMissingColumns=True), "chart-rows")
    drops = materialize(html.dropped.unionByName(drops), "chart-drops")
    seen = found.select(id_col).unionAll(drops.select(id_col)).distinct()
    # read by nothing, or nothing to read
    silent = docs.select(id_col, F.coalesce("format", F.lit("none")).alias("parser")).join(seen, id_col, "left_anti")
    return charts.ParsedCharts(found, drops.unionByName(silent.withColumn("band_ord", F.lit(0).cast("bigint"))))


def parse_award_documents(docs: DataFrame, text_col="text", id_col="doc_id") -> DataFrame:
    """Live award rows of JSON and feed documents."""
    plain = documents.parse_award_json(docs.where("format = 'json'"), text_col, id_col)
    _, feed, _ = documents.parse_feed_payloads(docs.where("format = 'rss'"), text_col, id_col)
    return plain.unionByName(feed.withColumnRenamed("item_ord", "ord"))


def follow_mail(mails: DataFrame, posts: DataFrame, captions: DataFrame, limit=None, id_col="doc_id") -> DataFrame:
    """Mail and what its links lead to, as documents ready for :func:`claims.run_discovery`.

    ``mails``: id, raw bytes; ``posts``: url, text (HTML or plain), title, published; ``captions``:
    video_id, text (WEBVTT), title, published. A mail gives its own text (intake ``email``) and, for each
    link that is followed, the post or the spoken text behind it, with the mail as origin and the link
    as url. Linked documents are named after the mail and the place of the link; a link to nothing
    fetched gives no row. ``limit`` follows the first so many links of a mail. Mails, links and documents
    are written once each, so that nothing is parsed again by what reads them.
    """
    read = materialize(documents.parse_mail_documents(mails, id_col=id_col), "mails")
    links = documents.classify_links(documents.extract_links(read, "body", id_col), limit, id_col).where("followed")
    links = materialize(links.join(read.select(id_col, F.col("source_name").alias("origin")), id_col), "links")
    name = F.concat_ws(":", F.col(id_col).cast("string"), F.col("ord").cast("string")).alias(id_col)
    own = read.select(
        F.col(id_col).cast("string").alias(id_col), documents.html_to_text(F.col("body")).alias("text"), F.col("subject").alias("title"),
        F.lit("email").alias("intake"), F.col("source_name").alias("origin"), F.lit(None).cast("string").alias("url"), F.col("received_at").alias("published"),
    )
    shown = spread(posts).select("url", documents.html_to_text(F.col("text")).alias("text"), "title", F.col("published").cast("string").alias("published"))
    blog = links.where("kind = 'article'").join(shown, "url").select(name, "text", "title", F.lit("email_link:blog").alias("intake"), "origin", "url", "published")
    spoken = captions.select("video_id", documents.captions_to_text(F.col("text")).alias("text"), "title", F.col("published").cast("string").alias("published"))
    video = links.where("kind = 'video'").join(spoken, "video_id").select(name, "text", "title", F.lit("email_link:yt").alias("intake"), "origin", "url", "published")
    return materialize(own.unionByName(blog).unionByName(video), "followed")
