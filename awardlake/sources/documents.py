"""Raw documents from files or tables."""

from pyspark.sql import DataFrame, functions as F

# File suffix -> content type.
CONTENT_TYPES = {
    "json": "application/json",
    "html": "text/html",
    "rss": "application/rss+xml",
    "xml": "application/rss+xml",
    "pdf": "application/pdf",
}


def decode_documents(df: DataFrame, raw_col="content", url_col="path") -> DataFrame:
    """(doc_id, url, text, content_type, raw): UTF-8 text, Latin-1 where the bytes are no UTF-8."""
    raw, url = F.col(raw_col), F.col(url_col)
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("text/plain")
    for end, content_type in CONTENT_TYPES.items():
        kind = F.when(suffix == end, content_type).otherwise(kind)
    text = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))
    return df.select(F.xxhash64(url).alias("doc_id"), url.alias("url"), text.alias("text"), kind.alias("content_type"), raw.alias("raw"))


def read_documents(spark, path, fmt="binaryFile", raw_col="content", url_col="path") -> DataFrame:
    """Documents of a folder of files, or of a Parquet table with bytes and a path column."""
    return decode_documents(spark.read.format(fmt).load(path), raw_col, url_col)
