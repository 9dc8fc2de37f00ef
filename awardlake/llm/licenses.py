"""License scans by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is joined with its places in the templates. A match votes
for the diagonal text place minus template place; a template that stands in the text puts all its
votes on one diagonal, one with words put in or left out on a few diagonals side by side. Diagonals
of a template that are close and do not overlap much are merged into a span, and a span is verified
by the share of the template it covers.
"""

from pyspark.sql import DataFrame, Window, functions as F

from awardlake.llm.common import texts

# Phrases whose every place counts, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Wordings of common notices, with the labels that a span of them adds.
NOTICES = (
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under the mozilla public license version 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-text"),
)

#: Characters between words: all of ASCII that is neither a digit nor a lower-case letter (after lowering).
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Diagonals at most so far apart may belong to one span.
SLACK = 2
#: Share of a template's word pairs that a span must hold.
COVER = 0.75


def _templates(spark, base, notices):
    rows = []
    for number, (phrase, label) in enumerate((*base, *notices)):
        words = phrase.split(" ")
        exact = number < len(base)
        rows += [(number, label, exact, len(words) - 1, i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, pairs int, at int, pair string")


def words_of(text):
    """Words after lowering A-Z alone; ``lower`` may only serve texts that are ASCII throughout."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


def votes(docs: DataFrame, base=BASE, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """Documents by key with their number of words, and all matching word pairs: key, template, place, diagonal.

    The templates are a fixed list of a few hundred word pairs, so they are broadcast.
    """
    plain = texts(docs)
    keyed = plain.select("doc_id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))
    counted = keyed.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    spread = keyed.select("doc_id", "tie", F.posexplode_outer(pairs).alias("place", "pair"))
    known = F.broadcast(_templates(docs.sparkSession, base, notices).withColumn("gram", F.xxhash64("pair")).withColumnRenamed("pair", "wanted"))
    spread = spread.select("doc_id", "tie", "place", "pair", F.xxhash64("pair").alias("gram")).where("pair is not null")
    # the hash finds the place, the words confirm it
    found = spread.join(known, "gram").where("pair = wanted")
    return counted, found.select("doc_id", "tie", "template", "label", "exact", "pairs", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))


def spans(found: DataFrame, slack=SLACK, cover=COVER) -> DataFrame:
    """Verified spans: ``doc_id``, ``tie``, ``template``, ``label``, ``exact``, ``first``, ``last`` (word places), ``score``.

    Base phrases need all their pairs on one diagonal. Other templates may spread over diagonals that
    lie within ``slack`` of the one before and whose places go on from it; a span must hold the first
    and the last pair (there stand version numbers) and the share ``cover`` of all.
    """
    distinct = found.distinct()
    lines = distinct.groupBy("doc_id", "tie", "template", "label", "exact", "pairs", "diagonal").agg(
        F.count("*").alias("hits"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("at").alias("low"), F.max("at").alias("high"),
    )
    exact = lines.where("exact and hits = pairs").select("doc_id", "tie", "template", "label", "exact", "first", (F.col("last") + 1).alias("last"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("doc_id", "tie", "template").orderBy("first", "diagonal")
    before = {c: F.lag(c).over(order) for c in ("diagonal", "high", "last")}
    goes_on = (F.abs(F.col("diagonal") - before["diagonal"]) <= slack) & (F.col("low") > before["high"]) & (F.col("first") - before["last"] <= F.col("pairs"))
    marked = lines.where("not exact").select("*", F.when(goes_on, 0).otherwise(1).alias("new"))
    grouped = marked.select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("span"))
    merged = grouped.groupBy("doc_id", "tie", "template", "label", "exact", "pairs", "span").agg(
        F.sum("hits").alias("hits"), F.min("first").alias("first"), (F.max("last") + 1).alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("pairs") - 1) & (F.col("hits") >= cover * F.col("pairs"))
    loose = merged.where(whole).select(
        "doc_id", "tie", "template", "label", "exact", "first", "last", (F.col("hits") / F.col("pairs")).alias("score"))
    return exact.unionByName(loose)


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` of every document.

    Places are word numbers from 0; first and last are null without a base phrase, labels empty texts
    without any. The score is the best covered share of any template, 0 without spans. Null texts
    are empty. One row per input row: rows that repeat id and text are scanned once and get the same
    result; other columns are ignored.
    """
    counted, found = votes(docs, base, notices)
    every = spans(found)
    labels = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    summed = every.groupBy(F.col("doc_id").alias("of"), F.col("tie").alias("of_tie")).agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        labels(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("score").alias("score"),
    )
    placed = counted.join(summed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left")
    return placed.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
