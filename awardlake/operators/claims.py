"""Prose -> price claims, and the intake that turns them into discovered rows.

Each number mention is cut out of its text together with the 220 characters before and the 80
after its start; all rules then read that short window. Whole texts are
scanned, no text is shuffled, and nothing runs in Python.
"""

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from awardlake import vocab
from awardlake.functions import labels
from awardlake.functions.rows import inline_rows
from awardlake.functions.text import collapse_space, digit_runs, number_is_grounded
from awardlake.operators.documents import html_to_text
from awardlake.schemas import PROPOSED_ROWS
from awardlake.vocab import ANY_NUMBER, BEFORE, BONUS, CLAUSE, NEAR_KEYWORD, ROUND_TRIP, TAIL

#: Least characters of a number that counts.
SHORTEST = 4
CLAIM_KEY = ["program", "region_a", "region_b", "cabin", "miles"]


def _any_of(phrases):
    return "|".join(re.escape(p) for p in phrases)


def _value(digits):
    return F.regexp_replace(digits, "[^0-9]", "").try_cast("bigint")


def _pieces(text, pattern):
    """A text cut at the hits of a pattern: array of (gap, hit, miles), the text behind the last hit as a piece without one."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    placed = F.zip_with(hits, values, lambda h, v: F.struct(h.alias("hit"), _value(v).alias("miles")))
    return F.zip_with(F.split(text, pattern), placed, lambda gap, p: F.struct(
        gap.alias("gap"), F.coalesce(p["hit"], F.lit("")).alias("hit"), p["miles"].alias("miles")))


def _plausible(mentions):
    return F.filter(mentions, lambda m: m["miles"].between(vocab.MIN_PROSE_MILES, vocab.MAX_PROSE_MILES))


def _running_ends(widths, block=256):
    """Running sums of a column of numbers, in blocks: appending to a short array only ever copies a block."""
    grown = lambda a, w: F.struct((a["end"] + w).alias("end"), F.array_append(a["ends"], a["end"] + w).alias("ends"))
    sums = lambda start, values: F.aggregate(
        values, F.struct(start.alias("end"), F.array().cast("array<bigint>").alias("ends")), grown, lambda a: a["ends"])
    zero, count = F.lit(0).cast("bigint"), F.ceil(F.size(widths) / block).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(F.col(widths), (i - 1) * block + 1, F.lit(block))))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, w: a + w))
    starts = F.concat(F.array(zero), sums(zero, totals))
    return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), count), lambda b, s: sums(s, b)))


def prepared_text(docs: DataFrame, text_col="text", keep=("doc_id",)) -> DataFrame:
    """Visible text of each document with single blanks, as ``prose``."""
    return docs.select(*keep, collapse_space(html_to_text(F.col(text_col))).alias("prose"))


def _cut(docs, text_col, id_col):
    """Pieces of each prepared text: at numbers with a unit word, or at any price-like number where it has no plausible one."""
    # digits are looked for in the raw text: the test then runs before the parser, not after it
    text = prepared_text(docs.where(F.col(text_col).rlike(r"\d")), text_col, [id_col])
    near = text.withColumn("near", _pieces(F.col("prose"), NEAR_KEYWORD))
    any_number = F.when(F.size(_plausible(F.col("near"))) == 0, _pieces(F.col("prose"), ANY_NUMBER))
    return near.select(id_col, F.coalesce(any_number, F.col("near")).alias("pieces"))


def find_price_mentions(docs: DataFrame, text_col="text", id_col="doc_id") -> DataFrame:
    """Numbers with a unit word; only where a document has none, any price-like number. Time grows with the text."""
    # what lambdas refer to is a column first, so that it is computed once and not for every element
    widths = F.transform("pieces", lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("bigint"))
    cut = _cut(docs, text_col, id_col).select(id_col, "pieces", widths.alias("widths"))
    placed = F.zip_with("pieces", _running_ends("widths"), lambda p, end: F.struct(
        (end - F.length(p["hit"])).cast("int").alias("pos"), p["miles"].alias("miles")))
    return inline_rows(cut, [id_col], _plausible(placed), "pos")


def _windows(cut, id_col):
    """(id, around): array of struct<before, tail, miles>, the text around each plausible hit of the pieces.

    A window is put together from the pieces next to its hit. A hit has ``SHORTEST`` characters or more, so
    few pieces reach into a window, and no window is looked for from the start of the text.
    """
    last, first = lambda p: F.right(p["gap"], F.lit(BEFORE)), lambda p: F.substring(p["gap"], 1, TAIL)
    sides = cut.select(
        id_col, F.transform("pieces", lambda p: F.struct(last(p).alias("last"), p["hit"].alias("hit"), p["miles"].alias("miles"))).alias("hits"),
        F.transform("pieces", lambda p: F.concat(last(p), p["hit"])).alias("behind"),
        F.transform("pieces", lambda p: F.concat(first(p), p["hit"])).alias("ahead"))
    back, far = BEFORE // SHORTEST + 1, TAIL // SHORTEST + 1

    def around(p, i):
        earlier = F.array_join(F.slice(F.col("behind"), F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), "")
        later = F.array_join(F.slice(F.col("ahead"), i + 2, F.lit(far)), "")
        return F.struct(
            F.right(F.concat(earlier, p["last"]), F.lit(BEFORE)).alias("before"),
            F.substring(F.concat(p["hit"], later), 1, TAIL).alias("tail"), p["miles"].alias("miles"))

    return sides.select(id_col, _plausible(F.transform("hits", around)).alias("around"))


def _cabin_near(clause, local):
    """Cabin whose first mention lies nearest to the number."""
    shapes = {
        "premium_economy": "premium economy", "business": "business", "first": "first",
        "economy": "(?<!premium )economy|coach",
    }
    at = lambda p: F.regexp_instr(clause, F.lit(p)) - 1
    hits = [
        F.when(at(p) >= 0, F.struct(F.abs(at(p) - local).alias("gap"), at(p).alias("pos"), F.lit(c).alias("cabin")))
        for c, p in shapes.items()
    ]
    return F.array_min(F.array_compact(F.array(*hits)))["cabin"]


def extract_price_claims(docs: DataFrame, text_col="text", id_col="doc_id", word_boundary=False) -> DataFrame:
    """Award price claims (id, claim_ord, program, regions, cabin, miles, roundtrip), each literally in its text."""
    bound = r"\b" if word_boundary else ""
    names = bound + f"({_any_of(p for p, _ in vocab.phrase_pairs(vocab.PROGRAM_ALIASES))})" + bound
    places = f"({_any_of(p for p, _ in vocab.phrase_pairs(vocab.PROSE_REGIONS))})"
    program_of = dict(vocab.phrase_pairs(vocab.PROGRAM_ALIASES))
    region_of = dict(vocab.phrase_pairs(vocab.PROSE_REGIONS))
    cut = _windows(_cut(docs, text_col, id_col), id_col)

    # Each step binds its result as a lambda variable, so no regular expression runs twice.
    def located(m, i):
        before, tail = F.lower(m["before"]), F.lower(m["tail"])
        nearby = F.concat(F.substring(m["before"], -40, 40), F.substring(m["tail"], 1, 20))
        last_name = F.when(before.rlike(names), F.length(F.regexp_extract(before, f"^(.*){names}", 1)))
        next_name = F.nullif(F.regexp_instr(tail, F.lit(names)), F.lit(0)) - 1
        return F.struct(
            i.alias("claim_ord"), m["miles"].alias("miles"), m["before"].alias("before"), m["tail"].alias("tail"),
            nearby.rlike(BONUS).alias("reward"), last_name.alias("last_name"),
            F.when(last_name.isNull() & (next_name <= 40), next_name).alias("next_name"),
        )

    def clause_of(m):
        ahead = F.concat(F.substring(m["before"], m["last_name"] + 1, F.lit(BEFORE)), F.substring(m["tail"], 1, CLAUSE))
        behind = F.substring(m["tail"], m["next_name"] + 1, F.greatest(F.lit(CLAUSE) - m["next_name"], F.lit(0)))
        clause = F.coalesce(ahead, behind)
        return F.struct(
            m["claim_ord"].alias("claim_ord"), m["miles"].alias("miles"), clause.alias("clause"), F.lower(clause).alias("low"),
            F.coalesce(F.length(m["before"]) - m["last_name"], -m["next_name"]).alias("local"),
        )

    def read(c):
        regions = F.array_distinct(
            F.transform(F.regexp_extract_all(c["low"], F.lit(places), F.lit(1)), lambda p: labels.lookup(region_of, p))
        )
        return F.struct(
            c["claim_ord"].alias("claim_ord"), c["miles"].alias("miles"), c["clause"].alias("clause"),
            labels.lookup(program_of, F.regexp_extract(c["low"], names, 1)).alias("program"),
            _cabin_near(c["low"], c["local"]).alias("cabin"), regions.alias("regions"),
            c["clause"].rlike(ROUND_TRIP).alias("roundtrip"),
        )

    anchored = F.filter(
        F.transform("around", located),
        lambda m: ~m["reward"] & (m["last_name"].isNotNull() | m["next_name"].isNotNull()),
    )
    whole = F.filter(
        F.transform(F.transform(anchored, clause_of), read),
        lambda r: r["program"].isNotNull() & r["cabin"].isNotNull() & (F.size(r["regions"]) > 0)
        & number_is_grounded(r["miles"], r["clause"]),
    )
    rows = inline_rows(cut, [id_col], whole, "claim_ord")
    first, second = F.try_element_at("regions", F.lit(1)), F.try_element_at("regions", F.lit(2))
    claims = rows.select(
        id_col, "claim_ord", "program",
        F.when(second.isNotNull(), first).otherwise("north_america").alias("region_a"),
        F.coalesce(second, first).alias("region_b"), "cabin", "miles", "roundtrip",
    )
    return dedupe_claims(claims, id_col)


def dedupe_claims(claims: DataFrame, id_col="doc_id") -> DataFrame:
    """One row per document and claim; the last mention decides whether it is a round trip."""
    return claims.groupBy(id_col, *CLAIM_KEY).agg(
        F.max_by("roundtrip", "claim_ord").alias("roundtrip"), F.min("claim_ord").alias("claim_ord")
    )


def ground_rows(raw_rows: DataFrame, docs: DataFrame, text_col="text", id_col="doc_id"):
    """(kept chart rows, rejected rows with reason) of rows some extractor proposed.

    Only the numbers of a document travel to the join, not its text.
    """
    runs = docs.select(id_col, digit_runs(F.col(text_col)).alias("_runs"))
    whole = F.col("miles").cast("string").rlike(r"^\s*[+-]?\d+\s*$")
    checked = raw_rows.join(runs, id_col, "left").select(
        id_col, F.col("program").alias("raw_program"), labels.canonicalize_program(F.col("program")).alias("program"),
        F.lower(F.trim("cabin")).alias("cabin"),
        F.when(whole, F.trim(F.col("miles").cast("string")).try_cast("bigint")).alias("miles"),
        labels.canonicalize_region(F.col("from")).alias("region_a"), labels.canonicalize_region(F.col("to")).alias("region_b"),
        F.coalesce("roundtrip", F.lit(False)).alias("roundtrip"), "_runs",
    )
    grounded = F.coalesce((F.col("miles") > 0) & F.array_contains("_runs", F.col("miles")), F.lit(False))
    reason = (
        F.when(F.col("program").isNull(), "program")
        .when(~F.coalesce(F.col("cabin").isin(*vocab.CABINS), F.lit(False)), "cabin")
        .when(F.col("miles").isNull(), "miles").when(~grounded, "ungrounded")
        .when(F.col("region_a").isNull() | F.col("region_b").isNull(), "region")
    )
    judged = checked.withColumn("reason", reason).drop("_runs")
    return judged.where("reason IS NULL").drop("reason", "raw_program"), judged.where("reason IS NOT NULL")


def run_extractor(docs: DataFrame, extractor, text_col="text", id_col="doc_id", hint_col=None):
    """(kept, rejected) rows of any extractor backend; its output always passes :func:`ground_rows`.

    ``extractor`` maps an iterator of pandas batches (id, text, source_hint) to one of proposed rows: the
    id and the columns of ``schemas.PROPOSED_ROWS``. ``hint_col`` names where a document comes from.
    """
    hint = F.col(hint_col).cast("string") if hint_col else F.lit(None).cast("string")
    given = docs.select(id_col, F.col(text_col).alias("text"), hint.alias("source_hint"))
    proposed = given.mapInPandas(extractor, f"`{id_col}` {dict(given.dtypes)[id_col]}, {PROPOSED_ROWS}")
    return ground_rows(proposed, docs, text_col, id_col)


def devaluation_program(title):
    """Programme an announcement of changed prices names, or NULL (Column -> Column)."""
    low = F.lower(title)
    has = lambda parts: low.rlike(_any_of(parts))
    named = F.coalesce(*[F.when(has(a), p) for p, a in vocab.ANNOUNCEMENT_PROGRAMS.items()])
    return F.when(has(vocab.ANNOUNCEMENT_TRIGGERS), named)


def detect_devaluations(docs: DataFrame, title_col="title", id_col="doc_id") -> DataFrame:
    """(id, program) of documents whose title announces changed prices."""
    return docs.select(id_col, devaluation_program(F.col(title_col)).alias("program")).where("program IS NOT NULL")


def stale_programs(detected: DataFrame) -> DataFrame:
    return detected.select("program").distinct()


def attach_discovery_provenance(claims: DataFrame, docs: DataFrame, creators: DataFrame = None, id_col="doc_id") -> DataFrame:
    """Discovered rows with source, url, date and second-class trust.

    ``docs``: id, intake (email, blog, yt, email_link:blog, email_link:yt), origin (source name of
    the mail, or creator), url, published.
    """
    meta = docs.select(id_col, "intake", "origin", F.col("url").alias("source_url"), F.col("published").alias("source_updated_at"))
    own = F.lit(None).cast("double")
    if creators is not None:
        meta = meta.join(
            creators.select(F.col("name").alias("origin"), F.col("trust").alias("_trust")), "origin", "left"
        )
        own = F.col("_trust")
    trust = (
        F.when(F.col("intake").startswith("email_link"), F.lit(0.28)).when(F.col("intake") == "email", F.lit(0.3))
        .otherwise(F.least(F.coalesce(own, F.lit(0.45)), F.lit(0.3)))
    )
    source = F.when(F.col("intake") == "email", F.col("origin")).otherwise(F.concat_ws(":", "intake", "origin"))
    # both sides grow with the documents, and what Spark estimates from the size of their files is far too little
    return claims.hint("merge").join(
        meta.select(id_col, source.alias("source_name"), "source_url", "source_updated_at", trust.alias("trust")), id_col
    )


class Discovery(NamedTuple):
    rows: DataFrame
    stale: DataFrame
    counts: DataFrame


def run_discovery(mail: DataFrame, posts: DataFrame, transcripts: DataFrame, creators: DataFrame = None) -> Discovery:
    """All intakes to discovered rows, stale programmes and row counts per intake.

    Each input: doc_id, text, title, intake, origin, url, published.
    """
    docs = reduce(lambda a, b: a.unionByName(b), [mail, posts, transcripts])
    rows = attach_discovery_provenance(extract_price_claims(docs), docs, creators)
    counts = rows.groupBy(F.split_part("source_name", F.lit(":"), F.lit(1)).alias("intake")).agg(F.count(F.lit(1)).alias("rows"))
    return Discovery(rows, stale_programs(detect_devaluations(docs)), counts)


def new_items_only(entries: DataFrame, seen: DataFrame, as_of, limit=None, ttl_days=30, feed="feed", key="url", order="entry_ord") -> DataFrame:
    """Entries of each feed that were not processed within the TTL; with ``limit`` the first so many of these.

    The seen test comes first, so an entry beyond a limit comes back on the next run. ``seen``: feed, key, seen_at.
    """
    since = F.lit(str(as_of)).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days))
    new = entries.join(seen.where(F.col("seen_at") > since).select(feed, key), [feed, key], "left_anti")
    if limit is None:
        return new
    place = F.row_number().over(Window.partitionBy(feed).orderBy(order))
    return new.withColumn("_rn", place).where(F.col("_rn") <= limit).drop("_rn")
