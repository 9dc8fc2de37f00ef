"""Scores, audits and invariants over extraction, verification and verdict tables."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from awardlake import vocab
from awardlake.functions import points
from awardlake.functions.rows import inline_rows
from awardlake.functions.text import digit_runs
from awardlake.operators import verify
from awardlake.sources import sinks

ROW_KEY = ["program", "region_a", "region_b", "cabin", "miles"]


class ExtractionScore(NamedTuple):
    per_doc: DataFrame
    totals: DataFrame
    missed: DataFrame
    extra: DataFrame


def _share(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))


def score_extraction(expected: DataFrame, produced: DataFrame, docs: DataFrame, id_col="doc_id", text_col="text") -> ExtractionScore:
    """Produced rows against expected rows per document: counts, precision, recall, exact-miles rate.

    One aggregation over the union of both sides; a matched row is one whose key both sides hold.
    """
    key, loose = [id_col, *ROW_KEY], [id_col, *ROW_KEY[:-1]]
    side = lambda df, e, p: df.select(*key, F.lit(e).alias("e"), F.lit(p).alias("p"))
    both = side(expected, 1, 0).unionByName(side(produced, 0, 1)).groupBy(*key).agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    runs = docs.select(id_col, digit_runs(F.col(text_col)).alias("_runs"))
    grounded = F.coalesce((F.col("miles") > 0) & F.array_contains("_runs", F.col("miles")), F.lit(False))
    counted = both.join(runs, id_col, "left").groupBy(id_col).agg(
        F.sum("e").alias("expected"), F.sum("p").alias("produced"),
        F.sum(F.when(F.col("e") > 0, F.col("p")).otherwise(0)).alias("matched"),
        F.sum(F.when(~grounded, F.col("p")).otherwise(0)).alias("ungrounded"),
    )
    # Exact-miles rate: of the rows whose other four fields match, how many also match in miles.
    same = both.groupBy(*loose).agg(
        F.max((F.col("e") > 0).cast("int")).alias("le"), F.max((F.col("p") > 0).cast("int")).alias("lp"),
        F.max(((F.col("e") > 0) & (F.col("p") > 0)).cast("int")).alias("exact"),
    ).groupBy(id_col).agg(
        F.sum(F.col("le") * F.col("lp")).alias("located"), F.sum("exact").alias("exact"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    base = docs.select(id_col).join(counted, id_col, "left").join(same, id_col, "left").select(
        id_col, *[zero(c) for c in ("expected", "produced", "matched", "ungrounded", "located", "exact")]
    )
    rates = {
        "precision": _share(F.col("matched"), F.col("produced")), "recall": _share(F.col("matched"), F.col("expected")),
        "exact_miles": _share(F.col("exact"), F.col("located")),
    }
    names = ("expected", "produced", "matched", "ungrounded", "located", "exact")
    totals = base.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in names]).withColumns(rates)
    return ExtractionScore(
        base.withColumns(rates), totals,
        both.where("p = 0").select(*key, F.col("e").alias("copies")), both.where("e = 0").select(*key, F.col("p").alias("copies")),
    )


def extraction_latency(runs: DataFrame, baseline: DataFrame = None) -> DataFrame:
    """Totals over tuning runs (fixture, expected, produced, matched, missed, extra, latency_ms).

    With a baseline, fixtures it solved without a miss or an extra row are left out.
    """
    if baseline is not None:
        solved = baseline.where((F.col("missed") == 0) & (F.col("extra") == 0)).select("fixture")
        runs = runs.join(solved, "fixture", "left_anti")
    totals = runs.agg(
        F.count(F.lit(1)).alias("fixtures"), F.count_if((F.col("missed") > 0) | (F.col("extra") > 0)).alias("misses"),
        F.sum("expected").alias("expected"), F.sum("produced").alias("produced"), F.sum("matched").alias("matched"),
        F.sum("latency_ms").alias("total_ms"), F.avg("latency_ms").alias("mean_ms"),
    )
    return totals.withColumns(
        {"precision": _share(F.col("matched"), F.col("produced")), "recall": _share(F.col("matched"), F.col("expected"))}
    )


def validate_fixtures(fixtures: DataFrame, id_col="doc_id") -> DataFrame:
    """Rule violations of labelled documents (id, idx, field, reason); ``idx`` NULL for the document."""
    programs = sorted(vocab.PROGRAM_ALIASES)
    runs = F.when(F.trim("document") != "", digit_runs(F.col("document")))
    issue = lambda bad, field, reason: F.when(
        bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))
    )
    unknown = lambda c, known: ~F.coalesce(c.isin(*known), F.lit(False))

    def of_row(r, i):
        positive = F.coalesce(r["miles"] > 0, F.lit(False))
        found = F.coalesce(F.array_contains("_runs", r["miles"]), F.lit(False))
        issues = F.array(
            issue(unknown(r["program"], programs), "program", "unknown"),
            issue(unknown(r["region_a"], vocab.REGIONS), "region_a", "unknown"),
            issue(unknown(r["region_b"], vocab.REGIONS), "region_b", "unknown"),
            issue(unknown(r["cabin"], vocab.CABINS), "cabin", "unknown"),
            issue(~positive, "miles", "not positive"),
            issue(positive & ~found, "miles", "not in document"),
        )
        return F.transform(
            F.array_compact(issues), lambda x: F.struct(i.alias("idx"), x["field"].alias("field"), x["reason"].alias("reason"))
        )

    lone = lambda bad, field, reason: F.when(
        bad, F.struct(F.lit(None).cast("int").alias("idx"), F.lit(field).alias("field"), F.lit(reason).alias("reason"))
    )
    blank = F.coalesce(F.trim("document"), F.lit("")) == ""
    whole = F.array_compact(F.array(lone(blank, "document", "empty"), lone(F.col("expected_rows").isNull(), "expected_rows", "missing")))
    prepared = fixtures.select(id_col, "document", "expected_rows", runs.alias("_runs"))
    rows = F.flatten(F.transform(F.coalesce("expected_rows", F.array().cast(fixtures.schema["expected_rows"].dataType)), of_row))
    return inline_rows(prepared, [id_col], F.concat(whole, rows), "field")


def audit_verdicts(verdicts: DataFrame, options: DataFrame, awards: DataFrame, provenance: DataFrame, ratios: DataFrame, requests: DataFrame, fares: DataFrame) -> DataFrame:
    """Violations (rule, key, detail) of the honesty invariants; empty when all is well.

    Several rules read each table, so what they need of it is written once.
    """
    group = ["route_key", "program"]
    needed = {
        "verdicts": (verdicts, ["request_id", "label", "flags"]), "options": (options, ["request_id", "kind", "label", "program", "confidence"]),
        "awards": (awards, [*group, "cabin", "miles"]), "provenance": (provenance, [*group, "source_name"]),
    }
    verdicts, options, awards, provenance = (sinks.materialize(df.select(*columns), name) for name, (df, columns) in needed.items())
    none = lambda: F.lit(None).cast("string")
    row = lambda df, rule, key, detail: df.select(F.lit(rule).alias("rule"), key.alias("key"), detail.alias("detail"))
    award_key = F.concat_ws("/", *group)
    warned = F.exists("flags", lambda f: f.isin(*vocab.WARNING_FLAGS) | f.startswith("sources_disagree"))
    asked = requests.select("request_id", "route_key", "currency")
    moved = options.where("kind = 'transfer'").join(asked, "request_id")
    reach = ratios.select(F.col("from_currency").alias("currency"), F.col("to_program").alias("program"))
    fare_conf = fares.select("route_key", F.col("confidence").alias("_fare"))
    option_key = F.concat_ws("/", F.col("request_id").cast("string"), "label")
    return reduce(
        DataFrame.unionByName,
        [
            row(awards.join(provenance, group, "left_anti"), "award without provenance", award_key, none()),
            row(
                provenance.where(F.coalesce("source_name", F.lit("")).isin("", "unknown")),
                "unsourced datum", award_key, none(),
            ),
            row(
                awards.where(~points.within_bounds(F.col("cabin"), F.col("miles"))),
                "award out of bounds", award_key, F.col("miles").cast("string"),
            ),
            row(
                verdicts.where((F.col("label") == "best") & warned), "best with a warning flag",
                F.col("request_id").cast("string"), F.array_join("flags", "|"),
            ),
            row(moved.join(reach, ["currency", "program"], "left_anti"), "unreachable programme", option_key, F.col("program")),
            row(
                options.join(asked.select("request_id", "route_key"), "request_id").join(fare_conf, "route_key")
                .where(F.col("confidence") > F.col("_fare") + 1e-9),
                "option surer than its fare", option_key, F.col("confidence").cast("string"),
            ),
        ],
    )


def golden_cases(cases: DataFrame, verdicts: DataFrame, awards: DataFrame) -> DataFrame:
    """Checks per case: label among the expected, live seats present, best rate high enough.

    ``cases``: request_id, name, route_key, expect array, expect_live_space, min_winner_cpp.
    """
    live = awards.where(F.col("seats") > 0).select("route_key").distinct().withColumn("_live", F.lit(True))
    joined = cases.join(verdicts.select("request_id", "label", "best_cpp"), "request_id", "left").join(live, "route_key", "left")
    label = F.coalesce("label", F.lit("no_verdict"))
    concluded = ~label.isin("no_fare", "no_verdict")
    check = lambda name, ok, when: F.when(when, F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")))
    checks = F.array(
        check("label expected", F.array_contains("expect", label), F.lit(True)),
        check("live seats", F.col("_live"), concluded & F.col("expect_live_space")),
        check("best rate", F.col("best_cpp") >= F.col("min_winner_cpp"), concluded & F.col("min_winner_cpp").isNotNull()),
    )
    return joined.select("request_id", "name", label.alias("label"), F.inline(F.array_compact(checks)))


def poison_check(quotes: DataFrame, now, half_life_days=vocab.HALF_LIFE_DAYS, stale_after_days=vocab.STALE_AFTER_DAYS) -> DataFrame:
    """Run planted quotes (``plant``, ``expect`` columns) through verification and judge each plant.

    Expectations: ``rejected`` (its value must not survive), ``flagged_stale`` (only with the flag),
    ``survives_clean`` (the verified value is its own).
    """
    verified = verify.verify_awards(quotes.drop("plant", "expect"), now, half_life_days, stale_after_days).select(
        "route_key", "program", F.col("miles").alias("_miles"), F.col("flags").alias("_flags")
    )
    judged = quotes.where(F.col("plant").isNotNull()).join(verified, ["route_key", "program"], "left")
    same = F.coalesce(F.col("_miles") == F.col("miles"), F.lit(False))
    ok = (
        F.when(F.col("expect") == "rejected", ~same)
        .when(F.col("expect") == "flagged_stale", F.coalesce(F.array_contains("_flags", "stale"), F.lit(False)))
        .otherwise(same)
    )
    return judged.select("route_key", "program", "plant", "expect", F.col("_miles").alias("verified_miles"), ok.alias("ok"))
