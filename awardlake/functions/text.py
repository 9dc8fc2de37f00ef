"""Column expressions over running text."""

from pyspark.sql import Column, functions as F

from awardlake.functions.points import half_even

SHORT_FORM = r"(\d+(?:\.\d+)?)\s*[kK](?![\p{L}\p{N}_])"
GROUPED_NUMBER = r"\d{1,3}(?:[,\s\p{Z}]\d{3})+|\d+"


def digit_runs(text: Column) -> Column:
    """Distinct integers literally written in a text, as array<bigint>.

    Thousands may be grouped by comma or space; ``45k`` and ``1.5k`` count as thousands.
    """
    short = F.transform(
        F.regexp_extract_all(text, F.lit(SHORT_FORM), F.lit(1)),
        lambda s: half_even(s.try_cast("double") * 1000, 0).try_cast("bigint"),
    )
    plain = F.transform(
        F.regexp_extract_all(text, F.lit(GROUPED_NUMBER), F.lit(0)),
        lambda s: F.regexp_replace(s, "[^0-9]", "").try_cast("bigint"),
    )
    return F.array_distinct(F.array_compact(F.concat(short, plain)))


def number_is_grounded(miles: Column, text: Column) -> Column:
    """True when a positive number literally occurs in the text."""
    return F.coalesce((miles > 0) & F.array_contains(digit_runs(text), miles), F.lit(False))


def looks_undecoded(text: Column) -> Column:
    """True when under 85 % of the characters are printable."""
    kept = F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^\r\n\t ]]", ""))
    # Plain ASCII text, the common case, is settled by a cheap test.
    odd = ~text.rlike(r"^[\x20-\x7e\r\n\t]*+$")
    return F.coalesce(odd & (kept / F.length(text) < 0.85), F.lit(False))


def collapse_space(text: Column) -> Column:
    """Every run of white space one blank, none at the ends; single blanks are not even matched."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]", " "))
