"""Schema of the rows an extractor backend proposes."""

PROPOSED_ROWS = "program string, `from` string, `to` string, cabin string, miles string, roundtrip boolean"
