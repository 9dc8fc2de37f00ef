"""Arrays to rows, where the array is costly to compute.

For a plain generator the optimizer adds a filter that the array is not empty, and pushes it, with
the whole expression or Python call behind it, below the generator: everything is then computed
twice. The outer forms are exempt, so these helpers use them and drop the empty rows afterwards.
"""

from pyspark.sql import DataFrame, functions as F


def inline_rows(df: DataFrame, keep, array, marker) -> DataFrame:
    """One row per struct of ``array``; ``marker`` is a field that is never NULL in a real row."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(marker).isNotNull())


def explode_rows(df: DataFrame, keep, array, pos, name) -> DataFrame:
    """One row per element of ``array`` with its position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
