"""Registry of runnable queries, each with the SQL text that must give the same rows.

Input views are written once in SQL both engines read: ``@table`` is a driver table and
``@@view`` another view. Spark reads them as DataFrames, the SQL oracle as nested queries.
"""

import re

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}
VIEWS = {}

NOW_SQL = "timestamp '2000-01-01 00:00:00'"
NOW = "2000-01-01T00:00:00Z"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def view(name, sql):
    VIEWS[name] = sql.strip()


def expand(sql, table):
    """Replace @@view by its text and @table by ``table(name)``."""
    while "@@" in sql:
        sql = re.sub(r"@@(\w+)", lambda m: f"({VIEWS[m.group(1)]})", sql)
    return re.sub(r"@(" + "|".join(TABLES) + r")\b", lambda m: table(m.group(1)), sql)


class Data:
    """Driver tables and views of one scale-factor directory as DataFrames."""

    _named = {}

    def __init__(self, spark, sf_dir):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def _table_name(self, name):
        """Name of a temporary view over one table; its schema is read once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in self._named:
            self._named[key] = f"awardlake_{name}_{len(self._named)}"
            self.spark.read.parquet(f"{self.dir}/{name}.parquet").createOrReplaceTempView(self._named[key])
        return self._named[key]

    def table(self, name):
        return self.spark.table(self._table_name(name))

    def sql(self, text):
        return self.spark.sql(expand(text, self._table_name))

    def view(self, name):
        return self.sql(f"SELECT * FROM @@{name} v")


def query(name, sql=None):
    """Register ``fn(data) -> DataFrame`` with its oracle SQL (over @tables and @@views)."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(flags):
    """Flags as one text, sorted, so that both engines hash the same value."""
    return F.array_join(F.array_sort(flags), "|")


def r6(value):
    """Six decimals the way both engines can agree on: scale, round, unscale (values >= 0)."""
    return F.floor(value.cast("double") * 1e6 + 0.5) / 1e6


def sql_values(rows, columns):
    """A constant table usable in both engines."""
    def lit(x):
        return "NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x))
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(columns)}))"
