"""Python functions over texts of any length, in bounded memory and on all tasks.

Spark hands a Python function up to 10 000 rows at once; of whole documents that is far too much. Here a
batch ends at so many bytes, and results leave Python in small slices.
"""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes and rows of an Arrow batch (session settings that are only ever lowered); rows computed and handed back at once.
BATCH_BYTES, BATCH_ROWS, SLICE = 4 << 20, 1024, 64
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}


def small_batches(spark) -> None:
    for setting, most in SETTINGS.items():
        if not 0 < int(spark.conf.get(setting).rstrip("b")) <= most:
            spark.conf.set(setting, most)


def by_value(function, arrow_type, spark_type):
    """Column function that calls ``function`` on each value; ``arrow_type`` and ``spark_type`` name the same type."""
    small_batches(SparkSession.active())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            for start in range(0, len(array), SLICE):
                yield pa.array([function(x) for x in array.slice(start, SLICE).to_pylist()], arrow_type)

    run.__name__ = function.__name__  # what plans show
    return F.arrow_udf(run, spark_type)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has, before a step that costs much more than it reads.

    Files hold many small rows in one split; the number is given, so that the tasks are not put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
