"""Stored tables: discovery dataset, run history, keyed upserts, snapshots."""

import os
import tempfile

from pyspark.sql import DataFrame, Window, functions as F


def shared_dir(spark) -> str:
    """Folder every executor can reach, as the cluster names it; a temporary one in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="awardlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark, path) -> bool:
    """Whether anything is stored at a path of any file system Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark, path) -> None:
    """Delete whatever is stored at a path, if anything is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_table_path(spark, name) -> str:
    """A fresh path for one written table in the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name="table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key, name="table", buckets=None) -> DataFrame:
    """Write a table to the shared folder in sorted buckets of ``key``: joins and groups by the key then need no shuffle of it.

    ``buckets`` are as many as the session has shuffle partitions, unless given.
    """
    import uuid

    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"awardlake_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", new_table_path(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def write_discovered(rows: DataFrame, stale_programs: DataFrame, path, updated_at) -> None:
    """Replace the discovery dataset: rows, stale programmes, time of the write.

    Rows may come from the very dataset that is replaced, so both tables are written beside the
    old ones under a new version first, and the small ``current`` table names the version.
    """
    import uuid

    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/version={version}")
    stale_programs.select("program").distinct().write.parquet(f"{path}/stale_programs/version={version}")
    spark.createDataFrame([(version, str(updated_at))], "version string, updated_at string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/current")


def read_discovered(spark, path):
    """The current (rows, stale programmes) of a discovery dataset."""
    version = spark.read.parquet(f"{path}/current").first()["version"]
    return (
        spark.read.parquet(f"{path}/rows/version={version}"),
        spark.read.parquet(f"{path}/stale_programs/version={version}"),
    )


def append_history(verdicts: DataFrame, awards: DataFrame, path, created_at) -> None:
    """Append one batch of runs and verified edges, partitioned by day."""
    at = F.lit(str(created_at)).cast("timestamp")
    stamp = {"created_at": at, "day": F.to_date(at)}
    verdicts.withColumns(stamp).write.mode("append").partitionBy("day").parquet(f"{path}/runs")
    awards.withColumns(stamp).write.mode("append").partitionBy("day").parquet(f"{path}/edges")


def upsert_latest(base: DataFrame, changes: DataFrame, keys, order_col) -> DataFrame:
    """Keyed upsert, last write wins; a change beats a stored row of the same time."""
    rest = [c for c in base.columns if c not in keys]
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.select(base.columns).withColumn("_new", F.lit(1)))
    last = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(order_col, "_new", F.xxhash64(*rest))).alias("r")
    )
    return last.select(*keys, "r.*").select(base.columns)


class BucketedTable:
    """A keyed table in buckets of its key; an upsert rewrites only the buckets that it touches.

    ``data/version=V/bucket=B`` holds a bucket as version V wrote it; ``manifest/version=V`` says for every bucket
    which version counts, and is written last. Repeating a version starts from the manifest before it and
    overwrites, so it is harmless. The previous manifest and what it refers to stay for readers that have
    just begun; anything older is removed. Versions must grow; they need not be dense.
    """

    def __init__(self, spark, path, keys, buckets=16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> dict:
        """version: {bucket: version of its data}; two versions of at most ``buckets`` rows."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return {}
        found = {}
        schema = "bucket int, data long, version long"
        for row in self.spark.read.schema(schema).parquet(f"{self.path}/manifest").collect():
            found.setdefault(row["version"], {})[row["bucket"]] = row["data"]
        return found

    def _read(self, places, buckets=None):
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(places.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The table as the newest manifest has it; None before the first upsert."""
        manifests = self._manifests()
        return self._read(manifests[max(manifests)]) if manifests else None

    def upsert(self, changes: DataFrame, order_col, version) -> None:
        """Keyed upsert of one version, last write wins."""
        manifests = self._manifests()
        before = {v: m for v, m in manifests.items() if v < version}
        places = dict(before[max(before)]) if before else {}
        changes = materialize(changes.withColumn("bucket", self._bucket()), "changes")
        touched = {r["bucket"] for r in changes.select("bucket").distinct().collect()}
        base = self._read(places, touched)
        changes = changes.drop("bucket")
        merged = upsert_latest(changes.limit(0) if base is None else base, changes, self.keys, order_col)
        if touched:
            merged.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        places |= dict.fromkeys(touched, version)
        rows = self.spark.createDataFrame(sorted(places.items()), "bucket int, data long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._clean(before, places, version)

    def _clean(self, before, places, version):
        """Remove manifests older than the one before this version, and data that neither refers to."""
        previous = max(before, default=None)
        needed = {*places.items(), *(before[previous].items() if before else ())}
        gone = {(b, v) for m in before.values() for b, v in m.items()} - needed
        for bucket, data in gone:
            remove(self.spark, f"{self.path}/data/version={data}/bucket={bucket}")
        for data in {v for _, v in gone} - {v for _, v in needed}:
            remove(self.spark, f"{self.path}/data/version={data}")
        for old in before:
            if old != previous:
                remove(self.spark, f"{self.path}/manifest/version={old}")


def increment_counters(base: DataFrame, changes: DataFrame, keys, counter) -> DataFrame:
    """Add counted changes to stored counters."""
    cols = [*keys, counter]
    return base.select(cols).unionByName(changes.select(cols)).groupBy(*keys).agg(F.sum(counter).alias(counter))


def delete_keys(base: DataFrame, gone: DataFrame, keys) -> DataFrame:
    """Rows whose key is not among ``gone``."""
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def snapshot_latest_and_history(snapshots: DataFrame, as_of, keep_days, ts="completed_at"):
    """(latest snapshot, last snapshot of each of the past ``keep_days`` days)."""
    rest = F.struct(*snapshots.columns)
    order = F.struct(ts, F.xxhash64(*snapshots.columns))
    latest = snapshots.agg(F.max_by(rest, order).alias("s")).where(F.col("s").isNotNull()).select("s.*")
    day = F.to_date(ts)
    today = F.lit(str(as_of)[:10]).cast("date")
    history = (
        snapshots.where((day > F.date_sub(today, keep_days)) & (day <= today))
        .groupBy(day.alias("day")).agg(F.max_by(rest, order).alias("s")).select("day", "s.*")
    )
    return latest, history


def recent_by_key(df: DataFrame, key, order_col, n, tie_cols=()) -> DataFrame:
    """Latest ``n`` rows per key; Spark prunes to n per task before it shuffles."""
    w = Window.partitionBy(key).orderBy(F.desc(order_col), *[F.desc(c) for c in tie_cols])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
