"""The frontier fold as a stream: each micro-batch is merged by clock; out-of-order and repeated changes make no difference."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from causalframe.operators.frontier import apply_changes, latest
from causalframe.storage import delete


class FrontierStore:
    """A frontier as Parquet, one folder for each version, partitioned by hash buckets of the path.

    A batch rewrites the buckets that it touches and then adds their version to the manifest; the others stay. That commits
    it: a repeated batch is left out, and a store that is opened again goes on from the manifest, with the number of
    buckets that it began with. Choose that number by the frontier's size, some 100 MB a bucket. What a batch replaces is
    deleted with the next but one, so that readers of the last version can end.

    With `echo_guard` (the changes need commit_ts) a change that is older than the resident version by commit time, or
    has its content, is not taken.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, echo_guard: bool = False):
        self.spark, self.path, self.echo_guard = spark, path.rstrip("/"), echo_guard
        jvm = spark.sparkContext._jvm
        manifest = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        there = manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(manifest)
        rows = spark.read.parquet(f"{self.path}/manifest").groupBy("bucket", "buckets").agg(F.max("v").alias("v")).collect() if there else []
        self.current: dict[int, int] = {r["bucket"]: r["v"] for r in rows}  # a row for each bucket
        self.buckets = rows[0]["buckets"] if rows else buckets
        self.replaced: list[str] = []

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/v={version}/bucket={bucket}"

    def read(self, buckets=None) -> DataFrame | None:
        found = [self._folder(v, b) for b, v in sorted(self.current.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*found) if found else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        newest = latest(batch).persist()
        touched = {r[0] for r in newest.select(bucket).distinct().collect()}
        if not touched or batch_id <= max(self.current.values(), default=-1):  # the manifest has it: a repeated batch
            newest.unpersist()
            return
        old = self.read(touched)
        fresh = apply_changes(old, newest).select(newest.columns) if self.echo_guard and old is not None else newest
        both = fresh if old is None else fresh.unionByName(old.select(newest.columns))
        latest(both).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={batch_id}")
        self.spark.createDataFrame([(b, self.buckets) for b in sorted(touched)], "bucket int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch_id}")
        for folder in self.replaced:
            delete(self.spark, folder)
        self.replaced = [self._folder(v, b) for b, v in self.current.items() if b in touched]
        self.current |= {b: batch_id for b in touched}
        newest.unpersist()


def fold_stream(changes: DataFrame, store: FrontierStore, checkpoint: str):
    """Run a stream of changes into a store until what is available now has been read."""
    query = changes.writeStream.foreachBatch(lambda df, batch_id: store.merge(df, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def expire_stream(changes: DataFrame, delay: str) -> DataFrame:
    """How many versions expire in each hour, by the day of their commit: (committed, hour, n).

    Event time is the commit time; the deadline is data, so a far one cannot make a near one late. In append mode a day's
    counts appear when the watermark has passed it; changes committed more than `delay` before the latest are late.
    """
    due = changes.where("expires_at is not null").withWatermark("commit_ts", delay)
    return due.groupBy(F.window("commit_ts", "1 day").alias("committed"), F.date_trunc("hour", "expires_at").alias("hour")).agg(F.count("*").alias("n"))


class LagListener(StreamingQueryListener):
    """Keeps the last progress of each query: rows in, rows a second, and when; -1 before any, -2 after a failure."""

    def __init__(self):
        self.state: dict[str, int] = {}
        self.last_ok: dict[str, dt.datetime] = {}

    def onQueryStarted(self, event):
        self.state[str(event.id)] = -1

    def onQueryProgress(self, event):
        progress = event.progress
        self.state[str(progress.id)] = int(progress.numInputRows)
        self.last_ok[str(progress.id)] = dt.datetime.now(dt.timezone.utc)

    def onQueryIdle(self, event):
        self.last_ok[str(event.id)] = dt.datetime.now(dt.timezone.utc)

    def onQueryTerminated(self, event):
        if event.exception:
            self.state[str(event.id)] = -2
