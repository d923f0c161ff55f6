"""Sinks: versions appended, snapshots and logs as JSON lines, merges that rewrite a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from causalframe.operators.frontier import latest
from causalframe.storage import swap


def append_versions(versions: DataFrame, path: str) -> None:
    """Append immutable versions, partitioned by table, so that a table's fold reads its own files alone."""
    versions.write.mode("append").partitionBy("tbl").parquet(path)


def write_snapshot(frontier: DataFrame, path: str) -> None:
    """Live paths as JSON lines; tombstones are left out. Columns value_type and data (JSON, for lists and sets) are kept.

    The lines are written beside the folder and moved in when they are complete, so a reader finds the old or the new ones.
    """
    live = frontier.where(~F.col("is_tombstone"))
    columns = {c: F.col(c) for c in live.columns}
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    live.select(
        "path", F.col("value"), columns.get("value_type", F.lit("string")).alias("value_type"), columns.get("data", F.lit(None).cast("string")).alias("data"),
        columns.get("expires_at", F.lit(None).cast("timestamp")).alias("expires_at"), F.col("clk").alias("clock"),
    ).write.json(aside)
    swap(frontier.sparkSession, aside, path)


def rewrite_log(log: DataFrame, path: str) -> None:
    """Compaction: a log is written anew with the latest version of each path alone, and moved in when complete."""
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    latest(log).write.json(aside)
    swap(log.sparkSession, aside, path)


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines."""
    (rows.write.mode("overwrite").option("header", True).csv if kind == "csv" else rows.write.mode("overwrite").json)(path)


def write_through(rows: DataFrame, primary, local) -> str:
    """Write rows to the primary first, then locally; an AnalysisException of the primary (a shape that it does not take)
    leaves the local write alone. Returns where the rows went: `both` or `local`. Other errors stop before the local write."""
    from pyspark.errors import AnalysisException

    went = "both"
    try:
        primary(rows)
    except AnalysisException:
        went = "local"
    local(rows)
    return went


def upsert_jdbc(rows: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """Append the newest row of each path to a staging table of a database, from which a view or a merge there takes it.
    Tombstones have a null value. Needs the database's driver on the class path."""
    latest(rows).withColumn("value", F.when(~F.col("is_tombstone"), F.col("value"))).write.jdbc(url, table, mode="append", properties=properties or {})


def write_log(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").json(path)


def merge(current: DataFrame | None, batch: DataFrame, key: str = "path", clock: str = "clk") -> DataFrame:
    """Upsert: the row with the greatest clock of each key; ties as in `latest`."""
    both = batch if current is None else current.unionByName(batch)
    return latest(both, key, clock).select(both.columns)
