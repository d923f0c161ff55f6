"""Fold of versions to the frontier: the latest version of each path, as of a clock or a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalframe.functions.paths import version_id


def latest(changes: DataFrame, key: str = "path", clock: str = "clk") -> DataFrame:
    """The version with the greatest clock of each path, tombstones included; of versions with one clock the one with the
    greatest hash over its columns, whatever the order of the input.

    One aggregate with a partial one before the shuffle: a path with a third of all changes costs one row a task.
    """
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(clock), F.xxhash64(*rest))).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def live(frontier: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Paths that are neither deleted nor, if as_of is given, expired: a deadline before as_of hides, one at as_of does not."""
    kept = frontier.where(~F.col("is_tombstone"))
    return kept if as_of is None else kept.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def history(changes: DataFrame) -> DataFrame:
    """Versions with the clock of their parent, their depth and their id."""
    w = Window.partitionBy("path").orderBy("clk")
    return changes.select(
        "*", F.lag("clk").over(w).alias("parent_clk"), (F.row_number().over(w) - 1).cast("long").alias("depth"), version_id(F.col("path"), F.col("clk"), F.col("value")).alias("version_id")
    )


def without_repeats(changes: DataFrame, compared: tuple[str, ...] = ("value", "is_tombstone")) -> DataFrame:
    """Versions that differ from the one before on their path in any compared column; a changed deadline is a change if compared."""
    w = Window.partitionBy("path").orderBy("clk")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return changes.withColumn("_keep", F.lag("clk").over(w).isNull() | ~same).where("_keep").drop("_keep")


def apply_changes(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that a resident frontier takes: committed no earlier than the resident version and with another content."""
    have = frontier.select("path", F.col("commit_ts").alias("_ts"), F.col("value").alias("_value"), F.col("is_tombstone").alias("_gone"))
    joined = changes.join(have, "path", "left")
    fresh = F.col("_ts").isNull() | ((F.col("_ts") <= F.col("commit_ts")) & ~(F.col("value").eqNullSafe(F.col("_value")) & F.col("is_tombstone").eqNullSafe(F.col("_gone"))))
    return joined.where(fresh).drop("_ts", "_value", "_gone")


def ttl_seconds(expires_at: Column, as_of: Column) -> Column:
    """-1 without deadline, else the whole seconds left."""
    micros = F.unix_micros(expires_at) - F.unix_micros(as_of)
    return F.when(expires_at.isNull(), F.lit(-1)).otherwise(F.floor(micros / 1_000_000)).cast("long")


def read_through(local: DataFrame, primary: DataFrame, as_of: Column, stale_after: str = "30 seconds") -> DataFrame:
    """Primary keys with the local value where it is fresh, else the primary's; `origin` tells which."""
    mine = local.select("path", F.col("value").alias("_local"), F.col("commit_ts").alias("_ts"))
    fresh = F.col("_local").isNotNull() & (F.col("_ts") >= as_of - F.expr(f"interval {stale_after}"))
    return primary.join(mine, "path", "left").select("path", F.when(fresh, F.col("_local")).otherwise(F.col("value")).alias("value"), F.when(fresh, "local").otherwise("primary").alias("origin"))


def get_many(frontier_live: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (ord, path) in order with their value, null where there is none."""
    return requests.join(frontier_live.select("path", "value"), "path", "left")


def count_existing(frontier_live: DataFrame, requests: DataFrame) -> DataFrame:
    """How many requested paths exist; a path asked for twice counts twice."""
    return requests.join(frontier_live.select("path"), "path", "left_semi").agg(F.count("*").alias("n"))


def flush(frontier: DataFrame, clk: int) -> DataFrame:
    """Tombstones for every path."""
    return frontier.select("path", F.lit(clk).cast("long").alias("clk"), F.lit(True).alias("is_tombstone"), F.lit(None).cast("string").alias("value"))


def expire(frontier_live: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Deadline requests (ord, path, seconds; null seconds take the deadline away) with their reply and the new deadline.

    1 if the deadline was set, or taken away where there was one; 0 for a missing path, and for seconds that are not
    positive, which leave the path as it is.
    """
    have = frontier_live.select("path", F.col("expires_at").alias("_old"), F.lit(True).alias("_there"))
    joined = requests.join(have, "path", "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    set_ = there & (F.col("seconds") > 0)
    taken = there & F.col("seconds").isNull() & F.col("_old").isNotNull()
    deadline = F.when(set_, F.timestamp_micros(F.unix_micros(as_of) + F.col("seconds") * 1_000_000)).when(~taken, F.col("_old"))
    reply = F.when(F.coalesce(set_, F.lit(False)) | taken, 1).otherwise(0)
    return joined.select("ord", "path", reply.alias("reply"), F.when(there, deadline).alias("expires_at"))
