"""Strings, counters, lists, sets, sorted sets, hashes and streams as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


# strings and counters
def running_total(ops: DataFrame, key: str, clock: str, delta: str) -> DataFrame:
    """Counter replies: the total after each operation. Overflow raises, it does not wrap."""
    return ops.withColumn("total", F.sum(delta).over(Window.partitionBy(key).orderBy(clock)))


def counter_with_sets(ops: DataFrame) -> DataFrame:
    """Counters whose log (key, clk, op, n) mixes `set` and `add`: the value after each operation.

    The number of sets so far numbers a key's runs; within a run the value is the sum.
    """
    w = Window.partitionBy("key").orderBy("clk")
    runs = ops.withColumn("_run", F.sum(F.when(F.col("op") == "set", 1).otherwise(0)).over(w))
    return runs.withColumn("total", F.sum("n").over(Window.partitionBy("key", "_run").orderBy("clk"))).drop("_run")


def counter_totals(ops: DataFrame, key: str, delta: str) -> DataFrame:
    return ops.groupBy(key).agg(F.sum(delta).alias("total"))


def previous_value(changes: DataFrame) -> DataFrame:
    return changes.withColumn("previous", F.lag("value").over(Window.partitionBy("path").orderBy("clk")))


def first_writer(changes: DataFrame) -> DataFrame:
    """The first written value of each path."""
    return changes.where(~F.col("is_tombstone")).groupBy("path").agg(F.min_by("value", "clk").alias("value"), F.min("clk").alias("clk"))


def appended(pieces: DataFrame, key: str, clock: str, value: str) -> DataFrame:
    """Each key's pieces joined in clock order, with the length in bytes. The result of a key is one value, as long as its pieces."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(clock, value))), lambda x: x[value]), "")
    return pieces.groupBy(key).agg(joined.alias("value")).withColumn("n_bytes", F.octet_length("value").cast("long"))


# lists
def normalised(index: int, size: Column) -> Column:
    """An index from the left, or if negative from the right, as a position from 0."""
    return F.lit(index).cast("long") if index >= 0 else size + index


def from_end(items: DataFrame) -> DataFrame:
    """Items with `back`, their position from the right, 0 for the last one. A limit on it reaches the planner, which keeps
    as many rows of each key before the shuffle."""
    w = Window.partitionBy("key").orderBy(F.col("pos").desc())
    return items.withColumn("back", (F.row_number().over(w) - 1).cast("long"))


def list_range(items: DataFrame, start: int, stop: int) -> DataFrame:
    """Items (key, pos, v) between two indices, both included; negative ones count from the right."""
    if start < 0 and stop < 0:
        return from_end(items).where((F.col("back") <= -1 - start) & (F.col("back") >= -1 - stop)).drop("back")
    if start >= 0 and stop >= 0:
        return items.where(F.col("pos").between(start, stop))
    size = items.groupBy("key").agg(F.count("*").alias("_n"))
    low = F.greatest(normalised(start, F.col("_n")), F.lit(0))
    return items.join(size, "key").where((F.col("pos") >= low) & (F.col("pos") <= normalised(stop, F.col("_n")))).drop("_n")


def list_index(items: DataFrame, index: int) -> DataFrame:
    return list_range(items, index, index)


def list_pop(items: DataFrame, count: int, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped in pop order, what stays) of every list; from the right the last item comes first."""
    ranked = from_end(items).withColumnRenamed("back", "ord") if right else items.withColumn("ord", F.col("pos"))
    return ranked.where(F.col("ord") < count), ranked.where(F.col("ord") >= count).drop("ord")


def list_positions(pushes: DataFrame, key: str, clock: str, value: str, left: str | None = None) -> DataFrame:
    """Pushes to items (key, pos, v): right pushes in clock order after left pushes in reverse order."""
    side = F.when(F.col(left), -F.col(clock)).otherwise(F.col(clock)) if left else F.col(clock)
    first = F.col(left).cast("int") if left else F.lit(0)
    w = Window.partitionBy(key).orderBy(first.desc(), side)
    return pushes.select(F.col(key).alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col(value).alias("v"))


# sets
def set_add(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the set after, how many members of each key were new)."""
    new = new.select("key", "member").distinct()
    fresh = new.join(members, ["key", "member"], "left_anti")
    return members.select("key", "member").union(fresh), fresh.groupBy("key").agg(F.count("*").alias("added"))


def set_remove(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti")


def is_member(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (key, member) with 1 or 0."""
    have = members.select("key", "member").distinct().withColumn("_have", F.lit(1))
    return asked.join(have, ["key", "member"], "left").select(*asked.columns, F.coalesce("_have", F.lit(0)).alias("is_member"))


# sorted sets
def scores(adds: DataFrame) -> DataFrame:
    """Adds (key, clk, member, score) to the last score of each member."""
    return adds.groupBy("key", "member").agg(F.max_by("score", "clk").alias("score"))


def rank_range(zset: DataFrame, start: int, stop: int) -> DataFrame:
    """Members by (score, member) between two ranks from 0, both included; negative ranks count from the end."""
    w = Window.partitionBy("key").orderBy("score", "member")
    ranked = zset.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    if start >= 0 and stop >= 0:  # the planner keeps only the first stop + 1 of each key before the shuffle
        return ranked.where((F.col("rank") >= start) & (F.col("rank") <= stop))
    if start < 0 and stop < 0:
        back = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("member").desc())
        last = zset.withColumn("_back", (F.row_number().over(back) - 1).cast("long")).where(F.col("_back") <= -1 - start)
        size = zset.groupBy("key").agg(F.count("*").alias("_n"))
        return last.where(F.col("_back") >= -1 - stop).join(size, "key").withColumn("rank", F.col("_n") - 1 - F.col("_back")).drop("_back", "_n")
    size = zset.groupBy("key").agg(F.count("*").alias("_n"))
    low = F.greatest(normalised(start, F.col("_n")), F.lit(0))
    return ranked.join(size, "key").where((F.col("rank") >= low) & (F.col("rank") <= normalised(stop, F.col("_n")))).drop("_n")


# hashes: paths key:field
def hash_fields(frontier_live: DataFrame) -> DataFrame:
    """Live paths split at the last colon: (key, field, value)."""
    key = F.regexp_extract("path", r"^(.*):[^:]*$", 1)
    return frontier_live.where(F.contains(F.col("path"), F.lit(":"))).select(key.alias("key"), F.substring_index("path", ":", -1).alias("field"), "value")


# streams
def stream_id(text: Column) -> Column:
    """`ms-seq` as a struct; null if it is not an id. A bare number has seq 0."""
    ms = F.try_to_number(F.split_part(text, F.lit("-"), F.lit(1)), F.lit("9" * 19)).cast("long")
    seq = F.when(F.contains(text, F.lit("-")), F.try_to_number(F.split_part(text, F.lit("-"), F.lit(2)), F.lit("9" * 19)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(text.rlike(r"^\d{1,18}(-\d{1,18})?$"), F.struct(ms.alias("ms"), seq.alias("seq")))


def stream_range(entries: DataFrame, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> DataFrame:
    """Entries (key, ms, seq, ...) with ids between two bounds, both included; None is open. Ordered by (ms, seq) by the caller."""
    at = F.struct("ms", "seq")

    def bound(x):
        return F.struct(F.lit(x[0]).cast("long").alias("ms"), F.lit(x[1]).cast("long").alias("seq"))

    out = entries if low is None else entries.where(at >= bound(low))
    return out if high is None else out.where(at <= bound(high))


# keys
def keys(frontier_live: DataFrame, hash_keys: DataFrame | None = None) -> DataFrame:
    """Distinct keys; a path whose parent is tagged as a hash shows as its parent."""
    if hash_keys is None:
        return frontier_live.select(F.col("path").alias("key")).distinct()
    parent = F.regexp_extract("path", r"^(.*):[^:]*$", 1)
    tagged = hash_keys.select(F.col("key").alias("_p"), F.lit(True).alias("_h")).distinct()
    return frontier_live.withColumn("_p", parent).join(tagged, "_p", "left").select(F.when(F.col("_h"), F.col("_p")).otherwise(F.col("path")).alias("key")).distinct()


def scan_page(all_keys: DataFrame, after: str | None, count: int = 100) -> DataFrame:
    """The next `count` keys in byte order after a cursor key."""
    rest = all_keys if after is None else all_keys.where(F.col("key") > after)
    return rest.orderBy("key").limit(count)


def key_types(writes: DataFrame) -> DataFrame:
    """Writes (key, clk, kind): the first writer's kind, and how many later writes of another kind are refused as WRONGTYPE."""
    first = writes.groupBy("key").agg(F.min_by("kind", "clk").alias("type"))
    return writes.join(first, "key").groupBy("key", "type").agg(F.sum(F.when(F.col("kind") != F.col("type"), 1).otherwise(0)).alias("wrong"))
