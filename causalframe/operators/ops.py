"""Operations on whole states: shadow diff, percentiles, ring, memory, eviction, metrics, order checks."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalframe.storage import written


def shadow_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source paths (path, value) with what the target has: `match`, `missing` or `different`."""
    other = target.select("path", F.col("value").alias("target_value"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("value").eqNullSafe(F.col("target_value")), "match").otherwise("different")
    return source.join(other, "path", "left").select("path", "value", "target_value", state.alias("state"))


def match_rate(diff: DataFrame) -> DataFrame:
    wrong = F.sum(F.when(F.col("state") != "match", 1).otherwise(0))
    n = F.count("*")
    return diff.agg(n.alias("checked"), F.coalesce(wrong, F.lit(0)).alias("mismatched"), F.when(n == 0, 100.0).otherwise((n - wrong) * 100.0 / n).alias("rate"))


def floor_percentiles(rows: DataFrame, key: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """The value at index floor(p / 100 * (n - 1)) of each key's sorted values.

    Values are counted first, so that what is sorted in a window is a key's distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(value)
    summed = counted.select(key, value, F.sum("_n").over(w).alias("_upto"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    at = [F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1) / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return summed.groupBy(key).agg(*at)


def ring_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ring(nodes: list[str], virtual: int = 128) -> list[tuple[int, str]]:
    """The sorted points of a consistent-hash ring: `virtual` for each node."""
    return sorted((int(hashlib.md5(f"{n}#vn#{i}".encode()).hexdigest()[:15], 16), n) for n in nodes for i in range(virtual))


def without_node(points: list[tuple[int, str]], node: str) -> list[tuple[int, str]]:
    """The ring after a node has left; keys of the other nodes stay where they are."""
    return [p for p in points if p[1] != node]


def first_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` rows in order of a key: a report's cap, taken after the sort."""
    return rows.orderBy(key).limit(most)


def route(key: Column, points: list[tuple[int, str]], bits: int = 10) -> Column:
    """The node of the first point at or after a key's hash, else of the first point at all.

    A literal table by the hash's top bits holds the points of that arc and the one after it, so a key looks at a few.
    """
    shift, hashes = 60 - bits, [h for h, _ in points]
    arcs = []
    for arc in range(1 << bits):
        lo, hi = bisect.bisect_left(hashes, arc << shift), bisect.bisect_left(hashes, (arc + 1) << shift)
        arcs.append([*points[lo:hi], (1 << 62, points[hi % len(points)][1])])
    text = ";".join(",".join(f"{h}={n}" for h, n in arc) for arc in arcs)
    h = ring_hash(key)
    mine = F.split(F.get(F.split(F.lit(text), ";"), F.shiftright(h, shift).cast("int")), ",")
    return F.substring_index(F.get(F.filter(mine, lambda x: F.substring_index(x, "=", 1).cast("long") >= h), F.lit(0)), "=", -1)


def atom_bytes(path: Column, value: Column) -> Column:
    """Estimated memory of a string version."""
    return (F.lit(220) + F.octet_length(path) + F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def kept_within(rows: DataFrame, size: str, newest_first: str, limit: int) -> DataFrame:
    """The newest rows whose sizes add up to at most `limit`: least-recently-used eviction, without one task for all rows.

    Sizes are first summed for each value of the order column and those sums by ranges of it; prefix sums over the
    ranges then give each range its start.
    """
    sums = rows.groupBy(newest_first).agg(F.sum(size).alias("_s"))
    dealt = sums.repartitionByRange(F.col(newest_first).desc()).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # the range of a row must be the same in both uses
    starts = dealt.groupBy("_part").agg(F.sum("_s").alias("_t")).withColumn("_base", F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_part").orderBy(F.col(newest_first).desc())
    upto = dealt.join(F.broadcast(starts.select("_part", "_base")), "_part").withColumn("upto", F.sum("_s").over(w) + F.coalesce("_base", F.lit(0)))
    return rows.join(upto.where(F.col("upto") <= limit).select(newest_first, "upto"), newest_first)


def latency_buckets(rows: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts by upper bound, in one aggregate."""
    counts = rows.agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long").alias(f"b{i}") for i, b in enumerate(bounds)])
    stack = ", ".join(f"double({b}), b{i}" for i, b in enumerate(bounds))
    return counts.select(F.expr(f"stack({len(bounds)}, {stack}) as (le, n)"))


def capped_labels(rows: DataFrame, label: str, clock: str, value: str, most: int) -> DataFrame:
    """The last value of each label; labels beyond the first `most` by first appearance share `_other`.

    The number of labels is small or capped right away: the ranking is over one row a label.
    """
    first = rows.groupBy(label).agg(F.min(clock).alias("_first"))
    named = first.orderBy("_first", label).limit(most).select(label, F.lit(True).alias("_own"))
    return rows.join(named, label, "left").withColumn("label", F.when(F.col("_own"), F.col(label)).otherwise("_other")).groupBy("label").agg(F.max_by(value, clock).alias("value"))


def order_violations(reads: DataFrame, key: str, reader_clock: str, position: str) -> DataFrame:
    """Reads whose position is below an earlier one's."""
    w = Window.partitionBy(key).orderBy(reader_clock).rowsBetween(Window.unboundedPreceding, -1)
    return reads.withColumn("_before", F.max(position).over(w)).where(F.col(position) < F.col("_before")).drop("_before")
