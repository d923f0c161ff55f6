"""Values as text, numbers from text, shapes of container values, ids of stream entries, sizes in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes that a version takes beside its path, and beside each kind of value.
BASE_BYTES, VALUE_BYTES, OTHER_BYTES = 220, {"string": 16, "bytes": 24}, 16


def integer_text(value: Column) -> Column:
    return value.cast("long").cast("string")


def float_text(value: Column) -> Column:
    """The shortest digits that give the number back, without an exponent and without a point where none is needed."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(value.cast("string"), r"\.0$", "")
    exponent = F.contains(value.cast("string"), F.lit("E"))
    return F.when(exponent, plain).otherwise(short)


def truth_text(value: Column) -> Column:
    return F.when(value, "1").when(~value, "0")


def parse_integer(text: Column) -> Column:
    """A whole number of 64 bits with a sign or none, white space around it; null for anything else."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long"))


def shape(kind: Column) -> Column:
    """What a value looks like by its kind: lists and streams are lists; hashes, sets and sorted sets are hashes."""
    return F.when(kind.isNull(), "none").when(kind.isin("list", "stream"), "list").when(kind.isin("hash", "set", "zset"), "hash").otherwise("string")


def is_set_record(record: Column) -> Column:
    """Whether a record (map of text) is a set: not empty, and every value stands for true."""
    return (F.size(record) > 0) & F.forall(F.map_values(record), lambda v: v == "1")


def is_scored_record(record: Column) -> Column:
    """Whether a record (map of text) is a sorted set: not empty, and every value is a number."""
    return (F.size(record) > 0) & F.forall(F.map_values(record), lambda v: v.try_cast("double").isNotNull())


def value_bytes(path: Column, value: Column, kind: Column) -> Column:
    """Bytes in memory of a version: of strings and bytes by their length, of other kinds a fixed number."""
    text = F.coalesce(F.octet_length(value), F.lit(0))
    own = F.when(kind == "string", text + VALUE_BYTES["string"]).when(kind == "bytes", text + VALUE_BYTES["bytes"]).otherwise(OTHER_BYTES)
    return (F.octet_length(path) + own + BASE_BYTES).cast("long")


def entry_ids(adds: DataFrame) -> DataFrame:
    """Stream additions (key, ord, at, asked) with ms and seq: `*` gives the moment in milliseconds and 0, `ms-seq` itself;
    corrupt ids give nothing. Ids are not made to ascend."""
    parts = F.split("asked", "-")
    ms = F.when(F.col("asked") == "*", F.unix_millis("at")).otherwise(F.get(parts, 0).try_cast("long"))
    seq = F.when(F.col("asked") == "*", F.lit(0)).otherwise(F.get(parts, 1).try_cast("long"))
    return adds.withColumn("ms", ms).withColumn("seq", seq).where(F.col("ms").isNotNull() & F.col("seq").isNotNull())


def added_members(adds: DataFrame) -> DataFrame:
    """How many members each addition (key, ord, member) to a set or sorted set brings anew: (key, ord, added)."""
    w = Window.partitionBy("key", "member").orderBy("ord")
    first = adds.withColumn("_new", F.row_number().over(w) == 1)
    return first.groupBy("key", "ord").agg(F.count(F.when(F.col("_new"), 1)).alias("added"))
