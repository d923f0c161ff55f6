"""Writing commands with their replies, transactions, sweeps of expired paths, guards on append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalframe.operators.frontier import latest

#: Reply texts of the commands.
OK, BAD_EXPIRE = "OK", "ERR invalid expire time"


def run_commands(commands: DataFrame) -> DataFrame:
    """Commands (ord, at, path, cmd, value, amount) with `reply`, each path's commands in order of ord.

    SET, SETEX (seconds), PSETEX (milliseconds), DEL, GET, EXISTS, TTL, PTTL, EXPIRE, PEXPIRE and PERSIST. SET takes a
    deadline away. A path whose deadline has come is missing until it is set again. TTL and PTTL give -2 for a missing path
    and -1 without deadline. DEL replies 1 for any path written before, deleted or not, unless it has expired. SETEX,
    PSETEX and PEXPIRE refuse amounts that are not positive; EXPIRE replies 0. Other commands reply null.

    All windows have one partitioning and order, so a path is sorted once and streamed, never held.
    """
    cmd, at = F.col("cmd"), F.unix_micros("at")
    positive = F.coalesce(F.col("amount") > 0, F.lit(False))
    micros = F.col("amount") * F.when(cmd.isin("PSETEX", "PEXPIRE", "PTTL"), 1000).otherwise(1_000_000)
    timed = cmd.isin("SETEX", "PSETEX")
    sets = (cmd == "SET") | (timed & positive)
    before = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # a run begins with each write; within it only the deadline changes: 0 stands for none
    starts = sets | (cmd == "DEL")
    deadline = F.when(timed & positive, at + micros).when(sets | (cmd == "PERSIST"), 0).when(cmd.isin("EXPIRE", "PEXPIRE") & positive, at + micros)
    marked = commands.withColumn("_starts", starts).withColumn("_deadline", deadline)
    marked = marked.withColumn("_run", F.sum(F.when(F.col("_starts"), 1).otherwise(0)).over(upto) - F.when(F.col("_starts"), 1).otherwise(0))
    in_run = Window.partitionBy("path", "_run").orderBy("ord")
    state = marked.withColumn("_last", F.last(F.when(F.col("_starts"), F.struct((cmd != "DEL").alias("live"), F.col("value").alias("value"))), True).over(before))
    state = state.withColumn("_due", F.last("_deadline", True).over(before)).withColumn("_due", F.when(F.col("_due") > 0, F.col("_due")))
    passed = F.coalesce(F.col("_due") <= at, F.lit(False))
    state = state.withColumn("_dead", F.max(passed).over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    written = F.col("_last").isNotNull() & ~F.col("_dead")
    live = written & F.col("_last.live")
    left = F.col("_due") - at

    def bit(c: Column) -> Column:
        return F.when(c, "1").otherwise("0")

    reply = (
        F.when(timed & ~positive | (cmd == "PEXPIRE") & ~positive, BAD_EXPIRE).when(sets, OK).when(cmd == "GET", F.when(live, F.col("_last.value")))
        .when(cmd == "DEL", bit(written)).when(cmd == "EXISTS", bit(live)).when(cmd.isin("EXPIRE", "PEXPIRE"), bit(live & positive)).when(cmd == "PERSIST", bit(live & F.col("_due").isNotNull()))
        .when(cmd.isin("TTL", "PTTL"), F.when(~live, "-2").when(F.col("_due").isNull(), "-1").otherwise(F.floor(left / F.when(cmd == "TTL", 1_000_000).otherwise(1000)).cast("string")))
    )
    return state.select(*commands.columns, reply.alias("reply"))


def transactions(replies: DataFrame, txn: str) -> DataFrame:
    """The replies of each transaction in order, errors in their places; a transaction's replies are one value."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("reply", F.lit("(nil)")).alias("reply"))))
    return replies.groupBy(txn).agg(F.transform(ordered, lambda r: r["reply"]).alias("replies"))


def append(frontier: DataFrame, versions: DataFrame, guarded: bool = True) -> DataFrame:
    """The frontier after an append. Guarded: an older clock than the resident one loses, and a version with the resident
    content and deadline keeps the resident clock. Unguarded: the newest of the appended versions stands."""
    newest = latest(versions)
    columns = [c for c in newest.columns if c != "path"]
    old, new = [d.select("path", F.struct(*columns).alias(name)) for d, name in ((frontier, "_old"), (newest, "_new"))]
    both = old.join(new, "path", "full_outer")
    same = F.lit(True)
    for c in ("value", "is_tombstone", "expires_at"):
        if c in columns:
            same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    keep = F.col("_new").isNull() | (F.col("_old").isNotNull() & ((F.col("_old.clk") > F.col("_new.clk")) | same) if guarded else F.lit(False))
    return both.select("path", F.when(keep, F.col("_old")).otherwise(F.col("_new")).alias("_r")).select("path", *[F.col(f"_r.{c}").alias(c) for c in columns])


def sweep(frontier: DataFrame, as_of: Column, clk: Column) -> DataFrame:
    """Tombstones for the live paths whose deadline lies before as_of."""
    due = frontier.where(~F.col("is_tombstone") & (F.col("expires_at") < as_of))
    return due.select("path", clk.cast("long").alias("clk"), F.lit(True).alias("is_tombstone"), F.lit(None).cast("string").alias("value"))
