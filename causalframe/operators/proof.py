"""Composites: cold composition, version vectors, changed paths, dirty closure, incremental recomputation, Merkle roots.

Edges are by path, not by content hash, so that a full recomputation and an incremental one always agree.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from causalframe.storage import written


def resolve(edges: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Edges (parent, child) with the child's current value and clock; children that are gone are left out."""
    return edges.join(frontier_live.select(F.col("path").alias("child"), "value", "clk"), "child")


def compose(edges: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Each parent's record as a digest of its sorted `child=value` fields, and the number of fields.

    A record is one value: a group is as large as the record. Wide aggregates over many rows are sums, not records.
    """
    fields = F.array_sort(F.collect_list(F.concat_ws("=", "child", "value")))
    return resolve(edges, frontier_live).groupBy("parent").agg(F.count("*").alias("n_fields"), F.sha2(F.array_join(fields, ";"), 256).alias("record"))


def records(edges: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Each parent's record itself: a map of its children's current values. A map is one value, as large as the record."""
    pairs = F.array_sort(F.collect_list(F.struct("child", "value")))
    return resolve(edges, frontier_live).groupBy("parent").agg(F.map_from_entries(pairs).alias("record"))


def field(record: Column, name) -> Column:
    """A record's field; null if it is absent."""
    return F.try_element_at(record, name if isinstance(name, Column) else F.lit(name))


def unwrapped(record: Column) -> Column:
    """The value of a record of a single field, else the record as JSON."""
    return F.when(F.size(record) == 1, F.get(F.map_values(record), 0)).otherwise(F.to_json(record))


def compose_levels(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Composites of composites: (parent, n_fields, record, level). A composite stands in its parent by its record's digest.

    A level is one more than that of the highest child; leaves (path, value, clk) have 0. Children that are neither live
    leaves nor composites are left out, and so is what has no child left. Each round composes what has no open child; the
    height of the graph bounds the rounds. Nodes on a cycle, and what stands above them, get no row.
    """
    values = leaves.select("path", "value", "clk")
    open_ = written(edges.select("parent", "child").distinct(), "edges")
    found = []
    for level in itertools.count(1):
        inner = open_.select(F.col("parent").alias("child")).distinct()
        waiting = open_.join(inner, "child", "left_semi").select("parent").distinct()
        ready = open_.join(waiting, "parent", "left_anti")
        # composites of this level, and those of whose children none is there, which count as missing from now on
        made = written(compose(ready, values).withColumn("level", F.lit(level)), "level")
        rest = written(open_.join(waiting, "parent", "left_semi"), "edges")
        found.append(made)
        if made.isEmpty() and rest.count() == open_.count():
            break
        values = values.union(made.select(F.col("parent").alias("path"), F.col("record").alias("value"), F.lit(0).cast("long").alias("clk")))
        open_ = rest
        if open_.isEmpty():
            break
    return functools.reduce(DataFrame.union, found)


def recompute_levels(results: DataFrame, edges: DataFrame, changed: DataFrame, leaves: DataFrame) -> DataFrame:
    """compose_levels after changes of leaves (node): only ancestors of changed leaves are made again, by ascending level.

    The edges are those that the results were made from.
    """
    dirty = written(dirty_closure(edges, changed).select(F.col("node").alias("parent")).join(results.select("parent", "level"), "parent"), "dirty")
    clean = results.join(dirty, "parent", "left_anti").select("parent", "n_fields", "record", "level")
    values = leaves.select("path", "value", "clk").union(clean.select("parent", "record", F.lit(0).cast("long")))
    for r in sorted(dirty.select("level").distinct().collect()):
        parents = dirty.where(F.col("level") == r["level"])
        made = written(compose(edges.join(parents, "parent", "left_semi").distinct(), values).withColumn("level", F.lit(r["level"])), "level")
        values = values.union(made.select("parent", "record", F.lit(0).cast("long")))
        clean = clean.union(made)
    return clean


def version_vector(edges: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """(parent, child, clk) of what a composition saw."""
    return resolve(edges, frontier_live).select("parent", "child", "clk")


def changed_paths(vector: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Entries of a version vector whose path now has another version or none."""
    now = frontier_live.select(F.col("path").alias("child"), F.col("clk").alias("_now"))
    return vector.join(now, "child", "left").where(~F.col("clk").eqNullSafe(F.col("_now"))).select("parent", "child", "clk", F.col("_now").alias("now_clk"))


def verify(vector: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Whether each parent's whole version vector still holds."""
    now = frontier_live.select(F.col("path").alias("child"), F.col("clk").alias("_now"))
    same = F.coalesce(F.col("clk") == F.col("_now"), F.lit(False))
    return vector.join(now, "child", "left").groupBy("parent").agg(F.bool_and(same).alias("valid"), F.sum(F.when(same, 1).otherwise(0)).alias("hits"), F.sum(F.when(same, 0).otherwise(1)).alias("changed"))


def recompute(results: DataFrame, vector: DataFrame, edges: DataFrame, frontier_live: DataFrame) -> DataFrame:
    """Results after changes: only parents with a changed path, or with changed edges, are composed again."""
    moved = edges.select("parent", "child").exceptAll(vector.select("parent", "child")).select("parent")
    dirty = changed_paths(vector, frontier_live).select("parent").union(moved).distinct()
    again = compose(edges.join(dirty, "parent", "left_semi"), frontier_live)
    return results.join(dirty, "parent", "left_anti").select("parent", "n_fields", "record").union(again)


def dirty_closure(edges: DataFrame, changed: DataFrame, most_levels: int | None = None) -> DataFrame:
    """All ancestors of the changed nodes: (node, level), level being the least number of edges.

    A breadth-first search by levels: each joins the newly reached nodes alone; the depth of the graph bounds the rounds.
    With `most_levels` a graph that goes further up raises.
    """
    edges = written(edges.select("parent", "child"), "edges")  # worked out once, not at each level
    reached = written(changed.select("node").distinct(), "closure")
    seen, found = reached, []
    for level in itertools.count(1):
        above = reached.join(edges, reached["node"] == edges["child"]).select(F.col("parent").alias("node")).distinct()
        reached = written(above.join(seen, "node", "left_anti"), "closure")
        if reached.isEmpty():
            break
        if most_levels is not None and level > most_levels:
            raise ValueError(f"ancestors beyond {most_levels} levels")
        seen = seen.union(reached)
        found.append(reached.withColumn("level", F.lit(level)))
    return functools.reduce(DataFrame.union, found) if found else reached.withColumn("level", F.lit(0))


def update(edges: DataFrame, frontier: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of the results that a batch of changes (path, value, clk) makes anew: (parent, n_fields, record).

    Only the parents of changed paths are looked at: their edges and children's values come from the stored tables
    `edges` (parent, child) and `frontier` (path, value, clk), to which semi-joins with the small side are pushed.
    """
    dirty = edges.join(changed.select(F.col("path").alias("child")).distinct(), "child", "left_semi").select("parent").distinct()
    mine = written(edges.join(dirty, "parent", "left_semi"), "update")
    old = frontier.select("path", "value", "clk").join(mine.select(F.col("child").alias("path")), "path", "left_semi").join(changed.select("path"), "path", "left_anti")
    return compose(mine, old.union(changed.select("path", "value", "clk")))


def merkle_roots(leaves: DataFrame, bits: int = 10) -> DataFrame:
    """Leaves (key, pos from 0, hash) to (key, root): SHA-256 over pairs level by level, an odd last one goes up as it is.

    Runs of 2^bits neighbours are folded in one aggregate, so there is a shuffle for each `bits` levels, and no task holds
    more than a run of a key at a time.
    """
    level = leaves.select("key", F.col("pos").cast("long").alias("pos"), "hash")
    width = (leaves.agg(F.max("pos").alias("m")).first()["m"] or 0) + 1

    def fold(hashes: Column) -> Column:
        """Pairs up to the root; a pass over an array of one changes nothing."""
        def up(x: Column, _: Column) -> Column:
            pair = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / 2).cast("int") - 1), lambda i: F.when(
                F.get(x, 2 * i + 1).isNull(), F.get(x, 2 * i)).otherwise(F.sha2(F.concat(F.get(x, 2 * i), F.get(x, 2 * i + 1)), 256)))
            return F.when(F.size(x) > 1, pair).otherwise(x)

        return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(bits)), hashes, up), 0)

    while width > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        level = level.groupBy("key", F.shiftright("pos", bits).alias("_run")).agg(F.transform(run, lambda s: s["hash"]).alias("_hashes")).select("key", F.col("_run").alias("pos"), fold(F.col("_hashes")).alias("hash"))
        width = (width + (1 << bits) - 1) >> bits
    return level.select("key", F.col("hash").alias("root"))


def merkle_root_for(frontier: DataFrame, requests: DataFrame) -> DataFrame:
    """Roots over the version hashes of requested paths (key, path), sorted by hash; a missing path has the hash of zeros."""
    found = requests.join(frontier.select("path", "hash"), "path", "left").select("key", F.coalesce("hash", F.lit("0" * 64)).alias("hash"))
    w = Window.partitionBy("key").orderBy("hash")
    return merkle_roots(found.select("key", (F.row_number().over(w) - 1).alias("pos"), "hash"))


def proof_root(vector: DataFrame) -> DataFrame:
    """A digest of each proof's version vector (parent, child, hash): SHA-256 over the hashes in order of path. Any changed,
    added or missing path changes it."""
    ordered = F.array_sort(F.collect_list(F.struct("child", "hash")))
    return vector.groupBy("parent").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("root"))


def query_hash(path: Column, mode: Column) -> Column:
    """The cache key of a composition: SHA-256 over path and mode."""
    return F.sha2(F.concat_ws("\x1f", path, mode), 256)


def cached(results: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached results (query, result, last_used) kept beside new ones: the later used of each query."""
    return cache.unionByName(results).groupBy("query").agg(F.max_by("result", F.struct("last_used", "result")).alias("result"), F.max("last_used").alias("last_used"))


def parent_edges(versions: DataFrame) -> DataFrame:
    """Causal edges (path, child_id, parent_id) between a path's consecutive versions (path, clk, version_id)."""
    w = Window.partitionBy("path").orderBy("clk")
    return versions.select("path", F.col("version_id").alias("child_id"), F.lag("version_id").over(w).alias("parent_id")).where("parent_id is not null")
