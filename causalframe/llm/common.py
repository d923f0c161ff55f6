"""Helpers shared by the corpus operators: written tables, connected components, the package for the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.storage import delete, scratch, written

__all__ = ["Tables", "components", "delete", "give_back", "scratch", "ship", "written"]


def give_back() -> None:
    """Hand free memory back to the system at a task's end: Python workers live on beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Up to so many edges are joined in one task, some 100 bytes an edge; more take rounds over all tasks.
ONE_TASK_EDGES = 2_000_000


def least_reached(a, b):
    """(nodes, roots) of edges given as two arrays: all nodes in order, and the least node that each reaches."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


class Tables:
    """Written tables of one operator; those that no later step reads are dropped, so that they do not fill the folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[0])


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) for each node in an edge, root the least node.

    After a limited number of rounds a root may not be the least node yet, but still lies in the node's component.

    Up to ONE_TASK_EDGES edges between 64-bit numbers are joined in one task, as each round costs several jobs. Others take
    alternating large-star and small-star rounds (Kiveris and others, 2014). A node's least neighbour comes from a
    partial aggregate that is joined back, so no neighbourhood is gathered in one task; each round is written to the
    shared folder and the rounds end when the edges no longer change. Null ends and loops are left out.
    """
    spark = edges.sparkSession

    def sym(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def save(e: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "components")
        e.write.parquet(path)
        return spark.read.schema(e.schema).parquet(path), path

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur, path = save(edges.where("a <> b").select("a", "b"))
    before, done = mark(cur), 0
    if before[0] <= ONE_TASK_EDGES and {t.dataType.simpleString() for t in cur.schema} == {"bigint"}:

        def joined(batches):
            import numpy as np
            import pyarrow as pa

            found = [np.zeros((2, 0), np.int64), *(np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches)]
            nodes, roots = least_reached(*np.concatenate(found, axis=1))
            del found
            for i in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], ["node", "root"])
            give_back()

        return cur.coalesce(1).mapInArrow(joined, "node long, root long")
    while before[0] and done != rounds:
        done += 1
        # large-star: neighbours above u point at the least of u and its neighbours
        both = sym(cur)
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        mid, mid_path = save(tidy(large))
        # small-star: u and its neighbours below point at the least neighbour; edges already run from larger to smaller
        m = mid.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = mid.select(F.col("a").alias("u"), "b").join(m, "u").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("u", "m"))
        new, new_path = save(tidy(small))
        delete(spark, path)
        delete(spark, mid_path)
        cur, path = new, new_path
        if rounds is None:
            after = mark(cur)
            if after == before:
                break
            before = after
    ends = cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b"))
    return ends.groupBy("node").agg(F.min("root").alias("root"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each application, through the driver's file server."""
    import os
    import tempfile
    import zipfile

    import causalframe

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(causalframe.__file__))
    path = os.path.join(tempfile.mkdtemp(), "causalframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
