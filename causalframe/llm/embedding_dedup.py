"""Near-duplicate vectors by spherical-cap filters: random product codes, list decoding, a join on filters, verification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from causalframe.llm.common import components, written


def _cap(alpha: float, dim: int, steps: int = 4000):
    """(density grid) of the cosine between a fixed and a random direction, from alpha to 1: points and weights."""
    import numpy as np

    t = np.linspace(-1, 1, 2 * steps + 1)
    p = (1 - t * t).clip(0) ** ((dim - 3) / 2) if dim > 3 else np.ones_like(t)
    p /= p.sum()
    keep = t >= alpha
    return t[keep], p[keep]


def cap_share(alpha: float, dim: int) -> float:
    """Share of directions whose cosine with a vector is at least alpha."""
    return float(_cap(alpha, dim)[1].sum())


def both_share(alpha: float, dim: int, cosine: float) -> float:
    """Share of directions whose cosine is at least alpha with either of two vectors of that cosine."""
    import numpy as np

    t, p = _cap(alpha, dim)
    if not len(t):
        return 0.0
    grid, weight = _cap(-1.0, max(3, dim - 1))
    tail = np.cumsum(weight[::-1])[::-1]
    spread = np.sqrt(max(1e-12, 1 - cosine * cosine) * (1 - t * t).clip(1e-12))
    at = np.searchsorted(grid, (alpha - cosine * t) / spread)
    return float((p * np.append(tail, 0.0)[at]).sum())


def plan(vectors: int, dim: int, cosine: float, miss: float) -> tuple[int, float]:
    """(codewords of each half, alpha): as many filters as vectors, up to the 2^31 that a number of 32 bits can name, and the highest cap at which two vectors of
    the threshold cosine share ln(1 / miss) filters on average, so that a link is missed with probability about `miss`."""
    words = max(32, min(46_000, math.ceil(math.sqrt(max(1, vectors)))))
    low, high = 0.0, 0.95
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if words * words * both_share(mid, dim, cosine) >= math.log(1 / miss) else (low, mid)
    return words, low


#: Vectors of fewer components are filled up with zeros, which changes no cosine, so that both halves have room for codes.
LEAST_DIM = 32


class Codes:
    """Filter directions of one dimension: (u, v) / sqrt(2), u and v from random codes of the two halves of a randomly rotated space."""

    def __init__(self, dim: int, words: int, alpha: float, seed: int):
        import numpy as np

        dim = max(dim, LEAST_DIM)

        rng = np.random.default_rng((seed, dim))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half, self.words, self.least = dim // 2, words, alpha * math.sqrt(2)
        halves = [rng.standard_normal((words, n)) for n in (self.half, dim - self.half)]
        self.codes = [h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12) for h in halves]

    def decode(self, units) -> list:
        """For each unit vector the sorted numbers of all filters whose cosine with it is at least alpha."""
        import numpy as np

        turned = units @ self.rotation[: units.shape[1]]
        one, two = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        out = []
        for a, b in zip(one, two):
            order = np.argsort(-b)
            sorted_b = -b[order]
            first = np.flatnonzero(a >= self.least + sorted_b[0])
            ends = np.searchsorted(sorted_b, a[first] - self.least, side="right")
            out.append(np.sort(np.concatenate([[], *(u * self.words + order[:e] for u, e in zip(first, ends))])).astype(np.int32))
        return out


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, miss: float = 1e-6, block: int = 512, seed: int = 11) -> DataFrame:
    """A row for each vector: id column, n_links, component_id, kept.

    Two vectors link when their cosine, in double precision, is at least `cosine`. n_links counts the other vectors that
    are linked directly, component_id is the least id reachable by links, kept says whether that is the row's own.

    1. Equal vectors are one class, with its number of rows and least id.
    2. Each class decodes the list of all filter directions within its cap; see plan for their number and the cap.
    3. Classes meet on filters. A filter's classes are dealt into blocks of about `block` by hash and each pair of blocks
       is a group of its own, so that a hot filter is spread over many tasks, which hold two blocks at most.
    4. A group computes its cosines as one matrix product. A pair that several filters bring together is counted by the
       smallest of them alone. Groups give counts for each class and a forest of links, never all pairs.

    What is missed is the pairs without a common filter: a link at the threshold with a probability of about `miss`, a
    closer one much more rarely. Nothing below the threshold links. Null and zero vectors and those with null or
    non-finite components link with nothing: n_links 0, their own id as component. Vectors of different length do not
    link. Null ids take part and have no id to give to their component. Repeated rows are vectors of their own.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    value = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).alias("id"), value.alias("v"))
    sound = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(sound, F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)))
    classes = written(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("weight"), F.first("v").alias("v")), "vectors")
    sizes = {r["dim"]: plan(r["n"], max(r["dim"], LEAST_DIM), cosine, miss) for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        known = {}
        for batch in batches:
            keys, weights, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(listed):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                codes = known.setdefault(dim, None) or Codes(dim, *sizes[dim], seed)
                known[dim] = codes
                for lo in range(0, len(at), 256):
                    part = at[lo : lo + 256]
                    units = unit(np.array([listed[i] for i in part]))
                    found = codes.decode(units)
                    counts = [len(f) for f in found]
                    rep = np.repeat(np.arange(len(part)), counts)
                    filters = np.concatenate(found)
                    lists = pa.array([f.tobytes() for f in found], pa.binary()).take(pa.array(rep))
                    units = pa.array([u.tobytes() for u in units], pa.binary()).take(pa.array(rep))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rep), dim, np.int32)), pa.array(filters), pa.array([keys[i] for i in part], pa.string()).take(pa.array(rep)),
                        pa.array(np.array([weights[i] for i in part])[rep]), units, lists,
                    ], ["dim", "filter", "key", "weight", "unit", "filters"])

    def unit(v):
        import numpy as np

        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    placed = written(classes.select("key", "weight", "v").mapInArrow(decode, "dim int, filter int, key string, weight long, unit binary, filters binary"), "filters")
    met = placed.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    dealt = placed.join(met.select("dim", "filter", "parts"), ["dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    groups = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "dim", "filter", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "key", "weight", "unit", "filters"
    )

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        names = ["key", "links", "root"]

        def group(name, held):
            """Counts and a forest for the classes of one group: (part, key, weight, unit, filters) rows."""
            _, number, low, high = name
            units = np.frombuffer(b"".join(r[3] for r in held), np.float64).reshape(len(held), -1)
            side = np.array([r[0] for r in held])
            weights = np.array([r[2] for r in held])
            linked = units @ units.T >= cosine
            np.fill_diagonal(linked, False)
            if low != high:
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked))
            if not len(a):
                return None
            lists = [np.frombuffer(r[4], np.int32) for r in held]
            width = max(map(len, lists))
            before = np.full((len(held), width), -1, np.int64)  # the filters below this one; -1 and -2 match nothing
            for i, f in enumerate(lists):
                f = f[f < number]
                before[i, : len(f)] = f
            links = np.zeros(len(held), np.int64)
            for lo in range(0, len(a), 4096):
                x, y = a[lo : lo + 4096], b[lo : lo + 4096]
                theirs = np.where(before[y] < 0, -2, before[y])
                mine = ~(before[x][:, :, None] == theirs[:, None, :]).any((1, 2))
                np.add.at(links, x[mine], weights[y[mine]])
                np.add.at(links, y[mine], weights[x[mine]])
            root = np.arange(len(held))
            while True:
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            touched = np.flatnonzero((links > 0) | (root != np.arange(len(held))))
            return [held[i][1] for i in touched], links[touched].tolist(), [held[root[i]][1] for i in touched]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], names)

        name, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for row in zip(*columns):
                if row[:4] != name:
                    if len(held) > 1 and (found := group(name, held)):
                        yield out(found)
                    name, held = row[:4], []
                held.append(row[4:])
        if len(held) > 1 and (found := group(name, held)):
            yield out(found)

    order = ["dim", "filter", "low", "high"]
    checked = written(groups.repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(verify, "key string, links long, root string"), "links")
    counts = checked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(checked.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    placed = classes.select("key", "least_id").join(roots.withColumnRenamed("node", "key"), "key")
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = (
        classes.select("key", "least_id", "weight").join(counts, "key", "left")
        .join(placed.join(least, "root").select("key", "component_id"), "key", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    )
    joined = rows.select("id", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").cast(id_type).alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
