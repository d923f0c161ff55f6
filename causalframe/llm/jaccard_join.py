"""Near-duplicates by the Jaccard similarity of n-gram sets: a size-aware heavy-light join."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, functions as F

from causalframe.llm.common import Tables, components, give_back
from causalframe.llm.shingles import Shingler, class_key, need_alone, shared_shingles

#: Which representatives' sets are read again is told to the tasks as a bit for each hash bucket of ids.
ID_BUCKETS = 1 << 20
#: Heads that a list gets by different random orders before the lists are scanned.
HEADS = 2
#: Looking at one pair costs about as much as writing this many rows.
PAIR_COST = 32
#: Sets of up to so many members may be light.
SMALL = 40
#: A set is sent about once for so many classes that it is compared with.
HEAD_PAIRS = 500
#: Lists are scanned once that means looking at no more than so many pairs for each of their entries, or rounds of heads stop helping.
SCAN_LOOKS = 4
#: Or verifying no more than so many pairs for each of their entries.
SCAN_PAIRS = 0.5
#: Heads of a list in a later round, at most.
MOST_HEADS = 12
#: A round of heads helps if one of so many of its sets finds a link.
LEAST_LINKED = 20


def need(a, b, percent: int):
    """Least number of common members with which sets of a and b members link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(members) -> list[int]:
    """256 parities of members by hash, as four signed 64-bit numbers. Two sets differ in at least as many members as bits."""
    import numpy as np

    odd = np.bincount((members >> np.uint64(40)).astype(np.int64) & 255, minlength=256).astype(np.uint8) & 1
    return np.packbits(odd).view(">i8").tolist()


def light_sizes(percent: int, met: float, top: int = SMALL) -> int:
    """The largest size up to which enumerating subsets costs less than scanning inverted lists; 0 if none does.

    A set of s members writes C(s, c) subsets for each overlap c that a partner of light size needs; or its prefix, whose
    lists it scans, which costs PAIR_COST for each other set that stands there (`met`, their mean number).
    """
    found = 0
    for s in range(1, top + 1):
        lists = (s - need_alone(s, percent) + 1) * (1 + PAIR_COST * met)
        if sum(math.comb(s, c) for c in overlaps(s, s, percent)) <= lists:
            found = s
        elif overlaps(s, s, percent):
            break
    return found


def overlaps(size: int, top: int, percent: int) -> list[int]:
    """The overlaps that partners of at most `top` members need of a set of `size`; sets with all members in common are one class."""
    out = set()
    for other in range(1, top + 1):
        c = need(size, other, percent)
        if c <= min(size, other) and not (other == size == c):
            out.add(c)
    return sorted(out)


def link_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """A row for each document: id column, n_shingles, component_id.

    Two documents link when percent * (size of the union) <= 100 * (size of the intersection) of their sets of distinct
    `width`-word shingles; component_id is the least id that is reachable by links. The join is exact:

    1. Documents with equal sets (told by 128-bit hashes) are one class. shared_shingles counts in how many sets each
       shingle stands; only classes with enough shared ones can link, and only these go on, with their rarest shared
       shingles.
    2. Light classes (of up to light_sizes members, by the measured length of lists) write subsets of fixed sizes of
       their shared shingles. Sets that share a subset as large as their sizes need link, and whoever links within such a
       group also links with its smallest set, so each set is paired with that one alone.
    3. Heavy classes, and light ones whose partner may be heavy, write their rarest shared shingles to inverted lists:
       linked sets share one of them, in lists of sets of like sizes. For each of HEADS random orders a class is paired
       with the list head that it meets most; the verified pairs give components. While lists still hold many sets outside
       their most frequent component, these are paired with the likest (by bitmap) of further heads, which differ by list,
       as most pairs of a group may lie just below the threshold; rounds go on while they find links. Then the lists are
       scanned for pairs of different components that pass the length, positional and bitmap bounds: what lies outside a
       list's most frequent component, with all of the list. The heads take the squares out of groups of near copies; the
       scan loses no link.
    4. Pairs are verified on whole sets; components follow from the links. A set that many are compared with is sent
       about once for HEAD_PAIRS of them, so that no task gets all its pairs.

    The rows must come from files or from another source that gives the same rows again (shared_shingles).

    A document without words (null or empty text, white space) has n_shingles 0, links with nothing and has its own id as
    component. Null ids take part: they lie in components, whose least id is that of the others; a component without any id
    has null. Repeated rows, and rows that share an id, are kept and judged each by its text. Texts of any length are
    taken whole. Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tables = Tables(spark)
    known = tables.keep(shared_shingles(rows, width=width, percent=percent, small=SMALL))
    least_ids = tables.keep(known.where("n > 0").groupBy("class").agg(F.min("id").alias("least_id")))
    linkable = known.where("shingles is not null").groupBy("class").agg(F.first(F.struct("n", "unshared", "shingles", F.col("id").alias("some_id"))).alias("c"))
    classes = tables.keep(linkable.join(least_ids, "class").select(F.monotonically_increasing_id().alias("num"), "class", "least_id", "c.*"))
    prefix = F.expr(f"slice(shingles, 1, n - unshared - (({percent} * n + 99) div 100) + 1)")

    lengths = classes.where(F.col("n") <= SMALL).select(F.explode(prefix).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    squares, entries = lengths.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
    top = light_sizes(percent, squares / entries - 1 if entries else 0.0)
    subset_sizes = {s: overlaps(s, top, percent) for s in range(1, top + 1)}

    def subsets(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        def listed(out):
            token, kind, num, n = zip(*out)
            columns = [pa.array(np.array(token, np.uint64).view(np.int64)), pa.array(kind, pa.int32()), pa.array(num, pa.int64()), pa.array(n, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["token", "kind", "num", "n"])

        for batch in batches:
            out = []
            for num, n, shingles in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for c in subset_sizes.get(n, ()):
                    for some in itertools.combinations(sorted(shingles), c):
                        out.append((xxh3_64_intdigest(np.array(some, np.int64).tobytes(), c), -c, num, n))
                        if len(out) >= 100_000:
                            yield listed(out)
                            out = []
            if out:
                yield listed(out)
        give_back()

    light_pairs = None
    if top:
        light = tables.keep(classes.where(F.col("n") <= top).select("num", "n", "shingles").mapInArrow(subsets, "token long, kind int, num long, n int"))
        least = tables.keep(light.groupBy("token", "kind").agg(F.min(F.struct("n", "num")).alias("head"), F.count("*").alias("c")).where("c > 1").drop("c"))
        met = light.join(least, ["token", "kind"]).where((F.col("num") != F.col("head.num")) & ((100 + percent) * -F.col("kind") >= percent * (F.col("n") + F.col("head.n"))))
        light_pairs = tables.keep(met.select("num", F.col("head.num").alias("head")).distinct())
        tables.drop(light, least)

    heavy = classes.where((F.col("n") > top) | (100 * F.col("n") >= percent * (top + 1))).select("num", "n", "unshared", F.posexplode(prefix).alias("at", "token"))
    # sets that link lie in the same or in neighbouring classes of sizes, so they meet in a list of two neighbouring classes
    size_class = F.floor(F.log(F.col("n") + F.lit(0.0)) / math.log(100 / percent)).cast("int")
    sized = tables.keep(heavy.select("token", "num", "n", (F.col("unshared") + F.col("at")).alias("pos"), F.explode(F.array(size_class, size_class + 1)).alias("g")))
    full = tables.keep(sized.groupBy("token", "g").agg(F.min("num").alias("low"), F.max("num").alias("high")).where("low <> high").select("token", "g"))
    placed = tables.keep(sized.join(full, ["token", "g"]))

    # the sets of the classes that some list or pair holds, read again from one of their texts
    some = placed.select("num")
    if light_pairs is not None:
        some = some.union(light_pairs.select("num")).union(light_pairs.select("head"))
    wanted = tables.keep(classes.join(some.distinct(), "num").select("num", "class", "some_id"))
    at = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int")
    bits = np.zeros(ID_BUCKETS, np.uint8)
    bits[wanted.select(F.col("some_id").alias("id")).select(at.alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)] = 1
    words = F.split(F.lit(",".join(map(str, np.packbits(bits, bitorder="little").view("<i8").tolist()))), ",").cast("array<bigint>")
    asked = rows.where(F.getbit(F.get(words, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1).select("text")

    def sets(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = [shingler.of(t) for t in batch.column(0).slice(lo, 200).cast(pa.binary()).to_pylist()]
                columns = [pa.array([class_key(x) for x in part], pa.binary()), pa.array([x.tobytes() for x in part], pa.binary()), pa.array([bitmap(x) for x in part], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["class", "members", "bits"])
        del shingler
        give_back()

    read = asked.mapInArrow(sets, "class binary, members binary, bits array<bigint>").join(wanted.select("class", "num"), "class")
    whole_sets = read.groupBy("num").agg(F.first(F.struct("members", "bits")).alias("s")).select("num", "s.*")
    store = tables.keep(whole_sets.withColumn("n", F.expr("cast(octet_length(members) div 8 as int)")))
    sizes = store.select("num", "n", "bits")

    def apart(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)

    def least_common(n, m):
        return -F.floor(-(percent * (n + m)) / F.lit(100 + percent))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (num, head) those that link, by whole sets; a head may stand in any number of pairs."""
        one, two = [sizes.select(F.col("num").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "bits")]) for k in ("num", "head")]
        both = pairs.distinct().join(one, "num").join(two, "head")
        may = tables.keep(both.where(
            (percent * F.greatest("n_num", "n_head") <= 100 * F.least("n_num", "n_head")) & (F.col("n_num") + F.col("n_head") - 2 * least_common(F.col("n_num"), F.col("n_head")) >= apart("bits_num", "bits_head"))
        ).select("num", "head"))
        many = may.count()
        salted = may.withColumn("salt", F.pmod(F.xxhash64("num"), F.lit(many // HEAD_PAIRS + 1)))
        heads = tables.keep(salted.select("head", "salt").distinct().join(store.select(F.col("num").alias("head"), F.col("members").alias("y")), "head"))
        whole = salted.join(store.select("num", F.col("members").alias("x")), "num").join(heads, ["head", "salt"])
        out = tables.keep(whole.select("num", "head", "x", "y").mapInArrow(compare, "a long, b long"))
        tables.drop(may, heads)
        return out

    # for each class and order the list head that it meets most
    orders = [F.min_by(F.struct("num", "n"), F.xxhash64("num", F.lit(k))) for k in range(HEADS)]
    heads = tables.keep(placed.groupBy("token", "g").agg(F.array(*orders).alias("heads")))
    met = placed.join(heads, ["token", "g"]).select("num", "n", F.posexplode("heads").alias("order", "head"))
    met = met.where((F.col("num") != F.col("head.num")) & (percent * F.greatest("n", "head.n") <= 100 * F.least("n", "head.n")))
    most = met.groupBy("num", "order", F.col("head.num").alias("head")).agg(F.count("*").alias("c")).groupBy("num", "order").agg(F.max_by("head", F.struct("c", "head")).alias("head"))
    pairs = most.select("num", "head")
    links = verified(pairs if light_pairs is None else pairs.union(light_pairs))

    # the lists that hold more than one component, with each class's component
    def several(entries: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        rooted = tables.keep(entries.join(roots, "num", "left").withColumn("root", F.coalesce("root", "num")))
        counted = rooted.groupBy("token", "g", "root").agg(F.count("*").alias("c")).groupBy("token", "g")
        # a list's most frequent component, and the entries of all and of that one
        found = counted.agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.sum("c").alias("held"), F.max("c").alias("inside")).where("held > inside")
        found = tables.keep(found)
        return rooted, found, rooted.join(found.select("token", "g", "largest"), ["token", "g"])

    def may_link(x, y):
        """Whether entries of a list, given as functions of a column's name, lie in different components and pass all bounds; sets of one size class meet in the first of their two lists."""
        bound = least_common(x("n"), y("n"))
        return (
            (x("root") != y("root")) & (x("own") | y("own"))
            & (percent * F.greatest(x("n"), y("n")) <= 100 * F.least(x("n"), y("n")))
            & (F.least(x("n") - x("pos"), y("n") - y("pos")) >= bound)
            & (x("n") + y("n") - 2 * bound >= apart(x("bits"), y("bits")))
        )

    roots = tables.keep(components(links, rounds=4).withColumnRenamed("node", "num"))
    rooted, found, lists = several(placed, roots)
    scanned = tables.keep(lists.join(sizes.select("num", "bits"), "num").withColumn("own", F.col("g") == size_class))
    tables.drop(rooted)
    entry = F.struct("num", "n", "pos", "root", "own", "bits")
    turn = HEADS
    while True:
        held, outside, looks = found.agg(F.sum("held"), F.sum(F.col("held") - F.col("inside")), F.sum((F.col("held") - F.col("inside")) * F.col("held"))).first()
        tables.drop(found)
        if not held or looks <= SCAN_LOOKS * held:
            break
        # each set outside is paired with the likest of the heads of its lists, which differ by list and round
        many = min(MOST_HEADS, max(HEADS, held // outside))
        orders = [F.min_by(entry, F.xxhash64("num", "token", F.lit(turn + k))) for k in range(many)]
        turn += many
        heads = tables.keep(scanned.groupBy("token", "g").agg(F.array(*orders).alias("heads"), F.count("*").alias("held")))
        met = scanned.where("root <> largest").select("token", "g", entry.alias("x")).join(heads, ["token", "g"])
        likes = F.transform("heads", lambda h: F.when(may_link(F.col("x").getField, h.getField), F.struct(apart(F.col("x.bits"), h["bits"]).alias("d"), h["num"].alias("head"))))
        # the pairs that a scan would have to verify, by the share of heads that pass the bounds
        share = F.size(F.filter("likes", lambda h: h.isNotNull())) * F.col("held") / many
        likest = met.select(F.col("x.num").alias("num"), "held", likes.alias("likes")).groupBy("num").agg(
            F.filter(F.array(*[F.min(F.get("likes", F.lit(k))) for k in range(many)]), lambda h: h.isNotNull()).alias("likes"), F.sum(share).alias("pairs")
        )
        tried = tables.keep(likest.where("pairs > 0"))
        asked_for, pairs = tried.agg(F.count("*"), F.sum("pairs")).first()
        if not asked_for or pairs <= SCAN_PAIRS * held:
            tables.drop(heads, tried)
            break
        more = verified(tried.select("num", F.explode("likes.head").alias("head")))
        linked = more.select("a").distinct().count()
        links = links.union(more)
        roots = tables.keep(components(links).withColumnRenamed("node", "num"))
        rooted, found, lists = several(scanned.drop("root", "largest"), roots)
        before, scanned = scanned, tables.keep(lists)
        tables.drop(rooted, before, heads, tried)
        if LEAST_LINKED * linked < asked_for or not linked:
            break

    x, y = [scanned.alias(a) for a in "xy"]
    meet = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.g") == F.col("y.g")) & ((F.col("y.root") == F.col("y.largest")) | (F.col("x.num") < F.col("y.num")))
        & may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    )
    met = x.where("x.root <> x.largest").join(y, meet)
    links = links.union(verified(met.select(F.col("y.num").alias("num"), F.col("x.num").alias("head"))))
    roots = tables.keep(components(links).withColumnRenamed("node", "num"))
    linked = classes.select("num", "class", "least_id").join(roots, "num")
    lowest = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    told = linked.join(lowest, "root").select("class", "component_id")
    answers = tables.keep(least_ids.join(told, "class", "left").select("class", F.coalesce("component_id", "least_id").alias("component_id")))
    out = known.select("id", "n", "class").join(answers, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
