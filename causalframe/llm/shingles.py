"""Sets of word shingles, and how many sets hold each shingle, counted over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.llm.common import give_back

#: A chunk is what a task deals out at a time: about so many shingles, of at most so many sets.
CHUNK_SHINGLES, CHUNK_SETS = 1_000_000, 2_000
#: A block is a range of shingle hashes, met in one task: about those of so many bytes of text.
BLOCK_BYTES = 8_000_000
#: Shingles that stand in more sets of a chunk are counted there and sent once.
OFTEN = 16
#: Sets that a task remembers, to send copies once; copies beyond it are only dealt out again.
MOST_SEEN = 300_000

#: Kinds of messages: shingles for a block, places of a chunk's frequent shingles, a document, a block's answer.
ASK, PLACES, DOCUMENT, ANSWER = range(4)


def need_alone(size, percent: int):
    """Least number of common members with a partner of any size."""
    return -(-percent * size // 100)


class Shingler:
    """Sets of hashed shingles of whole texts. A-Z is lower-cased; words end at ASCII white space."""

    def __init__(self, width: int, most: int = 400_000):
        self.width, self.most, self.known = width, most, {}

    def of(self, text: bytes | None):
        """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it has fewer words."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(ids))
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            h = (h ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def class_key(members) -> bytes:
    """A 128-bit hash that stands for a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(members.tobytes())


def pack_steps(ascending) -> bytes:
    """Ascending numbers from 0 as the steps between them, a byte each; 255 stands for a part of a longer step."""
    import numpy as np

    if not len(ascending):
        return b""
    step = np.diff(ascending, prepend=0)
    ends = np.cumsum(step // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1, 255, np.uint8)
    out[ends] = step % 255
    return out.tobytes()


def unpack_steps(packed: bytes):
    import numpy as np

    step = np.frombuffer(packed, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def shared_shingles(rows: DataFrame, *, width: int, percent: int, small: int) -> DataFrame:
    """A row for each row (id, text): id, n (size of the set), class (its 128-bit hash), unshared, shingles.

    A set can only have a partner with `percent` of similarity if need_alone of its members stand in other sets too.
    Where that is so, `unshared` is the number of its other members, and `shingles` are the rarest shared ones, as many as
    a partner cannot lack all of them, in one order for all sets (by the logarithm of the number of sets, then by hash);
    for sets of up to `small` members all shared ones. Elsewhere, and on some of the rows with equal sets, both are null.

    The counts are over all sets: tasks cut their rows into chunks and send a chunk's shingles to blocks by range of
    hash, 32 bits each and no text; a block answers each chunk which of them other sets hold, and of how many; a chunk
    puts the answers together. Shingles that are frequent in a chunk are sent once with their number, so that a block gets
    few entries of a hot one from each chunk. Copies are sent once by each task. Hashes of a block that coincide only make
    a shingle look shared. Chunks are told by the rows' places in their tasks, so the rows must come from files or from
    another source that gives the same rows again.
    """
    spark: SparkSession = rows.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = min(1 << 20, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES + 1))
    fields = ["key", "chunk", "kind", "hashes", "places", "more", "id", "n", "no", "class"]
    schema = f"key long, chunk long, kind int, hashes binary, places binary, more binary, id {id_type}, n int, no int, class binary"

    def batch(id_arrow, **columns):
        import pyarrow as pa

        n = len(next(iter(columns.values())))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), id_arrow, pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns and not isinstance(columns[f], pa.Array) else columns.get(f, pa.nulls(n, t)) for f, t in zip(fields, types)], fields)

    def deal(batches):
        from pyspark import TaskContext

        shingler, seen = Shingler(width), set()
        chunk, sets, held, others = TaskContext.get().partitionId() << 32, [], 0, 0
        import pyarrow as pa

        for b in batches:
            id_arrow = b.schema.field(0).type
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                n, no, keys = [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    members = shingler.of(t)
                    key = class_key(members)
                    n.append(len(members))
                    keys.append(key)
                    if len(members) and key not in seen:
                        if len(seen) < MOST_SEEN:
                            seen.add(key)
                        no.append(len(sets))
                        sets.append(members)
                        held += len(members)
                    else:
                        no.append(-1)
                # copies wait for no answer: those of a slice are a chunk of their own
                others += 1
                chunks = [chunk if k >= 0 else (chunk | 1 << 31) + others for k in no]
                yield batch(id_arrow, key=[-1 - c for c in chunks], chunk=chunks, kind=[DOCUMENT] * len(n), id=part.column(0), n=n, no=no, **{"class": keys})
                if held >= CHUNK_SHINGLES or len(sets) >= CHUNK_SETS:
                    yield from asked(sets, chunk, id_arrow)
                    sets, held, chunk = [], 0, chunk + 1
        if sets:
            yield from asked(sets, chunk, id_arrow)
        del shingler, seen, sets
        give_back()

    def asked(sets, chunk, id_arrow):
        import numpy as np

        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        wide = (hashes >> np.uint64(20)) * np.uint64(blocks)  # 44 bits of the hash as a fraction of all blocks
        block, short = (wide >> np.uint64(44)).astype(np.int64), (wide >> np.uint64(12)).astype(np.uint32)
        slot = (hashes >> np.uint64(30)).astype(np.int64) & 0xFFFFF
        often = np.bincount(slot, minlength=1 << 20)[slot] > OFTEN
        at = np.flatnonzero(often)
        names, which, counts = np.unique(block[at] << 32 | short[at], return_inverse=True, return_counts=True)
        many = counts > OFTEN
        often[at] = many[which]
        at, which = at[many[which]], which[many[which]]
        if len(at):
            by = np.argsort(which, kind="stable")
            yield batch(id_arrow, key=[-1 - chunk], chunk=[chunk], kind=[PLACES], hashes=[names[which[by]].astype("<i8").tobytes()], places=[owner[at[by]].astype("<u4").tobytes()])
        names, counts = names[many], counts[many]
        rest = np.flatnonzero(~often)
        rest = rest[np.argsort(block[rest].astype(np.uint16) if blocks <= 1 << 16 else block[rest], kind="stable")]
        edges = np.searchsorted(block[rest], np.arange(blocks + 1))
        hot_edges = np.searchsorted(names >> 32, np.arange(blocks + 1))
        held = 0
        keys, texts, places, more = [], [], [], []
        for k in np.flatnonzero((edges[1:] > edges[:-1]) | (hot_edges[1:] > hot_edges[:-1])).tolist():
            own, hot = rest[edges[k] : edges[k + 1]], slice(hot_edges[k], hot_edges[k + 1])
            extra = counts[hot].astype("<u4")
            keys.append(k)
            texts.append(np.concatenate([short[own], (names[hot] & 0xFFFFFFFF).astype(np.uint32)]).astype("<u4").tobytes())
            places.append(pack_steps(np.concatenate([owner[own], np.full(len(extra), len(sets), owner.dtype)])))
            more.append(extra.tobytes())
            held += len(own)
            if held > 500_000 or len(keys) >= 1000:
                yield batch(id_arrow, key=keys, chunk=[chunk] * len(keys), kind=[ASK] * len(keys), hashes=texts, places=places, more=more)
                keys, texts, places, more, held = [], [], [], [], 0
        if keys:
            yield batch(id_arrow, key=keys, chunk=[chunk] * len(keys), kind=[ASK] * len(keys), hashes=texts, places=places, more=more)

    def answer(table):
        """A block: for each chunk its shingles that other sets hold too, with 16 times the binary logarithm of their number."""
        import numpy as np
        import pyarrow as pa

        if table.column("key")[0].as_py() < 0:
            return table
        messages = [(c, np.frombuffer(h, "<u4"), unpack_steps(p), np.frombuffer(m, "<u4")) for c, h, p, m in zip(*[table.column(x).to_pylist() for x in ("chunk", "hashes", "places", "more")])]
        hashes = np.concatenate([m[1] for m in messages])
        weight = np.ones(len(hashes), np.int64)
        end = 0
        for _, h, _, m in messages:
            end += len(h)
            weight[end - len(m) : end] = m
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        of = np.minimum(255, 16 * np.log2(np.add.reduceat(weight[order], first))).astype(np.uint8)
        code = np.empty(len(hashes), np.uint8)
        code[order] = np.repeat(of, np.diff(first, append=len(hashes)))
        out, end = [], 0
        for c, h, p, _ in messages:
            mine = code[end : end + len(h)]
            end += len(h)
            keep = mine > 0
            if keep.any():
                out.append((c, h[keep].tobytes(), pack_steps(p[keep]), mine[keep].tobytes()))
        del messages, hashes, weight, order, ordered, first, of, code
        give_back()
        key, many = table.column("key")[0].as_py(), len(out)
        columns = list(zip(*out)) if out else [[]] * 4
        made = batch(table.schema.field("id").type, key=[key] * many, chunk=columns[0], kind=[ANSWER] * many, hashes=columns[1], places=columns[2], more=columns[3])
        return pa.Table.from_batches([made])

    def meet(table):
        """A chunk: its documents with the answers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        docs = table.filter(pc.equal(table.column("kind"), DOCUMENT)).combine_chunks()
        docs = docs.take(pc.sort_indices(docs.column("no")))
        no, n = docs.column("no").to_numpy(), docs.column("n").to_numpy().astype(np.int64)
        copies = int((no < 0).sum())
        size = n[copies:]
        total = len(size)
        owner, name, code, hot, hot_code = [], [], [], [], []
        for k, h, p, m in zip(*[table.filter(pc.equal(table.column("kind"), ANSWER)).column(x).to_pylist() for x in ("key", "hashes", "places", "more")]):
            h, p, m = np.frombuffer(h, "<u4").astype(np.int64) | k << 32, unpack_steps(p), np.frombuffer(m, np.uint8)
            own = p < total
            owner.append(p[own])
            name.append(h[own])
            code.append(m[own])
            hot.append(h[~own])
            hot_code.append(m[~own])
        for h, p in zip(*[table.filter(pc.equal(table.column("kind"), PLACES)).column(x).to_pylist() for x in ("hashes", "places")]):
            h, names = np.frombuffer(h, "<i8"), np.concatenate(hot)
            by = np.argsort(names)
            owner.append(np.frombuffer(p, "<u4").astype(np.int64))
            name.append(h)
            code.append(np.concatenate(hot_code)[by[np.searchsorted(names, h, sorter=by)]])
        owner, name, code = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, name, code)]
        shared = np.bincount(owner, minlength=total)
        needed = need_alone(size, percent)
        alive = shared >= needed
        take = np.where(size <= small, shared, shared - needed + 1)
        keep = alive[owner]
        owner, name, code = owner[keep], name[keep], code[keep]
        by = np.lexsort((name, code, owner))
        owner, name = owner[by], name[by]
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=total))])
        keep = np.arange(len(owner)) - starts[owner] < take[owner]
        owner, name = owner[keep], name[keep]
        ends = np.cumsum(np.bincount(owner, minlength=total))
        dead = np.concatenate([np.ones(copies, bool), ~alive])
        offsets = pa.array(np.concatenate([np.zeros(copies + 1, np.int64), ends]).astype(np.int32), mask=np.concatenate([dead, [False]]))
        unshared = pa.array(np.concatenate([np.zeros(copies, np.int64), size - shared]).astype(np.int32), mask=dead)
        lists = pa.ListArray.from_arrays(offsets, pa.array(name))
        if total:
            del owner, code, by, keep, hot, hot_code
            give_back()
        return pa.Table.from_arrays([docs.column("id"), docs.column("n"), docs.column("class"), unshared, lists], ["id", "n", "class", "unshared", "shingles"])

    answered = rows.select("id", "text").mapInArrow(deal, schema).groupBy("key").applyInArrow(answer, schema)
    return answered.groupBy("chunk").applyInArrow(meet, f"id {id_type}, n int, class binary, unshared int, shingles array<bigint>")
