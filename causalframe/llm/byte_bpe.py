"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from causalframe.llm.common import give_back, written
from causalframe.llm.pieces import cut_named, gather, named_pieces, number_named, text_batches


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The rank of a pair that is not in the merge table; ranks are below it.
_NONE = 1 << 17


def merge_table(ranks: dict[bytes, int], bits: int = 17) -> list[int]:
    """The rank map of all pairs of tokens whose bytes joined are a token, as a cuckoo hash table of two halves.

    A pair (left, right) has the key left * 65536 + right and stands at one of two slots as key * 65536 + merged rank;
    free slots hold -1. The size depends on the vocabulary alone.
    """
    slots, table = 1 << bits, [-1] * (2 << bits)
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            left, right = ranks.get(word[:i]), ranks.get(word[i:])
            if left is None or right is None:
                continue
            entry, half = (left << 16 | right) << 16 | rank, 0
            for _ in range(500):
                key = entry >> 16
                at = half * slots + (key * (40503, 30011)[half] + (key >> 16) * (7919, 104729)[half]) % slots
                entry, table[at] = table[at], entry
                if entry < 0:
                    break
                half = 1 - half
            else:
                return merge_table(ranks, bits + 1)
    return table


def encode_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """ids (array of int) of a word given as the array of its bytes, 0 to 255: folded by the lowest-ranked merge until none is left.

    A step merges the leftmost of the lowest-ranked pairs. A null word gives null, an empty one no ids.
    """
    if max(ranks.values()) > 65535:
        raise ValueError("ranks beyond 65535 do not fit the merge table")
    table = merge_table(ranks)
    slots = len(table) // 2
    one = [bytes([b]) for b in range(256)]
    table += [ranks[b] for b in one]
    # a byte's id with the rank of the pair that it begins with the next byte, or with none (256)
    table += [ranks.get(a + b, _NONE) * 65536 + ranks[a] if b else _NONE * 65536 + ranks[a] for a in one for b in [*one, b""]]
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # the optimizer folds it to one literal
    # a function over the one-element array of it names the table for the folds inside
    return F.get(F.transform(F.array(literal), lambda named: _encode(word, named, slots)), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value), where value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _encode(word: Column, table: Column, slots: int) -> Column:
    def rank(left: Column, right: Column) -> Column:
        """Merged rank of a pair, or _NONE."""
        key = left * 65536 + right
        # merge_table's slots, key * 40503 + left * 7919 and key * 30011 + left * 104729, in as few steps as can be
        one = F.get(table, ((left * (65536 * 40503 + 7919) + right * 40503) % slots).cast("int"))
        two = F.get(table, ((left * (65536 * 30011 + 104729) + right * 30011) % slots + slots).cast("int"))
        return F.when(F.shiftright(one, 16) == key, one.bitwiseAND(65535)).when(F.shiftright(two, 16) == key, two.bitwiseAND(65535)).otherwise(F.lit(_NONE))

    def ranked(left: Column, right: Column) -> Column:
        """An id with the rank of the pair that it begins: rank * 65536 + id."""
        return F.when(right.isNull(), F.lit(_NONE)).otherwise(rank(left, right)) * 65536 + left

    def step(state: Column, _: Column) -> Column:
        def merged(least: Column, at: Column) -> Column:
            before, after = F.get(state, at - 2).bitwiseAND(65535), F.get(state, at + 1).bitwiseAND(65535)
            return F.concat(
                F.slice(state, F.lit(1), F.greatest(at - 2, F.lit(0))),
                F.when(at > 1, F.array(ranked(before, least))).otherwise(F.slice(state, 1, 0)),
                F.array(ranked(least, after)),
                F.slice(state, at + 2, F.size(state)),
            )

        return _let(F.shiftright(F.array_min(state), 16), lambda least: F.when(
            least < _NONE, _let(F.array_position(F.transform(state, lambda x: F.shiftright(x, 16)), least).cast("int"), lambda at: merged(least, at))
        ).otherwise(state))

    later = F.slice(word, F.lit(2), F.size(word))
    pairs = F.zip_with(word, later, lambda a, b: F.get(table, a.cast("int") * 257 + F.coalesce(b.cast("int"), F.lit(256)) + (2 * slots + 256)))
    folded = F.transform(F.aggregate(later, pairs, step), lambda x: x.bitwiseAND(65535))
    single = F.transform(word, lambda b: F.get(table, b.cast("int") + 2 * slots))
    return F.when(F.size(word) > 1, folded).otherwise(single).cast("array<int>")


#: A batch of documents holds about so many pieces, or one document.
BATCH_PIECES = 200_000
#: ids are put together for about so many bytes of them at a time, or for one document.
BATCH_BYTES = 1_000_000
#: Fixed value: the pattern whose matches never hold white space after another character, so that texts may be cut there first.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pieces(texts: list[bytes | None], pattern: str):
    """number_named of pieces that no match of the pattern crosses: between words for WORDS, whole texts for any other pattern."""
    import numpy as np

    if pattern == WORDS:
        return number_named(texts)
    ends = np.cumsum([bool(t) for t in texts], dtype=np.int32)
    return [b" " + t for t in texts if t], [np.arange(end - bool(t), end, dtype=np.int32) for t, end in zip(texts, ends)]


def _cut(name: bytes, findall, pattern: str) -> list[bytes]:
    """The pattern's matches in the piece of that name; for WORDS a run of letters, after a space or not and before one stop or comma or not, is known without it."""
    # ASCII letters with no space in their name: a piece of WORDS
    if name.isalpha():
        return [b" " + name]
    if name[-1:] in (b".", b",") and name[:-1].isalpha():
        return [b" " + name[:-1], name[-1:]]
    piece = named_pieces([name])[0].decode("utf-8", "replace")
    if pattern == WORDS:
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha():
            return [piece.encode()]
        if core[-1:] in (".", ",") and core[:-1].isalpha():
            return [piece[:-1].encode(), piece[-1:].encode()]
    return [x.encode() for x in findall(piece)]


def _bytes_lists(words: list[bytes]):
    """Words as Arrow lists of their bytes."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16)))


def _blocks(batches, block_bytes: int):
    """(ids, texts, Arrow type of the ids) in blocks of about block_bytes of text."""
    keys, texts, size, key_type = [], [], 0, None
    for batch in batches:
        key_type = batch.schema.field(0).type
        for k, t in text_batches(batch, 0, 1):
            keys += k
            texts += t
            size += sum(len(x or b"") for x in t)
            if size >= block_bytes:
                yield keys, texts, key_type
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts, key_type


class CommonWords:
    """Words by hash with their ids, as three arrays. An answer counts only if its tokens' bytes are the word."""

    def __init__(self, hashes, ends, ids):
        self.hashes, self.ends, self.ids = hashes, ends, ids

    def find(self, words: list[bytes], tokens):
        """For each word its number here, or -1. tokens: token_bytes of the ranks."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        if not len(self.hashes):
            return np.full(len(words), -1)
        asked = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        at[self.hashes[at] != asked] = -1
        met = np.flatnonzero(at >= 0)
        ids, counts = gather(self.ends, self.ids, at[met])
        text, lengths = gather(*tokens, ids.astype(np.int64))
        sums = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        text, mine = text.tobytes(), [words[i] for i in met.tolist()]
        if text != b"".join(mine) or np.diff(sums).tolist() != list(map(len, mine)):
            wrong = [text[lo:hi] != w for lo, hi, w in zip(sums.tolist(), sums[1:].tolist(), mine)]
            at[met[wrong]] = -1
        return at


def token_bytes(ranks: dict[bytes, int]):
    """The bytes of all tokens in order of their ranks, and where each begins; a rank without a token has none."""
    import numpy as np

    pieces = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        pieces[rank] = word
    return np.cumsum([0, *map(len, pieces)]), np.frombuffer(b"".join(pieces), np.uint8)


def common_words(rows: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int, most: int) -> CommonWords:
    """The words that stand in the most blocks, at most `most` words and none of a single block; folded once for all tasks.

    Words of all rows are counted by block; the least count that keeps within `most` is the bound. The driver gets a
    histogram with a row for each count, and the words' hashes and ids.
    """
    import numpy as np

    def distinct(batches):
        import pyarrow as pa
        import regex

        matches = regex.compile(pattern).findall
        for _, texts, _ in _blocks(batches, block_bytes):
            pieces: set[bytes] = set()
            for t in filter(None, texts):
                pieces.update(cut_named(t) if pattern == WORDS else [b" " + t])
            words: set[bytes] = set()
            while pieces:
                words.update(_cut(pieces.pop(), matches, pattern))
            listed = list(words)
            words.clear()
            for i in range(0, len(listed), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(listed[i : i + 50_000], pa.binary())], ["word"])
            del listed
        give_back()

    counted = written(rows.mapInArrow(distinct, "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    bound, total = None, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["n"]):
        total += r["words"]
        if total > most:
            break
        bound = r["n"]
    if bound is None:
        return CommonWords(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint16))

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            words = batch.column(0).to_pylist()
            hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), _bytes_lists(words)], ["hash", "list"])

    chosen = counted.where(F.col("n") >= bound).select("word").mapInArrow(hashed, "hash long, list array<smallint>")
    table = chosen.select("hash", encode_words(F.col("list"), ranks).alias("ids")).toArrow()
    hashes = table.column("hash").to_numpy().view(np.uint64)
    lists = table.column("ids").combine_chunks()
    ids = lists.values.to_numpy()[lists.offsets[0].as_py() :].astype(np.uint16)
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    by = np.argsort(hashes, kind="stable")
    ids, lengths = gather(ends, ids, by)
    return CommonWords(hashes[by], np.concatenate([[0], np.cumsum(lengths)]), ids)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8_000_000, count_bytes: int | None = None, most_common: int = 2_000_000) -> DataFrame:
    """Encode every whole text: a row (id column, ids array of int, ids_bytes little-endian unsigned 32-bit, decoded bytes) for each document.

    Texts are cut by `pattern` and each match is encoded separately. Up to most_common words that stand in several
    blocks of count_bytes (three blocks) are folded first and broadcast as arrays of hashes and ids, some 20 bytes a word whatever the input. Then a
    task reads its rows in blocks of block_bytes of text: first come the block's other distinct words, which Spark folds
    to ids (encode_words), then its documents as ids with marks for those words, which the folded ids replace. `decoded` joins
    the bytes of the tokens that the ids name. Texts are not shuffled, and memory is bounded by a block, or by the longest text.

    Null and empty texts have no ids. Null ids, repeated rows and rows that share an id are kept; other columns are
    ignored, whatever their names. Texts of any length are taken whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = load_ranks(ranks_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common = spark.sparkContext.broadcast(common_words(rows, ranks, pattern, count_bytes or 3 * block_bytes, most_common))
    tokens = token_bytes(ranks)

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        matches = regex.compile(pattern).findall
        table = common.value
        for keys, texts, key_type in _blocks(batches, block_bytes):
            names, held = _pieces(texts, pattern)
            texts.clear()
            named: defaultdict = defaultdict()
            named.default_factory = named.__len__
            of_piece, ends = array("I"), [0]
            for name in names:
                of_piece.extend(map(named.__getitem__, _cut(name, matches, pattern)))
                ends.append(len(of_piece))
            del names
            words = list(named)
            named.clear()
            found = table.find(words, tokens)
            new = np.flatnonzero(found < 0)
            for i in range(0, len(new), 10_000):
                part = [words[k] for k in new[i : i + 10_000].tolist()]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), key_type), _bytes_lists(part), pa.nulls(len(part), pa.binary())], ["id", "word", "marked"])
            # ids of words: those of the common ones, and for the others marks in the order in which they were sent
            lengths = np.ones(len(words), np.int64)
            old = np.flatnonzero(found >= 0)
            lengths[old] = np.diff(table.ends)[found[old]] if len(old) else 0
            word_ends = np.concatenate([[0], np.cumsum(lengths)])
            word_ids = np.empty(int(word_ends[-1]), np.uint32)
            mine = np.repeat(found >= 0, lengths)
            word_ids[mine] = gather(table.ends, table.ids, found[old])[0]
            word_ids[~mine] = np.arange(len(new), dtype=np.uint32) | np.uint32(1 << 31)
            ends = np.array(ends, np.int64)
            piece_ids, lengths = gather(word_ends, word_ids, np.frombuffer(of_piece, np.uint32).astype(np.int64))
            piece_ends = np.concatenate([[0], np.cumsum(lengths)])[ends]
            start = size = 0
            for i, r in enumerate(held):
                size += len(r)
                if size > BATCH_PIECES or i == len(held) - 1:
                    some = held[start : i + 1]
                    at = np.concatenate(some).astype(np.int64)
                    ids, lengths = gather(piece_ends, piece_ids, at)
                    sums = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum([len(x) for x in some])])]
                    marked = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((4 * sums).astype("<i4").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[start : i + 1], key_type), pa.nulls(len(some), pa.list_(pa.int16())), marked], ["id", "word", "marked"])
                    start, size = i + 1, 0
        give_back()

    def join(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists, open_ = [], False  # the folded words of a block, and whether more may come
        for batch in batches:
            given = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            # a batch may hold the end of a block's words, documents, and the next block's words
            edges = np.flatnonzero(np.diff(given)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(given)]):
                part = batch.slice(lo, hi - lo)
                if not given[lo]:
                    if not open_:
                        lists, open_ = [], True
                    lists.append(part.column(1))
                    continue
                if open_:
                    words = pa.concat_arrays(lists)
                    starts = words.offsets.to_numpy().astype(np.int64)
                    flat, open_ = words.values.to_numpy().astype("<u4"), False
                # Spark's batches hold thousands of documents, whatever their length
                run = np.cumsum(pc.binary_length(part.column(2)).to_numpy()) // BATCH_BYTES
                starts_at = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
                for some in (part.slice(i, k - i) for i, k in zip(starts_at, starts_at[1:])):
                    texts = some.column(2).to_pylist()
                    marked = np.frombuffer(b"".join(texts), "<u4")
                    counts = np.array([len(t) // 4 for t in texts])
                    mark = marked >> 31 == 1
                    if mark.any():
                        at = (marked[mark] & 0x7FFFFFFF).astype(np.int64)
                        lengths = np.ones(len(marked), np.int64)
                        lengths[mark] = starts[at + 1] - starts[at]
                        folded = np.repeat(mark, lengths)
                        ids = np.empty(len(folded), "<u4")
                        ids[~folded] = marked[~mark]
                        ids[folded] = gather(starts, flat, at)[0]
                        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                    else:
                        ids, ends = marked, np.concatenate([[0], np.cumsum(counts)])
                    data, offsets = pa.py_buffer(ids.tobytes()), ends.astype(np.int32)
                    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, data])
                    raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * offsets).tobytes()), data])
                    text, lengths = gather(*tokens, ids.astype(np.int64))
                    sums = np.concatenate([[0], np.cumsum(lengths)])[ends].astype(np.int32)
                    decoded = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(sums.tobytes()), pa.py_buffer(text.tobytes())])
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), raw, decoded], [id_col, "ids", "ids_bytes", "decoded"])
        give_back()

    cut_rows = rows.mapInArrow(cut, f"id {kind}, word array<smallint>, marked binary")
    folded = cut_rows.select("id", F.when(F.col("marked").isNull(), encode_words(F.col("word"), ranks)).alias("ids"), "marked")
    return folded.mapInArrow(join, f"`{id_col}` {kind}, ids array<int>, ids_bytes binary, decoded binary")


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes (binary) of an array of ids: their binary pieces, concatenated. Null gives null; an id without a token is left out."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        pieces[rank] = word
    # one literal: the pieces as strings of their bytes, valid or not, which array_join puts together as they are
    table = F.expr("cast(array(" + ",".join(f"X'{p.hex()}'" for p in pieces) + ") AS array<string>)")
    return F.get(F.transform(F.array(table), lambda named: F.array_join(F.transform(ids, lambda i: F.get(named, i)), "")), F.lit(0)).cast("binary")
