"""Sequence packing by best-fit decreasing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causalframe.llm.common import give_back
from causalframe.llm.pieces import shared_encoder, text_batches

#: A worker remembers about so many pieces of text, some 250 bytes each, and encodes about so many bytes of text at a time.
MOST_PIECES, RUN_BYTES = 300_000, 1_000_000


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts the windows with c tokens left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_no: int) -> None:
        self.at[room].append(window_no)
        node = room + self.leaves
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The open window with the least room that is at least size, taken out: (room, window)."""
        tree, node = self.tree, size + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        window_no = self.at[room].pop()
        while node:
            tree[node] -= 1
            node >>= 1
        return room, window_no


def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Windows as lists of indices into sizes (each 1 to window), by best-fit decreasing; ties keep their order."""
    open_, out = OpenWindows(window), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_.take(sizes[i])
        if found is None:
            out.append([i])
            room, no = window, len(out) - 1
        else:
            room, no = found
            out[no].append(i)
        if room > sizes[i]:
            open_.add(room - sizes[i], no)
    return out


def lay_out(pieces: list[tuple], window: int, slack: int) -> list[list[tuple]]:
    """Sequences of pieces (key, start, ids as bytes of 4 each, document's tokens).

    Best-fit decreasing first. What stands in windows that keep more than `slack` tokens of padding is laid end to end
    and cut at full windows; the last such run is cut at powers of two, which need no padding.
    """
    out, rest = [], []
    for held in best_fit([len(p[2]) // 4 for p in pieces], window):
        if window - sum(len(pieces[i][2]) // 4 for i in held) <= slack:
            out.append([pieces[i] for i in held])
        else:
            rest += [pieces[i] for i in held]
    left = sum(len(p[2]) for p in rest) // 4
    targets = [window] * (left // window) + [1 << b for b in range(window.bit_length(), -1, -1) if left % window >> b & 1]
    k = used = 0
    for target in targets:
        seq, room = [], target
        while room:
            key, start, ids, total = rest[k]
            n = min(room, len(ids) // 4 - used)
            seq.append((key, start + used, ids[4 * used : 4 * (used + n)], total))
            room, used = room - n, used + n
            if used == len(ids) // 4:
                k, used = k + 1, 0
        out.append(seq)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, slack: int | None = None, block_tokens: int = 4_000_000) -> DataFrame:
    """Pack documents into sequences of at most `window` tokens.

    Returns a row for each piece: the id column, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A document's tokens are its whole text's ids and then end_id. Whole windows of an overlong
    document are cut off first and are sequences of their own; remainders are packed by best-fit decreasing within
    blocks of about block_tokens of one partition, so nothing is shuffled, memory is bounded by a block, and a task
    that runs again gives the same rows. A sequence is padded to the window unless its length is a power of two.

    Null text: an empty document, which is end_id alone. Null ids and repeated rows are kept, each row a document.
    Other columns are ignored. An empty table gives no rows.
    """
    slack = window // 128 if slack is None else slack
    kind = docs.schema[id_col].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer_path, spaced=False, most=MOST_PIECES)
        end = np.array([end_id], "<u4").tobytes()
        next_seq = TaskContext.get().partitionId() << 40
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def table(sequences):
            nonlocal next_seq
            rows, size = [], 0
            for seq in sequences:
                offset = 0
                for key, start, ids, total in seq:
                    rows.append((key, start, len(ids) // 4, ids, total, next_seq, offset))
                    offset += len(ids) // 4
                    size += len(ids) + 60
                next_seq += 1
                if size > 4_000_000:
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)

        def emit(rows):
            cols = list(zip(*rows))
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        pieces, held, key_type = [], 0, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for keys, texts in text_batches(batch, 0, 1, RUN_BYTES):
                full = []
                for key, ids in zip(keys, encoder.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    cut = total // window * window
                    full += [[(key, s, ids[4 * s : 4 * (s + window)], total)] for s in range(0, cut, window)]
                    if cut < total:
                        pieces.append((key, cut, ids[4 * cut :], total))
                        held += total - cut
                yield from table(full)
                if held >= block_tokens:
                    yield from table(lay_out(pieces, window, slack))
                    pieces, held = [], 0
        if pieces:
            yield from table(lay_out(pieces, window, slack))
        del pieces
        give_back()

    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
