"""Encoding with the tokenizers library, each distinct piece of text once.

A tokenizer that splits a text into words before it merges gives each word the same ids wherever it stands. Texts are
therefore cut where the tokenizer is sure to cut as well, each distinct piece is encoded by the library once, and a
text's ids are its pieces' ids in order. Whole texts are encoded; nothing is shortened.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections import defaultdict

#: Unicode's White_Space, as the tokenizers' patterns understand \s (Python's own \s also has U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beyond ASCII, some of it told by a regular expression.
_ODD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_ODD_GENERAL = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")


def _is_odd(t: bytes) -> bool:
    """Whether white space stands beside white space, or other white space than space and line feed stands anywhere."""
    if b"  " in t or b"\n\n" in t or b" \n" in t or b"\n " in t or b"\t" in t or b"\r" in t or b"\x0b" in t or b"\x0c" in t:
        return True
    return not t.isascii() and (any(x in t for x in _ODD) or (b"\xe2\x80" in t and _ODD_GENERAL.search(t) is not None))


def cut_spaced(text: bytes) -> list[bytes]:
    """Pieces that keep their leading white space, for tokenizers whose words may begin with a space.

    No word of such a tokenizer holds white space after another character, so a cut before white space that follows
    another character is safe. The pieces joined are the text.
    """
    if _is_odd(text):
        return [x.encode() for x in _CHUNK.findall(text.decode("utf-8", "replace"))]
    first, *rest = text.replace(b"\n", b" \n").split(b" ")
    out = [x if x[:1] == b"\n" else b" " + x for x in rest]
    return [first, *out] if first else out


def cut_named(text: bytes) -> list[bytes]:
    """The pieces of cut_spaced by short names: what one space or a line feed begins, without that space; others after a space."""
    if _is_odd(text):
        return [x[1:] if x[:1] == b" " and x[1:2] not in (b" ", b"\n") else b" " + x for x in cut_spaced(text)]
    names = text.replace(b"\n", b" \n").split(b" ")
    if names[0]:
        names[0] = b" " + names[0]
        return names
    return names[1:]


def named_pieces(names: list[bytes]) -> list[bytes]:
    """The pieces that cut_named gives these names."""
    return [x[1:] if (first := x[:1]) == b" " else x if first == b"\n" else b" " + x for x in names]


def number_named(texts: list[bytes | None]):
    """(names, numbers): names that hold all that cut_named gives for the texts, and each text's as an array of their numbers.

    Arrow cuts and numbers all texts at once, but for odd and huge ones. A few names may stand twice or in no text.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    numbers, names, firsts, rest = [np.zeros(0, np.int32)] * len(texts), [], {}, {}
    for i, t in enumerate(texts):
        if t and len(t) < 1 << 28 and not _is_odd(t):
            first, space, after = t.replace(b"\n", b" \n").partition(b" ")
            firsts[i], rest[i] = first, space + after
    if rest:
        at = np.cumsum([0, *map(len, rest.values())], dtype=np.int32)
        lists = pc.split_pattern(pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(at), pa.py_buffer(b"".join(rest.values()))]), " ")
        found = lists.values.dictionary_encode()
        flat, ends = found.indices.to_numpy().copy(), lists.offsets.to_pylist()
        _, at, data = found.dictionary.buffers()
        data = data.to_pybytes()
        names = [data[lo:hi] for lo, hi in itertools.pairwise(np.frombuffer(at, np.int32)[: len(found.dictionary) + 1].tolist())]
    more: defaultdict[bytes, int] = defaultdict()
    more.default_factory = lambda known=len(names): known + len(more)
    for k, (i, first) in enumerate(firsts.items()):
        # an empty piece stands before a text's first space
        if first:
            flat[ends[k]] = more[b" " + first]
        numbers[i] = flat[ends[k] + (not first) : ends[k + 1]]
    for i, t in enumerate(texts):
        if t and i not in firsts:
            numbers[i] = np.array([more[x] for x in cut_named(t)], np.int32)
    return [*names, *more], numbers


def cut_words(text: bytes) -> list[bytes]:
    """Pieces between ASCII white space, for tokenizers that drop white space and case.

    A-Z is lower-cased here unless the text holds combining marks, which can join a capital and its small letter to
    different characters before the tokenizer lower-cases them, or what may begin a special token's string.
    """
    return (text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()).split()


#: A letter or digit, at the end of a piece: ASCII, or Latin-1 letters.
_WORD_END = re.compile(rb"(?:[0-9A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")


def without_tail(piece: bytes) -> bytes:
    """The piece without stops and signs at its end, if a letter or digit stands before them: the tokenizers cut there."""
    core = piece.rstrip(b".,;:!?#$%&*")
    return core if len(core) < len(piece) and _WORD_END.search(core) else piece


def gather(ends, flat, at):
    """The lists `at` of (ends, flat), one after another, and the length of each; list i is flat[ends[i] : ends[i + 1]]."""
    import numpy as np

    lengths = ends[at + 1] - ends[at]
    shift = ends[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(at) else lengths
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths


#: Pieces that the library gets as one text.
GROUP = 500


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers; remembers up to `most` pieces.

    Pieces are numbered as they are met; the ids of piece i are ids[ends[i] : ends[i + 1]]. A special token's string in a
    text gives its id, as the library does by default; with plain_specials it is ordinary text. Such strings must not hold
    white space.
    """

    def __init__(self, tokenizer_path: str, spaced: bool, plain_specials: bool = False, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.cut, self.pieces, self.alone = (cut_named, named_pieces, b" ") if spaced else (cut_words, list, b"")
        plain = [(t.content.encode(), k) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.between = plain[0] if plain and not plain_specials else None
        self.most = most
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.numbers.clear()
        self.ends, self.ids, self.met = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _keep_met(self) -> None:
        """Keep the pieces that were met more than once since the last time, if they are less than half."""
        import numpy as np

        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > self.most:
            return self._forget()
        kept = list(itertools.compress(self.numbers, (self.met > 1).tolist()))
        self.numbers.clear()
        self.numbers.update(zip(kept, range(len(kept))))
        self.ids, lengths = gather(self.ends, self.ids, keep)
        self.ends, self.met = np.concatenate([[0], np.cumsum(lengths)]), np.ones(len(kept), np.int64)

    def _since(self, known: int) -> list[bytes]:
        """The pieces numbered from `known` on."""
        return list(itertools.islice(reversed(self.numbers), len(self.numbers) - known))[::-1]

    def _ask(self, names: list[bytes]):
        """The pieces' ids by the library, one after another, and the number of each piece's.

        A special token cuts a text before all else, so pieces with one between them are encoded as each alone.
        """
        import numpy as np

        pieces = self.pieces(names)
        if self.between is None:
            return self._ask_each(pieces)
        token, mark = self.between
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 40 * GROUP):
            groups = [pieces[k : k + GROUP] for k in range(i, min(i + 40 * GROUP, len(pieces)), GROUP)]
            texts = [token.join([*g, b""]) for g in groups]
            for group, text, e in zip(groups, texts, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(found == mark)
                # a piece may hold that token itself, or one end of another that the join makes
                ok = len(ends) == len(group) == text.count(token)
                some, many = (found[found != mark], np.diff(ends, prepend=-1) - 1) if ok else self._ask_each(group)
                ids.append(some)
                lengths.append(many)
        return np.concatenate(ids), np.concatenate(lengths)

    def _ask_each(self, pieces: list[bytes]):
        import numpy as np

        got = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces], add_special_tokens=False)]
        return np.array([x for ids in got for x in ids], np.uint32), np.array([len(x) for x in got], np.int64)

    def _learn(self, known: int) -> None:
        """ids of the pieces numbered from `known` on, which may be a word and the stops after it."""
        import numpy as np

        numbers, alone = self.numbers, self.alone
        pieces, whole, parts = self._since(known), [], []
        for i, x in enumerate(pieces):
            if not x[-1:].isalpha() and (core := without_tail(x)) is not x:
                whole.append(i)
                parts += numbers[core], numbers[alone + x[len(core) :]]
        pieces += self._since(known + len(pieces))
        single = np.ones(len(pieces), bool)
        single[whole] = False
        ids, asked = self._ask([x for x, one in zip(pieces, single.tolist()) if one])
        # the lists known so far and those just asked for, of which each new piece takes one, or two if it has stops
        ends, ids = np.concatenate([self.ends, self.ends[-1] + np.cumsum(asked)]), np.concatenate([self.ids, ids])
        place = np.arange(known + len(pieces))
        place[known:][single] = known + np.arange(len(asked))
        lists = np.ones(len(pieces), np.int64)
        lists[whole] = 2
        first = np.cumsum(lists) - lists
        at = np.empty(int(lists.sum()), np.int64)
        at[first[single]] = place[known:][single]
        parts = np.array(parts, np.int64)
        pairs = place[parts.reshape(-1, 2)]
        at[first[~single]], at[first[~single] + 1] = pairs[:, 0], pairs[:, 1]
        made, lengths = gather(ends, ids, at)
        self.ids = np.concatenate([self.ids, made])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.add.reduceat(lengths, first))])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int64)]) + np.bincount(parts, minlength=known + len(pieces))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        import numpy as np

        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.numbers) > self.most:
            self._keep_met()
        known, counts = len(self.numbers), list(map(len, cut))
        at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(cut)), np.int64, sum(counts))
        if len(self.numbers) > known:
            self._learn(known)
        self.met += np.bincount(at, minlength=len(self.met))
        ids, lengths = gather(self.ends, self.ids, at)
        ends = 4 * np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


@functools.lru_cache(maxsize=4)
def shared_encoder(tokenizer_path: str, spaced: bool, plain_specials: bool = False, most: int = 1_000_000) -> PieceEncoder:
    """One encoder for all tasks of a Python worker, which so remembers pieces between them."""
    return PieceEncoder(tokenizer_path, spaced, plain_specials, most)


def text_batches(batch, id_col: int, text_col: int, most_bytes: int = 4_000_000):
    """(doc ids, texts as bytes) of an Arrow batch, in runs of about most_bytes; only one run's texts are made at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(text_col)
    sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = before = 0
    while start < len(sums):
        end = min(int(np.searchsorted(sums, before + most_bytes)) + 1, len(sums))
        yield batch.column(id_col).slice(start, end - start).to_pylist(), texts.slice(start, end - start).cast(pa.binary()).to_pylist()
        start, before = end, int(sums[end - 1])
