import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from causalframe.llm import byte_bpe, packing, token_files
from causalframe.llm.common import scratch

SF = "/root/testdata/sf0.001"


def library_ids(name, texts, end):
    t = Tokenizer.from_file(P.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def whole(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_best_fit_against_scan():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 500).tolist()
    windows = packing.best_fit(sizes, 100)
    rooms, plain = [], []
    for i in sorted(range(500), key=lambda i: -sizes[i]):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            best = min(r for r, _ in fits)
            w = next(w for r, w in fits if r == best)
            rooms[w] -= sizes[i]
        else:
            rooms.append(100 - sizes[i])
    assert sorted(i for w in windows for i in w) == list(range(500))
    assert len(windows) == len(rooms)
    assert sorted(100 - sum(sizes[i] for i in w) for w in windows) == sorted(rooms)


@pytest.mark.parametrize("edge", [True, False])
def test_packing(spark, docs, texts, edge):
    df = docs if edge else whole(spark)
    rows = packing.pack_documents(df, P.path("word_bpe_49k.json"), window=512 if edge else 4096).collect()
    window = 512 if edge else 4096
    want = defaultdict(list)
    source = texts if edge else [tuple(r) for r in df.select("doc_id", "text").collect()]
    for (i, _), ids in zip(source, library_ids("word_bpe_49k.json", [t for _, t in source], 2)):
        want[i].append(np.array(ids, "<u4").tobytes())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, docs_ids in want.items():
        if len(docs_ids) == 1:
            assert b"".join(p[1] for p in sorted(pieces[i])) == docs_ids[0]
            at = 0
            for start, ids, total in sorted(pieces[i]):
                assert start == at and total == len(docs_ids[0]) // 4
                at += len(ids) // 4
        else:
            assert sum(len(p[1]) for p in pieces[i]) == sum(map(len, docs_ids))
    padding = total = 0
    for seq in seqs.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.01 * total
    assert set(want) == set(pieces)


@pytest.mark.parametrize("edge", [True, False])
def test_token_files(spark, docs, texts, edge):
    df = docs if edge else whole(spark)
    source = texts if edge else [tuple(r) for r in df.select("doc_id", "text").collect()]
    folder = scratch(spark, "test")
    manifest = token_files.write_token_files(df, folder, P.path("byte_bpe_50k.json"), partitions=4)
    got = token_files.read_token_files(spark, folder).collect()
    ids = library_ids("byte_bpe_50k.json", [t for _, t in source], 0)
    order = sorted(range(len(source)), key=lambda k: -1 if source[k][0] is None else source[k][0])
    assert manifest["documents"] == len(source) and manifest["tokens"] == sum(map(len, ids))
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(source[k][0]), np.array(ids[k], "<u4").tobytes()) for k in order)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)


@pytest.mark.parametrize("edge", [True, False])
def test_byte_bpe(spark, docs, texts, edge):
    df = docs if edge else whole(spark)
    source = texts if edge else [tuple(r) for r in df.select("doc_id", "text").collect()]
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode_texts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_bytes=30_000)
    got = out.select("*", byte_bpe.decode_ids(out["ids"], ranks).alias("back")).collect()
    want = sorted((str(i), library.encode_ordinary(t or "")) for i, t in source)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(np.array(r.ids, "<u4").tobytes() == bytes(r.ids_bytes) for r in got)
    assert sorted(hashlib.sha256(bytes(r.back)).hexdigest() for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in source)


def test_special_strings():
    """By default the library's own reading of special tokens' strings; with plain_specials they are ordinary text."""
    from causalframe.llm.pieces import PieceEncoder

    made = ["a<|endoftext|>b", "x <|endoftext|> y.", "<|endoftext|>", "<|ENDOFTEXT|> A<|endoftext|>, <|startoftext|>Z", "two\n<|endoftext|>\n\nlines  <|endoftext|>"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for plain in (False, True):
            t = Tokenizer.from_file(P.path(name))
            t.encode_special_tokens = plain
            got = PieceEncoder(P.path(name), spaced, plain).encode([x.encode() for x in made])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in made]


def test_equal_rows_and_ids(spark):
    folder = scratch(spark, "test")
    equal = spark.range(4000).selectExpr("cast(7 as int) as doc_id", "'the same text' as text")
    manifest = token_files.write_token_files(equal, folder, P.path("byte_bpe_50k.json"), partitions=4)
    assert manifest["documents"] == 4000 and max(p["docs"] for p in manifest["parts"]) < 2000
    assert token_files.read_token_files(spark, folder).count() == 4000
    with pytest.raises(TypeError):
        token_files.write_token_files(equal.selectExpr("cast(doc_id as string) as doc_id", "text"), folder, P.path("byte_bpe_50k.json"))


def test_common_words_with_high_ids(spark):
    """Words of several blocks whose ids lie beyond 32767."""
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    word = next(w.decode() for w, r in sorted(ranks.items()) if r > 49_000 and w.decode("utf-8", "replace").strip().isalpha() and w[:1] == b" ")
    rows = spark.createDataFrame([(i, f"{word} n{i} " * 40) for i in range(60)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode_texts(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_bytes=2000).collect()}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: library.encode_ordinary(f"{word} n{i} " * 40) for i in range(60)}


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.encode_texts(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    folder = scratch(spark, "test")
    assert token_files.write_token_files(none, folder, P.path("byte_bpe_50k.json"))["documents"] == 0
    assert token_files.read_token_files(spark, folder).count() == 0


def test_crc(spark, docs):
    from pyspark.sql import functions as F

    r = packing.pack_documents(docs, P.path("word_bpe_49k.json")).select("ids", F.crc32("ids").alias("c")).first()
    assert zlib.crc32(bytes(r.ids)) == r.c


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_are_asked_in_groups(name, spaced):
    from causalframe.llm.pieces import PieceEncoder

    class Counted:
        def __init__(self, inner):
            self.inner, self.sequences = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.sequences += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    made = [" ".join(f"w{i}x{k}{'!!' * (i % 2)}" for i in range(400)) for k in range(5)]
    made += ["a<|endoftext|>b <|endof text|> <|endoftext|>! c", " \n x ", "", "a\nb !", "  d"]
    encoder = PieceEncoder(P.path(name), spaced, most=1000)
    encoder.tokenizer = Counted(encoder.tokenizer)
    for _ in range(2):  # the second time some pieces have been forgotten
        for part in (made[:3], made[3:5], made[5:]):
            got = encoder.encode([x.encode() for x in part])
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids[:-1] for ids in library_ids(name, part, 0)]
    assert encoder.tokenizer.sequences < 100


def test_bpe_puts_long_batches_together_in_parts(spark, monkeypatch):
    texts = [(i, None if i == 3 else f"Ünder x{i} the  {i * i}, fox!\n" * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 700)
    asked = []
    monkeypatch.setattr(byte_bpe, "common_words", lambda *a, f=byte_bpe.common_words: asked.append(a[3]) or f(*a))
    tk = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in byte_bpe.encode_texts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, block_bytes=3000).collect()}
    assert got == {i: (tk.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts}
    assert asked == [9000]


def test_common_words_only_count_if_their_bytes_agree():
    from xxhash import xxh3_64_intdigest

    tokens = byte_bpe.token_bytes({b"a": 0, b"bc": 1, b"d": 3})
    words = sorted([b"abc", b"bcd", b"dd"], key=xxh3_64_intdigest)
    lists = {b"abc": [0, 1], b"bcd": [1, 3], b"dd": [3, 0]}  # the last is another word's answer
    table = byte_bpe.CommonWords(np.array([xxh3_64_intdigest(w) for w in words], np.uint64), np.array([0, 2, 4, 6]), np.array([i for w in words for i in lists[w]], np.uint16))
    assert table.find([b"bcd", b"zz", b"abc", b"dd"], tokens).tolist() == [words.index(b"bcd"), -1, words.index(b"abc"), -1]
    assert table.find([b"abc"], tokens).tolist() == [words.index(b"abc")]


def test_fold_works_out_slots_in_few_steps(spark):
    """The numbers of a pair's two slots come from its ids directly: the fold's expression stays short."""
    from pyspark.sql import functions as F

    from causalframe.llm import byte_bpe

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257}
    text = str(byte_bpe.encode_words(F.col("word"), ranks))
    assert text.count("*") <= 40 and text.count("shiftright") <= 10


def test_packing_holds_one_run_of_texts_at_a_time():
    """Of a batch only a run's texts are made, in order, whatever their lengths; what a worker remembers is bounded."""
    import tracemalloc

    import pyarrow as pa

    from causalframe.llm.pieces import text_batches

    made = [None, "", "ü" * 700_000, *(f"{i} " * 5000 for i in range(1000)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(made)], ["id", "text"]).slice(1)
    tracemalloc.start()
    got, sizes = [], []
    for keys, texts in text_batches(batch, 0, 1, packing.RUN_BYTES):
        got += [(k, None if t is None else zlib.crc32(t)) for k, t in zip(keys, texts)]
        sizes.append(sum(len(t or b"") for t in texts))
        del texts
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(k, None if t is None else zlib.crc32(t.encode())) for k, t in enumerate(made)][1:]
    assert peak < 6_000_000 < sum(sizes) and max(sizes) < 2_500_000
    assert packing.MOST_PIECES <= 300_000


def test_texts_are_numbered_as_they_are_cut():
    """The same pieces as one text after another, and the pattern's own matches in each."""
    import regex

    from causalframe.llm.pieces import cut_named, number_named

    made = [None, b"", b" ", b"\n", b"one", b" one two", b"one two\nthree, four. f\xc3\xbcr,", b"\ntwo", b"a  b", b"x\n\ny one", "em space".encode(), b"end ", b"it's 42,000 <|x|> don't", b"one two", b"bad \xff byte"]
    names, numbers = number_named(made)
    assert [[names[k] for k in x.tolist()] for x in numbers] == [cut_named(t) if t else [] for t in made]
    assert number_named([]) == ([], []) and [len(x) for x in number_named([None, b"a  b"])[1]] == [0, 2]
    matches = regex.compile(P.PATTERN).findall
    for t, x in zip(made, numbers):
        assert [w for k in x.tolist() for w in byte_bpe._cut(names[k], matches, P.PATTERN)] == [w.encode() for w in matches((t or b"").decode("utf-8", "replace"))]
    whole_names, whole = byte_bpe._pieces(made, r"\w+|\W+")
    assert [[whole_names[k] for k in x.tolist()] for x in whole] == [[b" " + t] if t else [] for t in made]


def test_fold_looks_up_first_pairs_at_once(spark):
    """A word's first pairs come from one place each: the pair's two slots are worked out only after a merge."""
    from pyspark.sql import functions as F

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"\xff\xff": 258}
    assert str(byte_bpe.encode_words(F.col("word"), ranks)).count("*") <= 30
    made = [b"", b"a", b"\xff", b"abcab", b"\xff\xff\xff", b"bab\x00", None]
    rows = spark.createDataFrame([(i, None if w is None else list(w)) for i, w in enumerate(made)], "i int, word array<smallint>")
    got = {r.i: r.ids for r in rows.select("i", byte_bpe.encode_words(F.col("word"), ranks).alias("ids")).collect()}
    assert got == dict(enumerate([[], [97], [255], [257, 256], [258, 255], [98, 256, 0], None]))
