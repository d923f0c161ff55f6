"""Token-ID files: flat unsigned integers, 64-bit document offsets, one manifest.

A folder holds for each partition NAME.ids (flat unsigned 16- or 32-bit little-endian ids), NAME.off (unsigned 64-bit
offsets of its documents within the partition, one more than documents) and NAME.doc (64-bit document ids; a leading
run of documents without id is counted in the manifest), and manifest.json with each partition's first document and
first token. Only files that the manifest names count, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.llm.pieces import shared_encoder, text_batches


def _open(folder: str):
    from pyarrow import fs

    scheme, sep, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> dict:
    """Encode every whole text, append end_id, and write the ids in ascending order of the id column; returns the manifest.

    Rows are dealt by ranges of (id, hash of the text, place) and sorted within each, so a third of all rows may be equal.
    Each task streams its ids to files of its own name; the driver gets one row of counts for each partition and turns
    them into bases by prefix sums. Null ids come first, null texts are empty documents (end_id alone), repeated rows
    are kept, other columns are ignored, an empty table gives a manifest without documents.
    """
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        fs_, root = _open(folder)
        fs_.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        kind = "<u4" if wide else "<u2"
        encoder, end = shared_encoder(tokenizer_path, spaced=True), np.array([end_id], "<u4").tobytes()
        lengths, keys_out, nulls = [], [], 0
        with fs_.open_output_stream(f"{root}/{name}.ids") as out:
            for batch in batches:
                for keys, texts in text_batches(batch, 0, 1):
                    found = [x + end for x in encoder.encode(texts)]
                    out.write(np.frombuffer(b"".join(found), "<u4").astype(kind).tobytes())
                    lengths.append(np.array([len(x) // 4 for x in found], np.uint64))
                    nulls += sum(k is None for k in keys)
                    keys_out.append(np.array([0 if k is None else k for k in keys], np.int64))
        sizes = np.concatenate([np.zeros(1, np.uint64), *lengths])
        if len(sizes) == 1:
            return
        with fs_.open_output_stream(f"{root}/{name}.off") as out:
            out.write(np.cumsum(sizes, dtype=np.uint64).astype("<u8").tobytes())
        with fs_.open_output_stream(f"{root}/{name}.doc") as out:
            out.write(np.concatenate(keys_out).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(sizes) - 1], "nulls": [nulls], "tokens": [int(sizes.sum())]})

    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers: the files keep ids of 64 bits")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    keys = [F.col("id"), F.xxhash64("text"), F.col("nth")]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    counts = dealt.sortWithinPartitions(*keys).mapInArrow(run, "part long, name string, docs long, nulls long, tokens long").collect()
    parts, first_doc, first_token = [], 0, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        parts.append({"name": r["name"], "docs": r["docs"], "nulls": r["nulls"], "tokens": r["tokens"], "first_doc": first_doc, "first_token": first_token})
        first_doc, first_token = first_doc + r["docs"], first_token + r["tokens"]
    manifest = {"dtype": "<u4" if wide else "<u2", "documents": first_doc, "tokens": first_token, "parts": parts}
    fs_, root = _open(folder)
    fs_.create_dir(root, recursive=True)
    with fs_.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the files: id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    Files in a mounted folder are memory-mapped; others are read as a stream, a few megabytes at a time.
    """
    fs_, root = _open(folder)
    with fs_.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest["dtype"]
    schema = f"`{id_col}` long, start long, n_tokens long, ids binary"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        fs_, root = _open(folder)
        width = int(kind[-1])

        def slices(path, bounds):
            """ids between neighbouring bounds, as 32-bit bytes."""
            if isinstance(fs_, fs.LocalFileSystem):
                ids = np.memmap(path, kind, "r")
                for a, b in zip(bounds, bounds[1:]):
                    yield ids[a:b].astype("<u4").tobytes()
            else:
                with fs_.open_input_stream(path) as f:
                    for a, b in zip(bounds, bounds[1:]):
                        yield np.frombuffer(f.read(width * (b - a)), kind).astype("<u4").tobytes()

        def load(path, dtype):
            with fs_.open_input_stream(path) as f:
                return np.frombuffer(f.read(), dtype)

        for batch in batches:
            for p in batch.to_pylist():
                off, keys = load(f"{root}/{p['name']}.off", "<u8").tolist(), load(f"{root}/{p['name']}.doc", "<i8").tolist()
                rows, size = [], 0
                for i, ids in enumerate(slices(f"{root}/{p['name']}.ids", off)):
                    rows.append((None if i < p["nulls"] else keys[i], p["first_token"] + off[i], len(ids) // 4, ids))
                    size += len(ids) + 40
                    if size > 4_000_000 or i == len(keys) - 1:
                        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                        yield pa.RecordBatch.from_arrays(cols, [id_col, "start", "n_tokens", "ids"])
                        rows, size = [], 0

    parts = [(p["name"], p["nulls"], p["first_token"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "name string, nulls long, first_token long").repartition(len(parts))
    return listed.mapInArrow(run, schema)
