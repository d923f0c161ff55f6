import numpy as np
import public_tokenizers as P
import pytest
from test_jaccard import brute
from tokenizers import Tokenizer

import corpus_pipeline
from causalframe.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    held = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        held.append({r.doc_id: r.text for r in docs.collect()})
    first, second, third = held
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in first for i in clean) >= 0.98 * len(clean)
    assert sum(i in first for i, q in labels.items() if q == 0) <= 0.25 * sum(q == 0 for q in labels.values())
    assert set(third) <= set(second) <= set(first)
    assert all(i in second for i in clean if i in first and len(first[i].split()) >= 20)
    assert set(third) == {int(k) for k, _, root in brute(list(second.items()), 80, 5) if k == root}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {i: b"".join(p for _, p in sorted(x)) for i, x in pieces.items()} == {
        i: np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, text in third.items()
    }


@pytest.mark.parametrize("k", range(4))
def test_edges(spark, docs, k):
    """Null and empty texts, repeated rows and ids; columns named like a stage's own come back with their values."""
    from pyspark.sql import functions as F

    clean = "the people of the town were in the market and had seen that it was good to be there with all of their friends by the sea " * 2
    more = spark.createDataFrame([(50, clean, "en", 0, 0.5)], docs.schema)
    rows = docs.union(more).withColumnRenamed("ids", "score").withColumn("kept", F.lit("mine")).withColumn("N_WORDS", F.lit(-7)).withColumn("_row", F.struct(F.lit(1).alias("a b"))).withColumn("_hash", F.lit("h"))
    rows = written(rows, "test")
    out = corpus_pipeline.STAGES[k][1](spark, rows, SF)
    assert out.count() >= (k != 1)  # the rules may take none of them
    if k < 3:
        assert out.columns == rows.columns
        given = {str(r) for r in rows.collect()}
        assert all(str(r) in given for r in out.collect())
    assert corpus_pipeline.STAGES[k][1](spark, rows.where("false"), SF).count() == 0


def test_one_of_each_by_rows(spark):
    """Ids that stand on several texts, near copies that share an id, and rows without id."""
    one, two, three, four = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [
        (1, one), (5, one + " more"), (5, two),  # 5 is linked by one row and unique by the other
        (7, three), (7, three + " more"), (7, three),  # near copies and a repeated row of one id
        (None, two + " more"), (None, four), (None, four + " more"),
        (8, None), (8, ""), (8, ""), (None, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, df, SF).collect()]
    first = [(i, t.removesuffix(" more") if t else t) for i, t in got]
    assert sorted(first, key=str) == sorted([(1, one), (5, two), (7, three), (None, four), (8, None), (8, ""), (None, "")], key=str)
