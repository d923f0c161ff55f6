"""From raw documents to packed training sequences: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.llm.common import ship, written
from causalframe.llm.jaccard_join import link_documents
from causalframe.llm.packing import pack_documents
from causalframe.llm.quality_classifier import classify
from causalframe.llm.quality_rules import quality_rules


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one struct, so that no name of theirs meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("_rest"))


def _given_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 8), with all their columns as they were.

    Null and empty texts are scored as texts without n-grams; repeated rows and rows that share an id are judged each by
    its text; columns may have any names; an empty table gives an empty one.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _given_back(classify(_carried(docs), labels).where("predicted = 1"), docs)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 6), with all their columns as they were.

    Null and empty texts fail; repeated rows and rows that share an id are judged each by its text; columns may have any
    names; an empty table gives an empty one.
    """
    return _given_back(quality_rules(_carried(docs)).where("kept"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more (operator 9).

    A row is told by a hash of its id and text, as an id may stand on several texts. Of each group stays the row with the
    least id (then hash; those without id last), once if it is repeated; rows without words are groups of their own. All
    columns come back as they were, whatever their names; an empty table gives an empty one.
    """
    ship(spark)
    rows = _carried(docs).withColumn("_row", F.xxhash64("doc_id", F.xxhash64("text")))
    joined = link_documents(rows.select("_row", "text"), id_col="_row", width=5, percent=80)
    groups = rows.select("_row", "doc_id").join(joined.select("_row", "component_id").distinct(), "_row")
    kept = groups.groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_row"))
    return _given_back(rows.join(kept.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids (operator 1).

    A null or empty text is a document of its end id alone; repeated rows and rows that share an id are documents each;
    other columns are left out, whatever their names; an empty table gives no pieces.
    """
    import public_tokenizers

    ship(spark)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality classifier", keep_quality), ("quality rules", keep_by_rules), ("n-gram Jaccard join", keep_one_of_each), ("packing", pack)]

#: No SQL: the classifier is trained, the packing is a greedy algorithm; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
