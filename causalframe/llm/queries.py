"""The operators' queries over whole tables: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalframe.llm import sql
from causalframe.llm.common import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from causalframe.llm.packing import pack_documents

    packed = pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from causalframe.llm.common import scratch
    from causalframe.llm.token_files import read_token_files, write_token_files

    folder = scratch(spark, "token-files")
    write_token_files(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.url_filter import filter_urls

    return filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents")).drop("spans")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.html_text import extract_text

    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.quality_rules import quality_rules

    judged = quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.embedding_dedup import link_vectors

    return link_vectors(_read(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.quality_classifier import classify

    judged = classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from causalframe.llm.jaccard_join import link_documents

    return link_documents(_read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from causalframe.llm.byte_bpe import encode_texts

    ids = encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_token_files, op3_url_filter, op4_license_scan, op5_html_text, op6_quality_rules, op7_embedding_dedup, op8_quality_classifier, op9_jaccard_join, op10_byte_bpe,
)}
SQL: dict[str, str] = {
    "op3_url_filter": sql.OP3, "op4_license_scan": sql.OP4, "op6_quality_rules": sql.OP6, "op7_embedding_dedup": sql.OP7, "op9_jaccard_join": sql.OP9,
}
