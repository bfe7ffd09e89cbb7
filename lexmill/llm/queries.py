"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.jaccard_join import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.turns import damage, repair_report

    return repair_report(damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_html_text": op10_html_text,
    "op11_pii": op11_pii,
    "op12_whitening": op12_whitening,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES = {
    "op4_exact_dedup": """
        WITH norm AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
        FROM norm WINDOW g AS (PARTITION BY text_sha256)
    """,
}
