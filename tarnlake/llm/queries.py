"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), limit=4096)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import quotation_links, reply_order

    return reply_order(quotation_links(table(spark, sf_dir, "conversations")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("families")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import mixture

    return mixture(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=(3, 2), most=2)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_lm_score, op4_warc, op5_best_fit_packing, op6_ngram_join, op7_token_counts, op8_bpe_round_trip, op9_quotation_links, op10_nearest, op11_prefix_trie, op12_vector_codes, op13_mix)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op2_quality_rules": sql.op2(), "op4_warc": sql.OP4, "op6_ngram_join": sql.OP6, "op10_nearest": sql.OP10, "op11_prefix_trie": sql.OP11, "op12_vector_codes": sql.op12(), "op13_mix": sql.OP13}
