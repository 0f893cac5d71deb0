"""The opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, line_dedup, quality, topk_search, warc
from .bpe_codec import codec_digests
from .minhash_dedup import near_duplicates
from .mixing import mix_report
from .token_counts import token_counts


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the top grade and decision for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns from every participant's perspective."""
    return chat.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later occurrences of three-line windows."""
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-text groups of all documents."""
    return exact_dedup.exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of the response records of all pages."""
    return warc.derivatives(warc.response_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("record")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents, digested."""
    return codec_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.tiktoken"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("byte_bpe_50k.json"))


def op10_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    return topk_search.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_token_counts": op9_token_counts,
    "op10_topk_inner_product": op10_topk_inner_product,
}

ORACLES = {
    "op3_chat_perspectives": chat.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op10_topk_inner_product": topk_search.ORACLE,
}
