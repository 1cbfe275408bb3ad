"""Driver queries of the training-data operators, and oracle SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    language_id,
    license_scan,
    packing,
    piece_encoding,
    prefix_trie,
    secrets,
    simhash,
    token_files,
    topk_search,
    toxicity,
    vector_codes,
)
from .common import new_path, table
from .oracles import ORACLES  # noqa: F401


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document, and the best of them: `license_scan.report`."""
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items they belong to: `decontaminate.report`."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: `simhash.report`."""
    return simhash.report(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document: `toxicity.report`."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others: `topk_search.report`."""
    return topk_search.report(table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text: `chat_format.report`."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.report(rows.unionByName(chat_format.control_conversation(spark)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences: `packing.report`."""
    return packing.report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: `secrets.report`."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: `language_id.report`."""
    return language_id.report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, read back from the ORC files: `token_files.write`, `token_files.digest`."""
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digest(spark, path)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code, error and label error of every vector: `vector_codes.report`."""
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: `prefix_trie.report`."""
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text decoded from them: `piece_encoding.report`."""
    return piece_encoding.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_decontamination, op3_simhash, op4_toxicity, op5_topk_search,
        op6_chat_format, op7_packing, op8_secrets, op9_language_id, op10_token_files,
        op11_vector_codes, op12_prefix_trie, op13_piece_encoding,
    )
}
