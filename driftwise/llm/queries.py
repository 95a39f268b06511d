"""The registered queries: every operator over its whole table, with its parameters fixed here."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm import (
    automata, decontaminate, lines, merkle, packing, perplexity, prefix_trie, run_index, secrets, simhash,
    spelling, sql, warc, wavelet,
)
from driftwise.llm.common import table, text_column


def op1_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(text_column(kept), 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_groups(table(spark, root, "documents"), width=3)


def op3_merkle(spark: SparkSession, root: str) -> DataFrame:
    return merkle.compared(table(spark, root, "documents"))


def op4_run_index(spark: SparkSession, root: str) -> DataFrame:
    return run_index.dedup_bytes(table(spark, root, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def op6_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan(table(spark, root, "documents"))


def op7_automata(spark: SparkSession, root: str) -> DataFrame:
    return automata.dedup_words(table(spark, root, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_perplexity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    return perplexity.judged(docs, table(spark, root, "labels"), settled=True).select(
        "doc_id", "lang", F.col("__dw_bits").alias("bits_per_byte"),
        F.round(F.pow(2.0, "__dw_bits"), 6).alias("perplexity"), F.col("__dw_threshold").alias("threshold"),
        F.col("__dw_accepted").alias("accepted"))


def op9_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.report(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op10_wavelet(spark: SparkSession, root: str) -> DataFrame:
    return wavelet.token_files(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_spelling(spark: SparkSession, root: str) -> DataFrame:
    return spelling.variants(table(spark, root, "documents"))


def op12_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.archived(table(spark, root, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, root, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_merkle": op3_merkle,
    "op4_run_index": op4_run_index,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_automata": op7_automata,
    "op8_perplexity": op8_perplexity,
    "op9_decontaminate": op9_decontaminate,
    "op10_wavelet": op10_wavelet,
    "op11_spelling": op11_spelling,
    "op12_warc": op12_warc,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {"op12_warc": sql.OP12, "op13_prefix_trie": sql.OP13}
