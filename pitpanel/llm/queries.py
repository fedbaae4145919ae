"""The queries of this subpackage: thin calls of its operators on whole tables, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitpanel.llm import embeddings, exactdedup, html, langid, langmodel, licenses, mixing, packing, prefixtrie, simhash, toolcalls, topk, vectorcodes
from pitpanel.llm.common import table, tokenizer_file

Plan = Callable[[SparkSession, str], DataFrame]


def op1_source_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.select(table(spark, sf, "documents"))


def op2_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return langmodel.score(table(spark, sf, "documents"))


def op3_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).drop("rid")


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages"))


def op5_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


def op6_tool_call_chats(spark: SparkSession, sf: str) -> DataFrame:
    return toolcalls.chats(table(spark, sf, "conversations"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.sequences(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return exactdedup.duplicates(docs, exactdedup.by_age()).drop("rid")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf, "conversations"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf, "embeddings"))


def op13_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.every_twentieth(table(spark, sf, "embeddings"))


QUERIES: dict[str, Plan] = {f.__name__: f for f in (
    op1_source_mixture, op2_lm_score, op3_simhash_neardup, op4_html_text, op5_embedding_neardup, op6_tool_call_chats,
    op7_best_fit_packing, op8_exact_dedup, op9_language_id,
    op10_license_scan, op11_prefix_trie, op12_vector_codes, op13_topk_search,
)}

SQL: dict[str, str] = {"op1_source_mixture": mixing.oracle(), "op6_tool_call_chats": toolcalls.ORACLE,
                       "op11_prefix_trie": prefixtrie.ORACLE, "op12_vector_codes": vectorcodes.ORACLE, "op13_topk_search": topk.ORACLE}
