"""A training corpus from raw documents: language ID, exact and near duplicates, mixture, packing.

Every stage takes the documents the one before it kept and works on all of them; all but the last
return whole rows of documents. Rows with a NULL doc_id are rows like others; a repeated row is kept
once by the exact stage; an empty table gives empty results; columns that documents has besides its
own pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import exactdedup, langid, mixing, packing, simhash
from pitpanel.llm.common import RID, by_names, named_rows, settle, table, tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go, as do those without a letter."""
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    docs = named_rows(docs)
    found = exactdedup.duplicates(docs, exactdedup.by_age(), rid=F.col(RID))
    gone = settle(found.where("NOT kept").select(F.col("rid").alias(RID)), "exact-gone")
    return by_names(docs, gone, "left_anti")


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays."""
    docs = named_rows(docs)
    found = simhash.near_duplicates(docs, rid=F.col(RID))
    gone = settle(found.where("NOT kept").select(F.col("rid").alias(RID)), "near-gone")
    return by_names(docs, gone, "left_anti")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights: a row once per epoch that takes it.

    The document in which a leaf's budget ends is kept whole, so a leaf is over by less than that one."""
    docs = named_rows(docs)
    taken = settle(mixing.select(docs, rid=F.col(RID)).select(F.col("rid").alias(RID)), "taken")
    return by_names(docs, taken, "inner")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row per piece."""
    return packing.sequences(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_neardup", simhash_neardup),
          ("source_mixture", source_mixture), ("best_fit_packing", pack)]

#: Fingerprints, tokens and the fitted centroids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
