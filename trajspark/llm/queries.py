"""Queries of the operators over the given tables, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import oracle
from trajspark.llm.textbuf import small_batches

WORD_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.langid import held_out
    from trajspark.llm.lm import score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    return score_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.token_counts import TokenCountCache

    return TokenCountCache(spark).count(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.linededup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.pii import KINDS, pseudonymize

    found = pseudonymize(table(spark, sf_dir, "documents"), b"key of the registered query")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", "n_found", *counts, "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.langid import held_out
    from trajspark.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, fit(docs, labels.where(~held_out(5)))).withColumn("held_out", held_out(5))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.langid import fit, held_out, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(5)))
    return predict(docs, model).withColumn("held_out", held_out(5))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajspark.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {"op12_vector_codes": oracle.vector_codes(), "op13_filter_audit": oracle.FILTER_AUDIT}
