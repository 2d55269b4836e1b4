"""The queries of this subpackage over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._shared import table
from quire.llm.oracles import ORACLE_SQL as ORACLE_SQL

WORD_VOCABULARY, BYTE_VOCABULARY, RANK_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.arrowfile import encode_to_files, read_documents

    docs = table(spark, sf_dir, "documents")
    read = read_documents(docs, *encode_to_files(docs, vocabulary(BYTE_VOCABULARY)))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring import without_repeats

    kept = without_repeats(table(spark, sf_dir, "documents"), spacing=" ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licenses import matches

    return matches(table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.hosts import judged

    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lines import without_fuzzy_lines

    kept = without_fuzzy_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.classifier import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.bpe import decode, encode

    ranks = vocabulary(RANK_VOCABULARY), public_tokenizers.PATTERN
    both = decode(encode(table(spark, sf_dir, "documents"), *ranks), *ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_best_fit_packing": op2_best_fit_packing, "op3_token_files": op3_token_files, "op4_exact_topk": op4_exact_topk, "op5_substring_dedup": op5_substring_dedup, "op6_license_scan": op6_license_scan, "op7_host_rules": op7_host_rules, "op8_fuzzy_lines": op8_fuzzy_lines, "op9_rule_ensemble": op9_rule_ensemble, "op10_byte_bpe": op10_byte_bpe}
