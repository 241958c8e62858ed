"""Registered queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, language_id, line_templates, ngram_join, packing, part_codes, pii, quality_rules, simplex_clusters, source_mixing, token_counts, twins


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.verdicts(docs, rules).select("doc_id", *counts, "base_failed", "kept", "rule")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.read_back(chat_format.examples(rows.union(more)))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, decoded=byte_bpe.Decoder(ranks))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_counts.Vocabulary.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count(table(spark, folder, "documents"), vocabulary)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.recurring(table(spark, folder, "documents"))


def op11_simplex_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return simplex_clusters.digest(*simplex_clusters.cluster(table(spark, folder, "embeddings")))


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_part_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    books = part_codes.fit(vectors)
    return part_codes.digest(part_codes.encode(vectors, books, ["vec_id", "label"]), books)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_format": op3_chat_format,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_line_templates": op10_line_templates,
    "op11_simplex_clusters": op11_simplex_clusters,
    "op12_source_mixing": op12_source_mixing,
    "op13_part_codes": op13_part_codes,
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": twins.EXACT_DEDUP,
    "op11_simplex_clusters": twins.simplex_clusters(),
    "op12_source_mixing": twins.SOURCE_MIXING,
    "op13_part_codes": twins.part_codes(),
}
