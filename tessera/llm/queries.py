"""Registered queries of the training-data operators.

Every query reads its whole table with production parameters and derives the
contract's columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chat_format, collocations, decontaminate, fill_in_middle, golay_simhash, jaccard_join, oracles, packing, page_template, quality_classifier, quality_rules, sharding, substring_dedup,
    url_filter)

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select("doc_id", *[F.col(f"measures.{m}").alias(m) for m in
                                  ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      (~quality_rules.passes("base")).alias("base_failed"),
                      (quality_rules.passes("base") & quality_rules.passes()).alias("kept"), "fail_bits")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golay_simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def op5_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = page_template.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "from_previous", "to_next")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L conv_id, turn, role, '{said}' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)")
    return chat_format.digest(chat_format.format_chats(turns.unionByName(extra)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                      F.length("middle").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"),
                      digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_html_template": op5_html_template,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
