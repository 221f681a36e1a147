"""Queries of the training-data problems; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import round_at
from glossmill.llm import alignment, confusables, consensus, formatting, mixing, overlap, reading, sentences, splits, tokenizer
from glossmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.shared_split_pairs(table(spark, d, "bloomfield_texts_sentences").select("source_file", "paragraph_id"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_groups(table(spark, d, "bloomfield_texts_sentences").select("source_file", "paragraph_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bloomfield_texts_sentences").select("row_id", "source_file", "paragraph_id", "text_cree")
    script = F.when(F.col("text_cree").rlike(r"[\x{1400}-\x{167F}]"), "syllabic").when(F.col("text_cree").isNull(), "none").otherwise("roman")
    return splits.assign(rows, label=script)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split(table(spark, d, "bloomfield_annotated"), table(spark, d, "deepseek_labels"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.counts(table(spark, d, "bloomfield_annotated"), table(spark, d, "deepseek_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.members(table(spark, d, "deepseek_labels"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(table(spark, d, "deepseek_labels"))


def p3_collisions(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collisions(formatting.canonical(table(spark, d, "deepseek_labels"), "row_id", "text_cree", "text_en"))


def _log_and_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "silver_verification_cache"), table(spark, d, "bloomfield_annotated")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.disputed(*_log_and_gold(spark, d))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(*_log_and_gold(spark, d))


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(*_log_and_gold(spark, d))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.agreement(*_log_and_gold(spark, d))
    return found.select("items", "opinions", *(round_at(F.col(c), 6).alias(c) for c in ("observed", "alpha")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "bloomfield_texts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.lookalikes(table(spark, d, "bloomfield_texts_sentences"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return confusables.normalized(table(spark, d, "bloomfield_texts_sentences")).select("row_id", "form")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.spellings(table(spark, d, "bloomfield_texts_sentences"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return alignment.misaligned(table(spark, d, "bloomfield_texts_sentences"), table(spark, d, "dictionary"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decode(tokenizer.encode(table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    sized = mixing.sized_documents(docs, tokenizer.encode(docs, only_counts=True))
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).filter(F.col("english") & (F.col("grade") == reading.GRADES)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("p") and n[1].isdigit()}
