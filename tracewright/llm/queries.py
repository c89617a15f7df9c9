"""Queries of the operators for training text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import conversations, leaks, packing, pairs, provenance, splitting, truncation
from tracewright.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_replies(table(spark, sf_dir, "trajectories"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "opencode_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.file_classes(table(spark, sf_dir, "chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.cut_kinds(table(spark, sf_dir, "chunks"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words within two inserted, lost or changed words."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2, recall=0.95)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_share(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p7_found, p7_pieces, p8_pack, p9_found, p9_near, p10_found, p10_share)}
