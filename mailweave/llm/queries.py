"""Queries of the problems tagged llm: name -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.encoding import repaired_fields
from mailweave.llm.leakage import leaked_items
from mailweave.llm.markup import cleaned_texts
from mailweave.llm.names import linked_rows, star_clusters
from mailweave.llm.packing import packed
from mailweave.llm.quoted import newly_written, not_new_lines
from mailweave.llm.truncation import cut_documents, cut_share
from mailweave.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return cleaned_texts(spread(table(spark, root, "messages")), "delivery_id", "body").select("delivery_id")


def p1_clean_text(spark: SparkSession, root: str) -> DataFrame:
    return cleaned_texts(spread(table(spark, root, "messages")), "delivery_id", "body")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_repaired(spark, root).select("delivery_id", "field")


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    return repaired_fields(spread(table(spark, root, "messages")), "delivery_id", ["body", "subject"])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    m, s = table(spark, root, "messages"), table(spark, root, "specs")
    rows = m.select(F.lit("messages").alias("tab"), F.col("delivery_id").alias("rec_id"), F.col("sender_name").alias("name"), F.col("sender_address").alias("address")).unionByName(
        s.select(F.lit("specs").alias("tab"), F.col("spec_id").alias("rec_id"), F.col("mentioned_by").alias("name"), F.col("mentioned_address").alias("address"))
    )
    return linked_rows(rows, table(spark, root, "people"))


def p4_clusters(spark: SparkSession, root: str) -> DataFrame:
    m, s = table(spark, root, "messages"), table(spark, root, "specs")
    return star_clusters(m.select(F.col("sender_name").alias("name")).unionByName(s.select(F.col("mentioned_by").alias("name"))), table(spark, root, "people"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return not_new_lines(spread(table(spark, root, "messages")), table(spark, root, "mailboxes"))


def p7_new_text(spark: SparkSession, root: str) -> DataFrame:
    return newly_written(spread(table(spark, root, "messages")), table(spark, root, "mailboxes"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packed(spread(table(spark, root, "documents")), table(spark, root, "containers"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(spread(table(spark, root, "documents")), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return cut_documents(spread(table(spark, root, "documents"))).where("cut").select("doc_id")


def p10_cut_share(spark: SparkSession, root: str) -> DataFrame:
    return cut_share(spread(table(spark, root, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clean_text, p2_found, p2_repaired, p4_found, p4_clusters, p7_found, p7_new_text, p8_packed, p9_found, p10_found, p10_cut_share)}


def oracle_sql() -> dict[str, str]:
    """None of these can be written in SQL; tests/llm compares them with brute force, round trips and hand-made cases."""
    return {}
