"""Queries of problem 7: texts in containers of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.packing import Breeding, breed, pack, token_counts
from genoloom.plans.tables import table
from genoloom.storage import cut

HOW = Breeding(capacity=2048)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), HOW)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, tokens, the least number of containers possible for so many tokens, and the share filled."""
    all_ = p7_containers(spark, sf_dir).agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return all_.select("containers", "tokens", F.ceil(F.col("tokens") / HOW.capacity).alias("least"), (F.col("tokens") / (F.col("containers") * HOW.capacity)).alias("filled"))


def p7_bred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every shard: containers of best fit by decreasing size, of the best packing bred, the least possible, children bred."""
    return breed(token_counts(table(spark, sf_dir, "documents")), HOW)[1]


def p7_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in containers, and counts that must be 0: texts or pieces without a container or in two, containers over the
    capacity, pieces of texts that weren't longer than the capacity, missing or repeated piece numbers."""
    docs = table(spark, sf_dir, "documents")
    counts = cut(token_counts(docs), "tokens")
    packed = cut(pack(counts, HOW), "containers")
    over = packed.groupBy("container_id").agg(F.sum("tokens").alias("t")).where(F.col("t") > HOW.capacity).agg(F.count(F.lit(1)).alias("over_capacity"))
    own = packed.groupBy("doc_id").agg(F.sum("tokens").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece_no").alias("numbers"), F.max("piece_no").alias("last"))
    both = counts.join(own, "doc_id", "full")
    tell = both.agg(
        F.count("packed").alias("texts"),
        F.count(F.when(F.col("packed").isNull() | F.col("tokens").isNull() | (F.col("packed") != F.col("tokens")), 1)).alias("incomplete"),
        F.count(F.when((F.col("tokens") <= HOW.capacity) & (F.col("pieces") > 1), 1)).alias("divided"),
        F.count(F.when((F.col("pieces") != F.col("numbers")) | (F.col("pieces") != F.col("last")), 1)).alias("misnumbered"),
    )
    return tell.join(F.broadcast(over))  # one row each


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_bred": p7_bred, "p7_valid": p7_valid}
SQL = {"p7_valid": "SELECT count(*) AS texts, 0 AS incomplete, 0 AS divided, 0 AS misnumbered, 0 AS over_capacity FROM documents WHERE text IS NOT NULL"}
