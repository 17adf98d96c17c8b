"""Data behind the usual plots; drawing is left to others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Genome-wide significance after Bonferroni's rule, as -log10(p).
GENOME_WIDE = -math.log10(0.05 / 1e6)


def manhattan(stats: DataFrame) -> DataFrame:
    """(CHR, POS, x, NLOG10_PVAL): positions laid end to end by chromosome. stats: CHR, POS, and NLOG10_PVAL or PVAL."""
    ends = stats.groupBy("CHR").agg(F.max("POS").cast("bigint").alias("__m"))
    offset = ends.select("CHR", F.coalesce(F.sum("__m").over(W.orderBy("CHR").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    y = F.col("NLOG10_PVAL") if "NLOG10_PVAL" in stats.columns else -F.log10("PVAL")
    return stats.join(F.broadcast(offset), "CHR").select("CHR", "POS", (F.col("POS") + F.col("__o")).alias("x"), y.alias("NLOG10_PVAL"))


def qq(stats: DataFrame, p: str = "PVAL") -> DataFrame:
    """(expected, observed): -log10 of i / m and of the i-th smallest p-value; equal values share the highest rank of theirs.

    Ranks come from counts of distinct values summed over ranges of values.
    """
    from genoloom.storage import cut

    rows = stats.where(F.col(p).isNotNull())
    n = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(rows.groupBy(p).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(n, p).withColumn("part", F.spark_partition_id()), "qq")
    sums = counts.groupBy("part").agg(F.sum("c").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("o"), F.sum("s").over(W.partitionBy()).alias("m"))
    rank = F.col("o") + F.sum("c").over(W.partitionBy("part").orderBy(p).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.join(F.broadcast(before), "part").select(p, (-F.log10(rank / F.col("m"))).alias("expected"))
    return rows.select(p).join(ranked, p).select("expected", (-F.log10(p)).alias("observed"))
