"""Queries of problems 5 and 6 over the summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.quantiles import load_summaries, percentiles, unite
from genoloom.llm.topn import top_n
from genoloom.plans.tables import table
from genoloom.storage import cut, small

ASKED = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]
ERROR = 0.001


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of z for every chromosome over all loads, put together from those of single loads."""
    by_load = load_summaries(table(spark, sf_dir, "sumstats"), "load_id", "chr", "z", ERROR)
    return percentiles(unite(by_load, "load_id", "chr", ERROR), ["chr"], ASKED)


def p5_load_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every load."""
    return percentiles(load_summaries(table(spark, sf_dir, "sumstats"), "load_id", "chr", "z", ERROR), ["load_id", "chr"], ASKED)


def p5_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles checked against the exact ranks of all rows: whether each keeps the stated bound."""
    got = small(cut(p5_percentiles(spark, sf_dir), "percentiles"))
    z = table(spark, sf_dir, "sumstats").where("z IS NOT NULL AND NOT isnan(z)").select(F.col("chr").alias("c"), "z")
    same = got["chr"].eqNullSafe(z["c"])
    ranks = got.join(z, same & (z["z"] <= got["value"]), "left").groupBy("chr", "percentile", "value", "n").agg(
        F.count("z").alias("hi"), F.sum(F.when(F.col("z") < F.col("value"), 1).otherwise(0)).alias("below"))
    asked = F.greatest(F.ceil(F.round(F.col("percentile") / 100 * F.col("n"), 9)), F.lit(1))
    off = F.greatest(F.col("below") + 1 - asked, asked - F.col("hi"), F.lit(0))
    return ranks.select("chr", "percentile", "n", (off <= F.ceil(F.lit(ERROR) * F.col("n"))).alias("within"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sumstats").where("chr IS NOT NULL AND pval >= 0 AND pval <= 1")
    size = F.when(F.isnan("z"), None).otherwise(F.abs("z"))
    return top_n(rows, ["load_id", "chr"], [(F.col("pval"), "asc"), (size, "desc_nulls_last"), (F.col("row_id"), "asc")], "row_id", 3)


QUERIES = {"p5_percentiles": p5_percentiles, "p5_load_percentiles": p5_load_percentiles, "p5_within_bound": p5_within_bound, "p6_found": p6_found}
SQL = {
    "p5_within_bound": f"""SELECT chr, p.p AS percentile, n, true AS within
FROM (SELECT chr, count(*) AS n FROM sumstats WHERE z IS NOT NULL AND NOT isnan(z) GROUP BY chr),
  (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in ASKED)}) p(p)""",
    "p6_found": """SELECT load_id, chr, CAST(rank_no AS INTEGER) AS rank_no, row_id FROM (
  SELECT load_id, chr, row_id, row_number() OVER (PARTITION BY load_id, chr
    ORDER BY pval, CASE WHEN isnan(z) THEN NULL ELSE abs(z) END DESC NULLS LAST, row_id) AS rank_no
  FROM sumstats WHERE chr IS NOT NULL AND pval >= 0 AND pval <= 1) WHERE rank_no <= 3""",
}
