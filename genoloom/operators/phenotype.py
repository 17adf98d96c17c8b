"""Phenotype transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.functions.stats import div, qnorm_sql


def check_coding(samples: DataFrame, y: str = "phenotype") -> tuple[DataFrame, str]:
    """(samples with 0/1 coding if there are two values, gaussian or binomial). Two values must be 0, 1 or 1, 2."""
    seen = sorted(r[0] for r in samples.where(F.col(y).isNotNull()).select(y).distinct().limit(3).collect())
    if len(seen) > 2:
        return samples, "gaussian"
    if seen == [0, 1]:
        return samples, "binomial"
    if seen == [1, 2]:
        return samples.withColumn(y, F.col(y) - 1), "binomial"
    raise ValueError(f"unknown coding of the phenotype: {seen}")


def standardize(samples: DataFrame, y: str = "phenotype") -> DataFrame:
    s = samples.agg(F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s"))
    return samples.join(F.broadcast(s)).withColumn(y, div(F.col(y) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def outliers(samples: DataFrame, y: str = "phenotype", sigma: float = 3.0) -> DataFrame:
    """Rows within sigma population standard deviations; nulls are left out."""
    s = samples.agg(F.avg(y).alias("__m"), F.stddev_pop(y).alias("__s"))
    return samples.join(F.broadcast(s)).where(F.abs(F.col(y) - F.col("__m")) <= sigma * F.col("__s")).drop("__m", "__s")


def adjust(samples: DataFrame, covariates: list[str], y: str = "phenotype") -> DataFrame:
    """y less its least-squares fit on an intercept and the covariates. One aggregation gives all cross products."""
    have = F.col(y).isNotNull()
    for c in covariates:
        have = have & F.col(c).isNotNull()
    rows = samples.where(have)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(cols)
    aggs = [F.sum(cols[a] * cols[b]).alias(f"x{a}_{b}") for a in range(k) for b in range(a, k)] + [F.sum(cols[a] * F.col(y)).alias(f"y{a}") for a in range(k)]
    s = rows.agg(*aggs).first()
    if s["x0_0"] is None:
        return rows
    xx = np.array([[s[f"x{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
    w = np.linalg.lstsq(xx, np.array([s[f"y{a}"] for a in range(k)]), rcond=None)[0]
    fit = sum((float(b) * c for b, c in zip(w[1:], cols[1:])), F.lit(float(w[0])))
    return rows.withColumn(y, F.col(y) - fit)


def rint(samples: DataFrame, y: str = "phenotype", parts: int | None = None) -> DataFrame:
    """Rank-based inverse normal transform with average ranks for ties; nulls are left out.

    Ranks are those of distinct values: counts per value are summed over ranges of values, so no task sorts all rows.
    """
    spark = samples.sparkSession
    rows = samples.where(F.col(y).isNotNull())
    counts = rows.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from genoloom.storage import cut

    ranged = cut(counts.repartitionByRange(n, y).withColumn("__p", F.spark_partition_id()), "ranks")
    offsets = ranged.groupBy("__p").agg(F.sum("__c").alias("__s"))
    before = offsets.select("__p", F.coalesce(F.sum("__s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    local = F.sum("__c").over(W.partitionBy("__p").orderBy(y).rowsBetween(W.unboundedPreceding, 0))
    rank = ranged.join(F.broadcast(before), "__p").select(y, (F.col("__o") + local - F.col("__c") + (F.col("__c") + 1) / 2.0).alias("__r"))
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    out = rows.join(rank, y).join(F.broadcast(total)).withColumn("__u", (F.col("__r") - 0.375) / (F.col("__n") + 0.25))
    return out.withColumn(y, F.expr(qnorm_sql("__u"))).select(*samples.columns)


def transform(samples: DataFrame, covariates: list[str] | None = None, steps: tuple[str, ...] = ("standardize", "covariates", "rint", "outliers"), likelihood: str = "gaussian", y: str = "phenotype") -> DataFrame:
    """The steps in their order; binomial phenotypes are left as they are."""
    if likelihood == "binomial":
        return samples
    for s in steps:
        if s == "standardize":
            samples = standardize(samples, y)
        elif s == "covariates":
            samples = adjust(samples, covariates, y) if covariates else samples
        elif s == "rint":
            samples = rint(samples, y)
        elif s == "outliers":
            samples = outliers(samples, y)
        else:
            raise ValueError(s)
    return samples
