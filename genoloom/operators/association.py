"""Association scans: one aggregation per variant, then column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.stats import CHISQ_MEDIAN, div, pvalue


def linear(calls: DataFrame, samples: DataFrame, standardize: bool = False, phenotype: str = "phenotype") -> DataFrame:
    """Linear association of every variant: variant_idx, N, MAF, BETA, SE, Z, PVAL.

    The phenotype is centred over all samples that have one; sums are over observed calls. The residual sum of squares
    takes the whole sum of squares of the phenotype, not only that of the observed calls. Constant variants have a null
    BETA, variants with two calls or fewer a null SE. A variant that leaves no residual has an infinite Z.
    """
    y = samples.where(F.col(phenotype).isNotNull()).select("sample_idx", F.col(phenotype).cast("double").alias("y"))
    g = F.col("dosage").cast("double")
    yc = F.col("y") - F.col("mean_y")
    mean = y.agg(F.avg("y").alias("mean_y"))
    # squares about the final mean: a running mean costs digits where the phenotype is far from zero
    total = y.join(F.broadcast(mean)).agg(F.first("mean_y").alias("mean_y"), F.sum(yc * yc).alias("yy"))
    joined = calls.where("dosage IS NOT NULL").join(y, "sample_idx").join(F.broadcast(total))
    sums = joined.groupBy("variant_idx").agg(
        F.count("dosage").alias("N"), F.sum(g).alias("sx"), F.sum(g * g).alias("sxx"), F.sum(g * yc).alias("sxy"), F.sum(yc).alias("sy"), F.first("yy").alias("yy"))
    n = F.col("N")
    c = F.col("sxx") - F.col("sx") * F.col("sx") / n
    d = F.col("sxy") - F.col("sx") / n * F.col("sy")
    flat = c <= 1e-12
    if standardize:
        xy, xx = F.when(flat, 0.0).otherwise(d * F.sqrt(div(n, c))), F.when(flat, 0.0).otherwise(n.cast("double"))
    else:
        xy, xx = F.when(flat, 0.0).otherwise(d), F.when(flat, 0.0).otherwise(c)
    out = sums.select("variant_idx", "N", (F.col("sx") / (2 * n)).alias("MAF"), "yy", xy.alias("xy"), xx.alias("xx")).withColumn("BETA", div(F.col("xy"), F.col("xx")))
    rss = F.greatest(F.col("yy") - F.col("BETA") * F.col("xy"), F.lit(0.0))
    out = out.withColumn("SE", F.sqrt(div(F.when(F.col("N") > 2, rss / (F.col("N") - 2)), F.col("xx"))))
    z = F.when((F.col("SE") == 0) & (F.col("BETA") != 0), F.signum("BETA") * float("inf")).otherwise(div(F.col("BETA"), F.col("SE")))
    return out.withColumn("Z", z).select("variant_idx", "N", "MAF", "BETA", "SE", "Z", pvalue("Z").alias("PVAL"))


def logistic(calls: DataFrame, samples: DataFrame, phenotype: str = "status", rounds: int = 25) -> DataFrame:
    """Logistic association of a 0/1 phenotype: variant_idx, N, BETA, SE, Z, PVAL.

    A dosage takes three values, so a variant is one row of six counts, aggregated in the engine; the maximum likelihood
    is then found for batches of variants at once.
    """
    y = samples.where(F.col(phenotype).isin(0, 1)).select("sample_idx", F.col(phenotype).cast("int").alias("y"))
    cell = lambda g, s: F.sum(F.when((F.col("dosage") == g) & (F.col("y") == s), 1).otherwise(0)).alias(f"n{g}{s}")
    counts = calls.where("dosage IS NOT NULL").join(y, "sample_idx").groupBy("variant_idx").agg(*[cell(g, s) for g in range(3) for s in range(2)])

    def newton(batches):
        for b in batches:
            n1 = b[["n01", "n11", "n21"]].to_numpy(float)
            n = n1 + b[["n00", "n10", "n20"]].to_numpy(float)
            x = np.arange(3.0)
            w = np.zeros((len(b), 2))
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(w[:, :1] + w[:, 1:] * x, -30, 30)))
                v, e = n * p * (1 - p), n1 - n * p
                h00, h01, h11 = v.sum(1) + 1e-12, v @ x, v @ x**2 + 1e-12
                det = h00 * h11 - h01**2
                g0, g1 = e.sum(1), e @ x
                ok = det > 1e-12
                step = np.stack([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0], 1) / np.where(ok, det, 1)[:, None]
                w += np.where(ok[:, None], np.clip(step, -5, 5), 0)
            beta, se = np.where(ok, w[:, 1], np.nan), np.where(ok, np.sqrt(h00 / np.where(ok, det, 1)), np.nan)
            yield pd.DataFrame({"variant_idx": b.variant_idx, "N": n.sum(1).astype("int64"), "BETA": beta, "SE": se})

    kind = counts.schema["variant_idx"].dataType.simpleString()
    fitted = counts.mapInPandas(newton, f"variant_idx {kind}, N bigint, BETA double, SE double")
    fitted = fitted.select("variant_idx", "N", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("BETA", "SE")]).withColumn("Z", div(F.col("BETA"), F.col("SE")))
    return fitted.withColumn("PVAL", pvalue("Z"))


def inflation(stats: DataFrame, chisq: str = "CHISQ") -> DataFrame:
    """Genomic inflation: exact median of the statistic over that of its distribution."""
    return stats.agg((F.percentile(chisq, F.lit(0.5)) / CHISQ_MEDIAN).alias("lambda_gc"))


def simple_ldsc(stats: DataFrame, scores: DataFrame, key: str = "SNP") -> DataFrame:
    """Heritability from the mean statistic: (mean(CHISQ) - 1) M / (mean(LDScore) max(N))."""
    j = stats.join(scores, key)
    return j.agg(((F.avg("CHISQ") - 1) * F.count(F.lit(1)) / (F.avg("LDScore") * F.max("N"))).alias("h2"))


def enrichment(variants: DataFrame, annotations: list[str], h2: str = "h2") -> DataFrame:
    """(annotation, enrichment): share of heritability over share of variants, for each 0/1 annotation."""
    stack = ", ".join(f"'{a}', CAST(`{a}` AS INT)" for a in annotations)
    total = variants.agg(F.sum(h2).alias("h2_all"), F.count(F.lit(1)).alias("m_all"))
    long = variants.selectExpr(f"`{h2}` AS h", f"stack({len(annotations)}, {stack}) AS (annotation, inside)").where("inside = 1")
    part = long.groupBy("annotation").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("m")).join(F.broadcast(total))
    return part.select("annotation", div(F.col("h") / F.col("h2_all"), F.col("m") / F.col("m_all")).alias("enrichment"))
