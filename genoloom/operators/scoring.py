"""Polygenic scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.stats import norm_cdf_sql
from genoloom.operators.genotype import allele_frequency
from genoloom.storage import salted_join


def score(calls: DataFrame, effects: DataFrame, betas: list[str], mode: str = "raw", frequencies: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(sample_idx, betas...): sum of dosage times effect over variants, for each column of effects.

    Missing dosages: raw counts them as 0, impute as twice the frequency; standardize uses (g - 2p) / sqrt(2p(1 - p)) with
    missing ones and constant variants as 0. frequencies: variant_idx, MAF; by default those of the calls. Variants whose
    effects are all zero or null are dropped before the join, with their calls. samples: sample_idx; those without a score
    come out with 0. By default all samples that have calls.
    """
    if mode not in ("raw", "impute", "standardize"):
        raise ValueError(mode)
    some = reduce(lambda a, b: a | b, [F.coalesce(F.col(b) != 0, F.lit(False)) for b in betas])
    e = effects.where(some).select("variant_idx", *[F.coalesce(F.col(b), F.lit(0.0)).cast("double").alias(b) for b in betas])
    if mode != "raw":
        p = (frequencies if frequencies is not None else allele_frequency(calls)).select("variant_idx", F.col("MAF").alias("__p"))
        e = e.join(p, "variant_idx")
    rows = calls.select("sample_idx", "variant_idx", "dosage")
    if mode == "raw":
        # zero dosages add nothing, but every sample must come out
        g = F.coalesce("dosage", F.lit(0)).cast("double")
    elif mode == "impute":
        g = F.coalesce(F.col("dosage").cast("double"), 2 * F.col("__p"))
    else:
        var = 2 * F.col("__p") * (1 - F.col("__p"))
        g = F.when(F.col("dosage").isNull() | (var <= 0), 0.0).otherwise((F.col("dosage") - 2 * F.col("__p")) / F.sqrt(var))
    sums = salted_join(rows, e, ["variant_idx"]).groupBy("sample_idx").agg(*[F.sum(g * F.col(b)).alias(b) for b in betas])
    every = (samples if samples is not None else calls).select("sample_idx").distinct()
    return every.join(sums, "sample_idx", "left").select("sample_idx", *[F.coalesce(b, F.lit(0.0)).alias(b) for b in betas])


def predict(scores: DataFrame, column: str, likelihood: str = "gaussian") -> DataFrame:
    """(sample_idx, prediction): the score itself, or its normal probability for binomial phenotypes."""
    value = F.col(column) if likelihood == "gaussian" else F.expr(norm_cdf_sql(f"`{column}`"))
    return scores.select("sample_idx", value.alias("prediction"))
