"""Simulation of traits. Random numbers come from hashes of seed and identifier, so a result never depends on partitions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions.stats import hash_normal, hash_uniform
from genoloom.operators.scoring import score


def mixture(variants: DataFrame, pi: list[float], seed: int, key: str = "variant_idx") -> DataFrame:
    """variants with component: drawn with probabilities pi."""
    u, c = hash_uniform(seed, F.col(key)), F.lit(len(pi) - 1)
    edges = list(np.cumsum(pi))[:-1]
    for k in reversed(range(len(edges))):
        c = F.when(u < float(edges[k]), k).otherwise(c)
    return variants.withColumn("component", c)


def heritability(variants: DataFrame, h2: float, d: list[float]) -> DataFrame:
    """variants with h2: the share of each, by the variance multiplier of its component; all shares sum to h2."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.col("component") + 1)
    v = variants.withColumn("__w", w)
    return v.join(F.broadcast(v.agg(F.sum("__w").alias("__t")))).withColumn("h2", F.when(F.col("__t") > 0, h2 * F.col("__w") / F.col("__t")).otherwise(0.0)).drop("__w", "__t")


def effects(variants: DataFrame, seed: int, key: str = "variant_idx") -> DataFrame:
    """variants with BETA, normal with variance h2, and causal."""
    return variants.withColumn("BETA", F.sqrt("h2") * hash_normal(seed, F.col(key))).withColumn("causal", F.col("h2") > 0)


def phenotype(calls: DataFrame, variants: DataFrame, h2: float, seed: int, prevalence: float | None = None) -> DataFrame:
    """(sample_idx, phenotype): standardised score plus normal noise of variance 1 - h2; with a prevalence, 0/1 by a threshold."""
    s = score(calls, variants, ["BETA"], mode="standardize")
    y = s.select("sample_idx", (F.col("BETA") + math.sqrt(1 - h2) * hash_normal(seed + 7, F.col("sample_idx"))).alias("phenotype"))
    if prevalence is None:
        return y
    m = y.agg(F.avg("phenotype").alias("__m"), F.stddev_pop("phenotype").alias("__s"))
    cut_ = NormalDist().inv_cdf(1 - prevalence)
    return y.join(F.broadcast(m)).select("sample_idx", ((F.col("phenotype") - F.col("__m")) / F.col("__s") > cut_).cast("int").alias("phenotype"))


def simulate(calls: DataFrame, variants: DataFrame, h2: float = 0.2, pi: tuple[float, ...] = (0.9, 0.1), d: tuple[float, ...] = (0.0, 1.0), seed: int = 1, prevalence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(truth table of the variants, phenotypes)."""
    v = effects(heritability(mixture(variants, list(pi), seed), h2, list(d)), seed + 3)
    return v, phenotype(calls, v, h2, seed, prevalence)


def annotated_heritability(variants: DataFrame, weights: dict[str, float]) -> DataFrame:
    """variants with h2 = max(sum of annotation times weight, 0)."""
    total = sum((F.col(a) * w for a, w in weights.items()), F.lit(0.0))
    return variants.withColumn("h2", F.greatest(total, F.lit(0.0)))


def annotated_pi(variants: DataFrame, pi: float, fold: dict[str, float]) -> DataFrame:
    """variants with pi: logistic of ln(pi) plus annotation times ln of its fold enrichment."""
    x = sum((F.col(a) * math.log(w) for a, w in fold.items()), F.lit(math.log(pi)))
    return variants.withColumn("pi", 1 / (1 + F.exp(-x)))


def cohort_effects(variants: DataFrame, rho: np.ndarray, seed: int, shared: float = 1.0, key: str = "variant_idx") -> DataFrame:
    """variants (h2, causal) with BETA_k and causal_k for each cohort: effects correlated by rho.

    The first cohort has the causal variants as they are. A share of them, the same in all other cohorts, is common; of
    each of the rest, every other cohort has as many of its own, chosen among the variants that aren't causal in the first.
    """
    low = np.linalg.cholesky(np.asarray(rho, float))
    draws = [hash_normal(seed + 11 * k, F.col(key)) for k in range(len(low))]
    common = F.col("causal") & (hash_uniform(seed + 5, F.col(key)) < shared)
    # the share of the others that a cohort switches on makes up for what isn't shared; they get the mean variance
    counts = variants.agg(F.count(F.when(F.col("causal"), 1)).alias("__c"), F.count(F.when(~F.col("causal"), 1)).alias("__o"), F.avg(F.when(F.col("causal"), F.col("h2"))).alias("__h"))
    out = variants.join(F.broadcast(counts))  # one row
    own_share = F.least(F.coalesce(F.try_divide((1 - shared) * F.col("__c"), F.col("__o")), F.lit(0.0)), F.lit(1.0))
    for k in range(len(low)):
        mix: Column = sum((float(low[k, q]) * draws[q] for q in range(k + 1)), F.lit(0.0))
        own = F.lit(False) if k == 0 else ~F.col("causal") & (hash_uniform(seed + 101 * k, F.col(key)) < own_share)
        kept = F.col("causal") if k == 0 else common
        out = out.withColumn(f"causal_{k}", kept | own).withColumn(f"BETA_{k}", F.when(kept, F.sqrt("h2") * mix).when(own, F.sqrt("__h") * mix).otherwise(0.0))
    return out.drop("__c", "__o", "__h")


def set_causal(variants: DataFrame, chosen: DataFrame, on: str = "SNP") -> DataFrame:
    """variants with component 1 for the chosen ones and 0 for the others, in place of a random mixture."""
    marks = chosen.select(on).distinct().withColumn("__in", F.lit(1))
    return variants.join(marks, on, "left").withColumn("component", F.coalesce("__in", F.lit(0))).drop("__in")


def set_effects(variants: DataFrame, given: DataFrame, on: str = "SNP") -> DataFrame:
    """variants with the given BETA (0 where there is none) and causal."""
    own = given.groupBy(on).agg(F.first("BETA").alias("__b"))
    return variants.drop("BETA", "causal").join(own, on, "left").withColumn("BETA", F.coalesce("__b", F.lit(0.0))).withColumn("causal", F.col("BETA") != 0).drop("__b")


def tree_correlation(parents: DataFrame, depth: str = "length", rounds: int = 64) -> DataFrame:
    """(a, b, rho) for leaves of a tree (node, parent, length): length of their common path from the root over the longest."""
    path = parents.select("node", F.col("node").alias("up"), "parent", F.col(depth).alias("len"))
    at = path
    whole = path.select("node", "up", "len")
    for _ in range(rounds):
        at = at.where("parent IS NOT NULL").select("node", F.col("parent").alias("up")).join(parents.select(F.col("node").alias("up"), "parent", F.col(depth).alias("len")), "up").select("node", "up", "parent", "len")
        if at.isEmpty():
            break
        whole = whole.unionByName(at.select("node", "up", "len"))
    inner = parents.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaf = whole.join(inner, "node", "left_anti")
    pairs = leaf.select(F.col("node").alias("a"), "up", "len").join(leaf.select(F.col("node").alias("b"), "up"), "up").groupBy("a", "b").agg(F.sum("len").alias("s"))
    top = pairs.agg(F.max("s").alias("m"))
    return pairs.join(F.broadcast(top)).select("a", "b", (F.col("s") / F.col("m")).alias("rho"))


def split_samples(samples: DataFrame, shares: list[float], seed: int, key: str = "sample_idx") -> DataFrame:
    """samples with group_no: random by the shares, the same for the same seed and sample."""
    return mixture(samples, shares, seed, key).withColumnRenamed("component", "group_no")


def train_test(stats: DataFrame, p: float, seed: int, key: str = "i") -> DataFrame:
    """Summary statistics split as if a share p of the samples were kept: train_beta, test_beta, train_n, test_n (variants apart).

    stats: key, STD_BETA, N. The training effect is drawn around the effect with variance 1/(pN) - 1/N.
    """
    n = F.col("N")
    train = F.col("STD_BETA") + F.sqrt(1 / (p * n) - 1 / n) * hash_normal(seed, F.col(key))
    out = stats.withColumn("train_beta", train)
    return out.withColumn("test_beta", F.col("STD_BETA") / (1 - p) - F.col("train_beta") * p / (1 - p)).withColumn("train_n", n * p).withColumn("test_n", n * (1 - p))
