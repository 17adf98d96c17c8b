"""Eigenvalues, singular values and correlated noise of correlation blocks; a block is one task, blocks are independent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.banded import assign_blocks, matvec
from genoloom.operators.intervals import outside
from genoloom.storage import cut, drop_cut, sorted_join


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(variant numbers, matrix) of a block's rows i, j, r; rows with i = j list the variants."""
    own = np.unique(pdf.i[pdf.i == pdf.j])
    m = np.eye(len(own))
    e = pdf[pdf.i != pdf.j]
    a, b = np.searchsorted(own, e.i), np.searchsorted(own, e.j)
    m[a, b] = m[b, a] = e.r
    return own, m


def _blocks(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows (block_id, i, j, r) of edges inside blocks, and of the diagonal. variants: i, block_id; blocks must be bounded."""
    v = variants.select("i", "block_id")
    same = sorted_join(sorted_join(edges, v, ["i"]), v.select(F.col("i").alias("j"), F.col("block_id").alias("__b")), ["j"]).where("block_id = __b")
    return same.select("block_id", "i", "j", "r").unionByName(v.select("block_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("r")))


def extremal_eigenvalues(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """(block_id, lambda_min, lambda_max, variants) of every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, m = _dense(pdf)
        w = np.linalg.eigvalsh(m)
        return pd.DataFrame({"block_id": [pdf.block_id.iloc[0]], "lambda_min": [w[0]], "lambda_max": [w[-1]], "variants": [len(own)]})

    kind = variants.schema["block_id"].dataType.simpleString()
    return _blocks(edges, variants).groupBy("block_id").applyInPandas(run, f"block_id {kind}, lambda_min double, lambda_max double, variants int")


def lambda_min(values: DataFrame, ratio: float = 1e-3) -> DataFrame:
    """values with the shift that makes a block positive definite: |min(lambda_min + ratio lambda_max, 0)| / (1 + ratio)."""
    return values.withColumn("shift", F.abs(F.least(F.col("lambda_min") + ratio * F.col("lambda_max"), F.lit(0.0))) / (1 + ratio))


def lambda_min_per_variant(values: DataFrame, variants: DataFrame, ratio: float = 1e-3) -> DataFrame:
    return variants.join(lambda_min(values, ratio).select("block_id", "shift"), "block_id", "left")


def singular_values(edges: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """(block_id, rank_no, value): the k largest singular values of every block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(_dense(pdf)[1], compute_uv=False)[:k]
        return pd.DataFrame({"block_id": pdf.block_id.iloc[0], "rank_no": np.arange(1, len(s) + 1), "value": s})

    kind = variants.schema["block_id"].dataType.simpleString()
    return _blocks(edges, variants).groupBy("block_id").applyInPandas(run, f"block_id {kind}, rank_no int, value double")


def largest_eigenvalue(edges: DataFrame, variants: DataFrame, rounds: int = 50, tolerance: float = 1e-6) -> float:
    """Of the whole matrix, by power iteration over the edges; for matrices that no task could hold."""
    x = variants.select("i", F.lit(1.0).alias("x"))
    value = 0.0
    for _ in range(rounds):
        y = cut(matvec(edges, x), "power")
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("n")).first().n or 0.0
        size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")).first().n or 1.0
        new = norm / size
        x = y.select("i", (F.col("y") / (norm or 1.0)).alias("x"))
        if abs(new - value) < tolerance * max(1.0, new):
            return new
        value = new
    return value


def extremal_of_whole(edges: DataFrame, variants: DataFrame, steps: int = 40) -> tuple[float, float]:
    """Smallest and largest eigenvalue of a matrix that no task could hold, by Lanczos steps over the edges.

    edges: i, j, r; variants: i. Each step is one product and two sums; the vectors are written tables, what comes to the
    driver are two numbers a step. The values approach the ends of the spectrum from inside.
    """
    start = F.sin(F.col("i") * 12.9898 + 78.233) + 1.5
    one = variants.select("i", start.alias("b"))
    norm = one.agg(F.sqrt(F.sum(F.col("b") * F.col("b")))).first()[0]
    if norm is None:
        return 0.0, 0.0
    now = cut(one.select("i", F.lit(0.0).alias("a"), (F.col("b") / norm).alias("b")), "lanczos")
    alphas: list[float] = []
    betas: list[float] = []
    for k in range(steps):
        w = cut(matvec(edges, now.select("i", F.col("b").alias("x"))).join(now, "i"), "lanczos")
        alpha = w.agg(F.sum(F.col("y") * F.col("b"))).first()[0]
        alphas.append(alpha)
        rest = F.col("y") - alpha * F.col("b") - (betas[-1] if betas else 0.0) * F.col("a")
        beta = w.agg(F.sqrt(F.sum(rest * rest))).first()[0]
        if k == steps - 1 or beta < 1e-10:
            break
        betas.append(beta)
        drop_cut(now)
        now = cut(w.select("i", F.col("b").alias("a"), (rest / beta).alias("b")), "lanczos")
        drop_cut(w)
    t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
    values = np.linalg.eigvalsh(t)
    return float(values[0]), float(values[-1])


def shift_of_whole(edges: DataFrame, variants: DataFrame, ratio: float = 1e-3, steps: int = 40) -> float:
    """The shift of lambda_min for the whole matrix."""
    low, high = extremal_of_whole(edges, variants, steps)
    return abs(min(low + ratio * high, 0.0)) / (1 + ratio)


def window_spectrum(edges: DataFrame, variants: DataFrame, dist: str, width: float, regions: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(block_id, lambda_min, lambda_max, variants, lambda_min_outside): extremal eigenvalues of blocks of 1.2 windows; the last
    without the variants in `regions` (chr, start_pos, end_pos), whose long-range correlation a window cuts off.

    variants: i, the column dist and, for regions, chr and pos.
    """
    v = assign_blocks(variants, dist=dist, width=1.2 * width, by=by)
    full = extremal_eigenvalues(edges, v)
    if regions is None:
        return full.withColumn("lambda_min_outside", F.col("lambda_min"))
    rest = extremal_eigenvalues(edges, outside(v, regions, ["i"], chr_col="chr", pos="pos")).select("block_id", F.col("lambda_min").alias("lambda_min_outside"))
    return full.join(rest, "block_id", "left")


def correlated_noise(edges: DataFrame, variants: DataFrame, seed: int) -> DataFrame:
    """(i, x): normal noise whose covariance is the correlation of its block (negative eigenvalues count as zero)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, m = _dense(pdf)
        w, u = np.linalg.eigh(m)
        z = np.random.default_rng((seed, int(pdf.block_id.iloc[0]))).normal(size=len(own))
        return pd.DataFrame({"i": own, "x": u @ (np.sqrt(np.maximum(w, 0)) * z)})

    return _blocks(edges, variants).groupBy("block_id").applyInPandas(run, "i bigint, x double")


def train_test_correlated(stats: DataFrame, edges: DataFrame, variants: DataFrame, p: float, seed: int) -> DataFrame:
    """As simulate.train_test, with the noise of neighbouring variants correlated as they are. stats: i, STD_BETA, N."""
    n = F.col("N")
    out = sorted_join(stats, correlated_noise(edges, variants, seed), ["i"]).withColumn("train_beta", F.col("STD_BETA") + F.sqrt(1 / (p * n) - 1 / n) * F.col("x")).drop("x")
    return out.withColumn("test_beta", F.col("STD_BETA") / (1 - p) - F.col("train_beta") * p / (1 - p)).withColumn("train_n", n * p).withColumn("test_n", n * (1 - p))
