"""Statistical functions as plain Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the complementary error function, ln(erfc(x) / t) + x * x in powers of 2 t - 1 with
#: t = 2 / (2 + x) (Chebyshev fit, written in powers; relative error below 1e-15 (1 + x * x) for all x >= 0).
ERFC = (
    -0.6717940840566922, 0.6726432239776566, 0.047343306841904534, -0.04689561023117734, -0.00987268936639228, 0.008824938557113696, 0.001758933557808736,
    -0.002345812501075328, -0.00014624686329856, 0.00067367879913856, -9.3735032187904e-05, -0.000174302959455232, 7.1401019131904e-05, 3.174520193024e-05,
    -3.018789900288e-05, 1.3772128256e-07, 8.562650611712e-06, -2.948059037696e-06, -1.272346443776e-06, 1.2502106112e-06, -1.68468414464e-07,
    -2.4981274624e-07, 1.53326977024e-07, 1.610612736e-09, -3.9166410752e-08, 1.1106516992e-08, 4.060086272e-09, -1.879048192e-09,
)
#: Coefficients of the normal quantile (Acklam; relative error 1.15e-9).
QNORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QNORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QNORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QNORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
CHISQ_MEDIAN = 0.454936423119572


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def _erfc_parts(x: str) -> tuple[str, str]:
    """t and e with erfc(x) = t exp(e) for a non-negative x."""
    t = f"(2.0D / (2.0D + ({x})))"
    u = f"(2.0D * {t} - 1.0D)"
    poly = f"{ERFC[-1]!r}D"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}D + {u} * {poly})"
    return t, f"({poly} - ({x}) * ({x}))"


def erfc_sql(x: str) -> str:
    """erfc of a non-negative x as SQL text."""
    t, e = _erfc_parts(x)
    return f"({t} * exp({e}))"


def pvalue_sql(z: str) -> str:
    """Two-sided normal p-value as SQL text."""
    return erfc_sql(f"(abs({z}) / {math.sqrt(2)!r}D)")


def nlog10_pvalue(z: str) -> Column:
    """-log10 of the two-sided p-value of the z-score in the named column; finite also where the p-value is too small for a
    double, infinite only if z is."""
    t, e = _erfc_parts(f"(abs({z}) / {math.sqrt(2)!r}D)")
    infinite = "CAST('Infinity' AS DOUBLE)"
    return F.expr(f"CASE WHEN abs({z}) = {infinite} THEN {infinite} ELSE -(log10({t}) + {e} / {math.log(10)!r}D) END")


def pvalue(z: str) -> Column:
    """Two-sided p-value of the z-score in the named column."""
    return F.expr(pvalue_sql(z))


def norm_cdf_sql(x: str) -> str:
    tail = f"(0.5 * {pvalue_sql(x)})"
    return f"(CASE WHEN ({x}) < 0 THEN {tail} ELSE 1.0 - {tail} END)"


def qnorm_sql(p: str) -> str:
    """Normal quantile of 0 < p < 1 as SQL text."""

    def horner(c: tuple[float, ...], x: str) -> str:
        out = f"CAST({c[0]!r} AS DOUBLE)"
        for a in c[1:]:
            out = f"({out} * {x} + CAST({a!r} AS DOUBLE))"
        return out

    def tail(q: str) -> str:
        return f"({horner(QNORM_C, q)} / ({horner(QNORM_D, q)} * {q} + 1.0))"

    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - ({p})))"
    return f"(CASE WHEN ({p}) < 0.02425 THEN {tail(low)} WHEN ({p}) > 0.97575 THEN -{tail(high)} ELSE {horner(QNORM_A, r)} * {q} / ({horner(QNORM_B, r)} * {r} + 1.0) END)"


def quantize(x: Column, bits: int = 16) -> Column:
    """Correlation as a whole number of `bits` bits, half to even; the range is symmetric."""
    top = 2 ** (bits - 1) - 1
    kind = {8: "tinyint", 16: "smallint", 32: "int"}[bits]
    return F.greatest(F.least(F.rint(x * top), F.lit(float(top))), F.lit(float(-top))).cast(kind)


def dequantize(q: Column, bits: int = 16) -> Column:
    return q.cast("double") / float(2 ** (bits - 1) - 1)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Uniform number in (0, 1) that depends only on the seed and the keys: the same whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def hash_normal(seed: int, *keys: Column) -> Column:
    """Standard normal number from two such uniforms."""
    u, v = hash_uniform(2 * seed, *keys), hash_uniform(2 * seed + 1, *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)
