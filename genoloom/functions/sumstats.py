"""Derived columns of summary statistics. Names are the canonical ones; a column that is there is never recomputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions.stats import div, nlog10_pvalue, pvalue


def maf_var(maf: Column) -> Column:
    return 2 * maf * (1 - maf)


def effect_sign(df: DataFrame) -> Column:
    """Sign of BETA, else of Z, else of ln(OR)."""
    have = [F.signum(F.col(c)) for c in ("BETA", "Z") if c in df.columns]
    if "OR" in df.columns:
        have.append(F.signum(F.log("OR")))
    if not have:
        raise ValueError("no effect column: BETA, Z or OR")
    return F.coalesce(*have)


def derive(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df with the wanted columns, in this order; those that are missing are derived from the others.

    Known: BETA (from OR), Z, PVAL, NLOG10_PVAL, CHISQ, MAF_VAR, STD_BETA, YY, SIGN. Others must exist.
    """
    rules = {
        "BETA": lambda d: F.log("OR"),
        "Z": lambda d: div(F.col("BETA"), F.col("SE")),
        "PVAL": lambda d: pvalue("Z"),
        "NLOG10_PVAL": lambda d: nlog10_pvalue("Z") if "Z" in d.columns or {"BETA", "SE"} <= set(d.columns) else -F.log10("PVAL"),
        "CHISQ": lambda d: F.col("Z") * F.col("Z"),
        "MAF_VAR": lambda d: maf_var(F.col("MAF")),
        "STD_BETA": lambda d: F.col("Z") / F.sqrt(F.col("N") - 1 + F.col("Z") * F.col("Z")),
        "YY": lambda d: (F.col("N") - 2) * F.col("SE") * F.col("SE") + F.col("BETA") * F.col("BETA"),
        "SIGN": effect_sign,
    }
    parents = {"BETA": ["OR"], "Z": ["BETA", "SE"], "PVAL": ["Z"], "NLOG10_PVAL": ["PVAL"], "CHISQ": ["Z"], "MAF_VAR": ["MAF"], "STD_BETA": ["Z", "N"], "YY": ["BETA", "N", "SE"]}

    def needed(d: DataFrame, c: str) -> list[str]:
        """What a column is made from; -log10 of the p-value rather from Z, which has no underflow."""
        if c == "NLOG10_PVAL" and ("Z" in d.columns or {"BETA", "SE"} <= set(d.columns)):
            return ["Z"]
        return parents.get(c, [])

    def add(d: DataFrame, c: str) -> DataFrame:
        if c in d.columns:
            return d
        if c not in rules:
            raise KeyError(c)
        for x in needed(d, c):
            d = add(d, x)
        return d.withColumn(c, rules[c](d))

    for c in wanted:
        df = add(df, c)
    return df.select(*wanted)
