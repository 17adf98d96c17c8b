"""Genotypes: calls in long form (sample_idx, variant_idx, dosage; null = missing), frequencies, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.functions.stats import div


def allele_frequency(calls: DataFrame, key: str = "variant_idx") -> DataFrame:
    """(key, N, MAF, MAF_VAR): observed calls, A1 frequency (never folded), its binomial variance; MAF null without calls."""
    out = calls.groupBy(key).agg(F.count("dosage").alias("N"), F.sum("dosage").cast("double").alias("s"))
    maf = div(F.col("s"), 2.0 * F.col("N"))
    return out.select(key, "N", maf.alias("MAF"), (2 * maf * (1 - maf)).alias("MAF_VAR"))


def frequent(df: DataFrame, min_maf: float | None = None, min_mac: int | None = None) -> DataFrame:
    """Rows of a table with MAF and N whose rarer allele is frequent enough; null frequencies fail."""
    keep: Column = F.lit(True)
    if min_mac is not None:
        mac = F.floor(2 * F.col("MAF") * F.col("N"))
        keep = keep & (mac >= min_mac) & (2 * F.col("N") - mac >= min_mac)
    if min_maf is not None:
        keep = keep & (F.col("MAF") >= min_maf) & (1 - F.col("MAF") >= min_maf)
    return df.where(keep)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed; ids are compared as strings, a repeated id keeps a row once."""
    listed = ids.select(F.col(ids.columns[0]).cast("string").alias("__id"))
    return df.join(listed, F.col(key).cast("string") == F.col("__id"), "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    listed = ids.select(F.col(ids.columns[0]).cast("string").alias("__id"))
    return df.join(listed, F.col(key).cast("string") == F.col("__id"), "left_anti")


def drop_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drops every copy of rows whose key occurs more than once, by aggregation, so that no hot key meets in one window."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(single.alias("r"), cond, "left_semi")


def packed(calls: DataFrame) -> DataFrame:
    """(variant_idx, samples, dosages): one row per variant, arrays in the order of the samples."""
    rows = calls.groupBy("variant_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", F.coalesce("dosage", F.lit(-1)).alias("d")))).alias("x"))
    return rows.select("variant_idx", F.col("x.sample_idx").alias("samples"), F.transform("x.d", lambda d: F.nullif(d, F.lit(-1))).alias("dosages"))


def unpacked(variants: DataFrame) -> DataFrame:
    return variants.select("variant_idx", F.explode(F.arrays_zip("samples", "dosages")).alias("x")).select(F.col("x.samples").alias("sample_idx"), "variant_idx", F.col("x.dosages").alias("dosage"))


def split_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows with the group that a (key, group) table gives them; rows without a group are left out."""
    return df.join(groups, key, "inner")


def memory_mb(n: int, m: int, itemsize: int) -> float:
    """Size of a dense samples x variants matrix."""
    return n * m * itemsize / 2**20


def tumbling(df: DataFrame, pos: str, size: int, step: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows with the number of each positional window they fall in (from 0, by group); with step < size windows overlap.

    A last window that would hold less than `size` is absorbed by the one before; a span below `size` is one window.
    """
    step = step or size
    keys = by or []
    ends = df.groupBy(*keys).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last"))
    df = df.join(ends, keys) if keys else df.join(F.broadcast(ends))  # one row
    first, last = F.col("__first"), F.col("__last")
    top = F.greatest(F.ceil((last - first - size) / step), F.lit(1)) - 1
    off = F.col(pos) - first
    hi = F.least(F.floor(off / step), top)
    lo = F.least(F.greatest(F.floor((off - size) / step) + 1, F.lit(0)), hi)
    return df.withColumn("__hi", hi).withColumn("__lo", lo).withColumn("window_no", F.explode(F.sequence("__lo", "__hi"))).drop("__hi", "__lo", "__first", "__last")


def with_counts(variants: DataFrame, calls: DataFrame | None, wanted: list[str]) -> DataFrame:
    """The wanted columns of variants in this order; MAF, N, MAC and MAF_VAR are derived from the calls where they are missing."""
    derived = {"MAF": F.col("MAF"), "N": F.col("N"), "MAC": F.col("N") * 2 * F.col("MAF"), "MAF_VAR": 2 * F.col("MAF") * (1 - F.col("MAF"))}
    missing = [c for c in wanted if c not in variants.columns]
    if any(c not in derived for c in missing):
        raise KeyError(", ".join(c for c in missing if c not in derived))
    if not missing:
        return variants.select(*wanted)
    have = variants.columns
    base = variants.drop(*[c for c in ("MAF", "N") if c in have and "variant_idx" not in have])
    needed = [c for c in ("MAF", "N") if c not in base.columns]
    if needed:
        base = base.join(allele_frequency(calls).select("variant_idx", *needed), "variant_idx", "left")
    return base.select(*[derived[c].alias(c) if c in missing else F.col(c) for c in wanted])
