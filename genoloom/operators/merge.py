"""Allele-aware joins, identifier inference and harmonisation of variant tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNED = ("BETA", "STD_BETA", "Z")


def match_key(a: DataFrame, b: DataFrame) -> list[str]:
    """SNP if both have it, else CHR and POS."""
    if "SNP" in a.columns and "SNP" in b.columns:
        return ["SNP"]
    if {"CHR", "POS"} <= set(a.columns) & set(b.columns):
        return ["CHR", "POS"]
    raise ValueError("no common key: SNP, or CHR and POS")


def _first(df: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """The first row of each key in the given order, by an aggregation, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    by = F.col(order) if order else F.struct(*[F.col(c) for c in rest])
    one = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), by).alias("__r"))
    return one.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def merge_alleles(ref: DataFrame, alt: DataFrame, how: str = "inner", correct_flips: bool = True, order: str | None = None) -> DataFrame:
    """ref's key and alleles with alt's other columns, made to refer to ref's A1.

    Rows whose alleles are swapped have BETA, STD_BETA and Z negated and MAF replaced by 1 - MAF. inner keeps matching and
    (if correct_flips) swapped rows; left keeps every row of ref, taking its alleles where alt has none. Strands are not
    complemented. Of repeated keys the first in `order` (a column of both tables) is used.
    """
    key = match_key(ref, alt)
    extra = [order] if order and order not in key else []
    r = _first(ref.select(*key, "A1", "A2", *extra), key, order).drop(*extra)
    a = _first(alt, key, order).drop(*extra)
    own = [c for c in a.columns if c not in key and c not in ("A1", "A2")]
    a = a.select(*key, F.col("A1").alias("__a1"), F.col("A2").alias("__a2"), *[F.col(c).alias(f"__x_{c}") for c in own])
    j = r.join(a, key, how)
    b1, b2 = (F.coalesce("__a1", "A1"), F.coalesce("__a2", "A2")) if how == "left" else (F.col("__a1"), F.col("__a2"))
    same = (b1 == F.col("A1")) & (b2 == F.col("A2"))
    flip = (b1 == F.col("A2")) & (b2 == F.col("A1")) & ~same
    if how == "inner":
        j = j.where((same | flip) if correct_flips else same)

    def value(c: str) -> Column:
        x = F.col(f"__x_{c}")
        if not correct_flips:
            return x.alias(c)
        if c in SIGNED:
            return F.when(flip, -x).otherwise(x).alias(c)
        return (F.when(flip, 1 - x).otherwise(x) if c == "MAF" else x).alias(c)

    return j.select(*key, "A1", "A2", *[value(c) for c in own])


def orient(stats: DataFrame, ref: DataFrame) -> DataFrame:
    """Every row of stats (its key may repeat, as in several loads) whose alleles are those of ref, turned to ref's A1.

    ref has one row for each key; of more the first is used. Effects and frequencies change as in merge_alleles.
    """
    key = match_key(ref, stats)
    r = _first(ref.select(*key, F.col("A1").alias("__r1"), F.col("A2").alias("__r2")), key, None)
    j = stats.join(r, key)
    same = (F.col("A1") == F.col("__r1")) & (F.col("A2") == F.col("__r2"))
    flip = (F.col("A1") == F.col("__r2")) & (F.col("A2") == F.col("__r1")) & ~same
    turned = {c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in SIGNED} | {"MAF": F.when(flip, 1 - F.col("MAF")).otherwise(F.col("MAF")), "A1": F.col("__r1"), "A2": F.col("__r2")}
    return j.where(same | flip).select(*[turned[c].alias(c) if c in turned else F.col(c) for c in stats.columns])


def infer_a2(stats: DataFrame, ref: DataFrame, allow_na: bool = False) -> DataFrame:
    """stats with A2: the reference allele that A1 isn't."""
    key = match_key(stats, ref)
    r = _first(ref.select(*key, F.col("A1").alias("__r1"), F.col("A2").alias("__r2")), key, None)
    out = stats.drop("A2").join(r, key, "left").withColumn("A2", F.when(F.col("A1") == F.col("__r1"), F.col("__r2")).otherwise(F.col("__r1"))).drop("__r1", "__r2")
    if not allow_na and not out.where("A2 IS NULL").isEmpty():
        raise ValueError("A2 can't be inferred for every variant")
    return out


def infer_snp(stats: DataFrame, ref: DataFrame, allow_na: bool = False) -> DataFrame:
    """stats with SNP looked up by CHR and POS."""
    r = _first(ref.select("CHR", "POS", "SNP"), ["CHR", "POS"], None)
    out = stats.drop("SNP").join(r, ["CHR", "POS"], "left")
    if not allow_na and not out.where("SNP IS NULL").isEmpty():
        raise ValueError("some variants have no identifier in the reference")
    return out


def intersect_keys(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Distinct keys that every table has."""
    return reduce(lambda a, b: a.join(b.select(*key).distinct(), key, "left_semi"), tables[1:], tables[0].select(*key).distinct())


def align(tables: list[DataFrame], key: list[str]) -> list[DataFrame]:
    """Each table reduced to the rows whose key all have."""
    common = intersect_keys(tables, key)
    return [t.join(common, key, "left_semi") for t in tables]


def harmonize(genotypes: DataFrame, stats: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """[genotypes, stats, others...] on common chromosomes and variants, stats referring to the A1 of the genotypes.

    All tables have CHR, and SNP or POS. A chromosome that any source lacks is dropped. One lazy plan, no loop over
    chromosomes; the result doesn't change when it is harmonised again.
    """
    key = match_key(genotypes, stats)
    on = key if "CHR" in key else ["CHR", *key]
    common = intersect_keys([genotypes, stats, *others], on)
    s = merge_alleles(genotypes.join(common, on, "left_semi"), stats.join(common, on, "left_semi").drop(*[c for c in ("CHR",) if "CHR" not in key]))
    kept = s.select(*key)
    g = genotypes.join(kept, key, "left_semi")
    if "CHR" not in s.columns:
        s = s.join(g.select(*key, "CHR").distinct(), key)
    return [g, s, *[t.join(kept, key, "left_semi") for t in others]]


def chromosome_key(x: Column) -> Column:
    """Chromosome name without its prefix (chr_, chr:, chr), in lower case."""
    return F.regexp_replace(F.lower(F.trim(x.cast("string"))), r"^chr[_:]?", "")


def split_by_chromosome(stats: DataFrame, variants: DataFrame) -> DataFrame:
    """stats with the CHR that a variant table gives; variants it doesn't list are left out."""
    return stats.drop("CHR").join(_first(variants.select("SNP", "CHR"), ["SNP"], None), "SNP")
