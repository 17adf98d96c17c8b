"""Queries over the delivered summary statistics and the panel as they are: all rows of all loads, nulls and faults included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.stats import nlog10_pvalue
from genoloom.functions.sumstats import derive
from genoloom.operators import association, genotype, intervals, merge
from genoloom.plans.checks import with_erfc
from genoloom.plans.genetics import rounded
from genoloom.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CANONICAL = {"chr": "CHR", "snp": "SNP", "pos": "POS", "a1": "A1", "a2": "A2", "maf": "MAF", "n": "N", "beta": "BETA", "z": "Z", "se": "SE", "pval": "PVAL", "cm": "cM"}


def query(sql: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name).withColumnsRenamed(_CANONICAL))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return add


def _clean(df: DataFrame) -> DataFrame:
    """NaN as null."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH s AS (SELECT row_id, CASE WHEN isnan(z) THEN NULL ELSE z END AS z, maf, n, se, beta FROM sumstats), {with_erfc('w', 's', 'z')} SELECT row_id, round(z * z, 9) AS CHISQ, round(2 * maf * (1 - maf), 6) AS MAF_VAR, round(CASE WHEN n - 1 + z * z > 0 THEN z / sqrt(n - 1 + z * z) END, 6) AS STD_BETA, CAST(sign(coalesce(beta, z)) AS DOUBLE) AS SIGN, round(NL, 4) AS NLOG10_PVAL FROM w")
def loads_derive(t):
    d = derive(_clean(t("sumstats")).drop("PVAL"), ["row_id", "CHISQ", "MAF_VAR", "STD_BETA", "SIGN", "NLOG10_PVAL"])
    digits = {"CHISQ": 9, "MAF_VAR": 6, "STD_BETA": 6, "NLOG10_PVAL": 4}
    return _clean(d).select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in d.columns])


@query("SELECT round(quantile_cont(z * z, 0.5) / 0.454936423119572, 6) AS lambda_gc FROM sumstats WHERE NOT isnan(z)")
def loads_inflation(t):
    return rounded(association.inflation(derive(_clean(t("sumstats")).where("Z IS NOT NULL"), ["CHISQ"])))


@query("WITH r AS (SELECT chr, pos, min(snp) AS snp FROM variants GROUP BY chr, pos) SELECT s.row_id, r.snp AS SNP FROM sumstats s LEFT JOIN r ON r.chr = s.chr AND r.pos = s.pos")
def loads_infer_snp(t):
    return merge.infer_snp(t("sumstats").select("row_id", "CHR", "POS"), t("variants"), allow_na=True).select("row_id", "SNP")


@query("""WITH j AS (SELECT s.row_id, v.snp, v.a1, v.a2, s.a1 AS b1, s.a2 AS b2, s.beta, s.maf FROM sumstats s JOIN variants v ON v.snp = s.snp),
f AS (SELECT *, b1 = a1 AND b2 = a2 AS same, b1 = a2 AND b2 = a1 AND NOT (b1 = a1 AND b2 = a2) AS flip FROM j)
SELECT row_id, snp AS SNP, a1 AS A1, a2 AS A2, round(CASE WHEN flip THEN -beta ELSE beta END, 6) AS BETA, round(CASE WHEN flip THEN 1 - maf ELSE maf END, 6) AS MAF FROM f WHERE same OR flip""")
def loads_orient(t):
    return rounded(merge.orient(t("sumstats").select("row_id", "SNP", "A1", "A2", "BETA", "MAF"), t("variants").select("SNP", "A1", "A2")).select("row_id", "SNP", "A1", "A2", "BETA", "MAF"))


@query("SELECT s.row_id, s.snp AS SNP, v.chr AS CHR FROM sumstats s JOIN variants v ON v.snp = s.snp")
def loads_by_chromosome(t):
    return merge.split_by_chromosome(t("sumstats").select("row_id", "SNP"), t("variants")).select("row_id", "SNP", "CHR")


@query("SELECT row_id, CAST(EXISTS (SELECT 1 FROM build_shifts b WHERE b.chr = s.chr AND s.pos BETWEEN b.region_start AND b.region_start + 200000) AS INTEGER) AS inside FROM sumstats s")
def loads_near_region_starts(t):
    regions = t("build_shifts").select(F.col("CHR").alias("chr"), "region_start", (F.col("region_start") + 200_000).alias("region_end"))
    return intervals.annotate(t("sumstats").select("row_id", "CHR", "POS"), regions, "inside", ["row_id"], bounds=("chr", "region_start", "region_end"), width=100_000).select("row_id", "inside")


@query("SELECT s.row_id, b.region_start, b.region_end FROM sumstats s ASOF LEFT JOIN build_shifts b ON s.chr = b.chr AND s.pos >= b.region_start")
def loads_region(t):
    regions = t("build_shifts").select(F.col("CHR").alias("chr"), "region_start", "region_end")
    return intervals.as_of_blocks(t("sumstats").select("row_id", "CHR", "POS"), regions, bounds=("chr", "region_start", "region_end")).select("row_id", "region_start", "region_end")


@query("SELECT row_id FROM sumstats WHERE load_id IN (SELECT load_id FROM (SELECT load_id, snp FROM sumstats) GROUP BY load_id, snp HAVING count(*) = 1) AND (load_id, snp) IN (SELECT (load_id, snp) FROM sumstats WHERE snp IS NOT NULL AND load_id IS NOT NULL GROUP BY load_id, snp HAVING count(*) = 1)")
def loads_unrepeated(t):
    """Rows whose variant stands once in their load; those without a variant or load are left out."""
    own = t("sumstats").where("load_id IS NOT NULL AND SNP IS NOT NULL").select("row_id", "load_id", "SNP")
    return genotype.drop_repeated(own, ["load_id", "SNP"]).select("row_id")


@query(f"WITH s AS (SELECT row_id, beta / nullif(se, 0) AS z FROM sumstats), {with_erfc('w', 's', 'z')} SELECT row_id, round(NL, 3) AS NLOG10_PVAL FROM w WHERE zx IS NOT NULL AND NOT isnan(zx) AND zx < 1000")
def loads_wald(t):
    """-log10 of the p-value that effect and standard error give, whatever the file says."""
    z = t("sumstats").select("row_id", F.try_divide("BETA", "SE").alias("Z")).where("Z IS NOT NULL AND NOT isnan(Z) AND abs(Z) < 1000 * sqrt(2D)")
    return z.select("row_id", F.round(nlog10_pvalue("Z"), 3).alias("NLOG10_PVAL"))
