"""Several sources held together: filtered, harmonised, scored. Immutable; every step is a lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.sumstats import derive
from genoloom.operators import association, genotype, ld, merge, scoring
from genoloom.sources import bed, ldstore, sumstats, tables


@dataclass(frozen=True)
class Study:
    """variants: variant_idx, CHR, SNP, POS, cM, A1, A2. calls and samples are keyed by variant_idx and sample_idx."""

    variants: DataFrame | None = None
    calls: DataFrame | None = None
    samples: DataFrame | None = None
    stats: DataFrame | None = None
    annotations: DataFrame | None = None
    edges: DataFrame | None = None

    @classmethod
    def from_bed(cls, spark: SparkSession, path: str) -> Study:
        bed.register(spark)
        variants, samples = tables.numbered(tables.read_bim(spark, path), "variant_idx"), tables.numbered(tables.read_fam(spark, path), "sample_idx")
        return cls(variants, spark.read.format("genoloom_bed").load(path), samples)

    def with_stats(self, spark: SparkSession, path: str | list[str], fmt: str = "canonical", n: float | None = None, drop_repeated: bool = True) -> Study:
        """n: sample size of a file that has none."""
        own = sumstats.read_sumstats(spark, path, fmt)
        own = genotype.drop_repeated(own, ["SNP"]) if drop_repeated else own
        return replace(self, stats=own if n is None else own.withColumn("N", F.lit(float(n))))

    def with_annotations(self, spark: SparkSession, path: str | list[str], ldsc: bool = False, keep: list[str] | None = None) -> Study:
        own = tables.read_annotations(spark, path, ldsc)
        return replace(self, annotations=own if keep is None else own.select("CHR", "SNP", "POS", *keep))

    def with_phenotype(self, spark: SparkSession, path: str, drop_na: bool = True) -> Study:
        return replace(self, samples=tables.read_phenotype(spark, self.samples, path, drop_na))._synced()

    def with_covariates(self, spark: SparkSession, path: str) -> Study:
        return replace(self, samples=tables.read_covariates(spark, self.samples, path))._synced()

    def with_ld(self, spark: SparkSession, path: str, chromosome: int | None = None) -> Study:
        """The edges of a store; without genotypes, the store's variants are those of the study."""
        e = ldstore.read_store(spark, path, chromosome)
        v = ldstore.read_variants(spark, path)
        v = v if chromosome is None else v.where(F.col("chr") == chromosome)
        return replace(self, edges=e, variants=self.variants if self.variants is not None else v.withColumnsRenamed({"chr": "CHR", "i": "variant_idx"}))

    def with_values(self, phenotype: DataFrame) -> Study:
        """samples with the phenotype of a table (IID, phenotype); samples that it lacks get null."""
        own = phenotype.groupBy("IID").agg(F.first("phenotype").alias("phenotype"))
        return replace(self, samples=self.samples.drop("phenotype").join(own, "IID", "left"))

    def sizes(self) -> DataFrame:
        """(samples, variants, stats, max_n): one row; 0 where there is no such source."""
        count = lambda df: df.count() if df is not None else 0
        most = self.stats.agg(F.max("N").cast("double")).first()[0] if self.stats is not None and "N" in self.stats.columns else None
        spark = (self.variants if self.variants is not None else self.stats).sparkSession
        return spark.createDataFrame([(count(self.samples), count(self.variants), count(self.stats), most)], "samples bigint, variants bigint, stats bigint, max_n double")

    def shapes(self) -> DataFrame:
        """(CHR, variants) of every chromosome."""
        return self.variants.groupBy("CHR").agg(F.count(F.lit(1)).alias("variants"))

    def individual_table(self) -> DataFrame:
        return self.samples.select([c for c in ("FID", "IID", "fatherID", "motherID", "sex", "phenotype") if c in self.samples.columns])

    def phenotype_table(self) -> DataFrame:
        return self.samples.select("FID", "IID", "phenotype")

    def covariates_table(self, names: list[str] | None = None) -> DataFrame:
        known = ("FID", "IID", "fatherID", "motherID", "sex", "phenotype", "sample_idx")
        return self.samples.select("FID", "IID", *(names or [c for c in self.samples.columns if c not in known]))

    def snp_table(self, columns: tuple[str, ...] = ("CHR", "SNP", "POS", "A1", "A2")) -> DataFrame:
        """The wanted columns of the variants in this order; MAF, MAF_VAR, MAC and N come from the calls where they are missing."""
        return genotype.with_counts(self.variants, self.calls, list(columns))

    def stats_table(self, columns: tuple[str, ...] = ("CHR", "SNP", "POS", "A1", "A2", "MAF", "N", "BETA", "Z", "SE", "PVAL")) -> DataFrame:
        return derive(self.stats, list(columns))

    def binary_annotations(self) -> list[str]:
        """Names of the annotations with just the values 0 and 1."""
        names = [c for c in self.annotations.columns if c not in ("CHR", "SNP", "POS")]
        row = self.annotations.agg(*[(F.count_distinct(c) == 2).alias(c) for c in names]).first() if names else {}
        return [c for c in names if row[c]]

    def keep_variants(self, ids: DataFrame) -> Study:
        own = lambda df: None if df is None else genotype.keep_ids(df, ids, "SNP")
        return replace(self, variants=own(self.variants), stats=own(self.stats), annotations=own(self.annotations))._synced()

    def keep_samples(self, ids: DataFrame) -> Study:
        return replace(self, samples=genotype.keep_ids(self.samples, ids, "IID"))._synced()

    def frequent(self, min_maf: float | None = None, min_mac: int | None = None) -> Study:
        good = genotype.frequent(genotype.allele_frequency(self.calls), min_maf, min_mac)
        return replace(self, variants=self.variants.join(good, "variant_idx", "left_semi"))._synced()

    def _synced(self) -> Study:
        calls = self.calls
        if calls is not None:
            calls = calls.join(self.variants.select("variant_idx"), "variant_idx", "left_semi").join(self.samples.select("sample_idx"), "sample_idx", "left_semi")
        return replace(self, calls=calls)

    def harmonized(self) -> Study:
        others = [self.annotations] if self.annotations is not None else []
        v, s, *rest = merge.harmonize(self.variants, self.stats, *others)
        return replace(self, variants=v, stats=s, annotations=rest[0] if rest else None)._synced()

    def gwas(self, standardize: bool = False, likelihood: str = "gaussian") -> DataFrame:
        f = association.logistic if likelihood == "binomial" else lambda c, s: association.linear(c, s, standardize)
        found = f(self.calls, self.samples.withColumnRenamed("phenotype", "status") if likelihood == "binomial" else self.samples)
        return found.join(self.variants, "variant_idx")

    def correlation(self, estimator: str = "windowed", **how) -> DataFrame:
        v = self.variants.select("variant_idx", F.col("CHR").alias("chr"), F.col("POS").alias("pos"), F.col("cM").alias("cm"), *[c for c in self.variants.columns if c == "block_start"])
        return ld.estimate(self.calls, v, estimator, **how)

    def score(self, mode: str = "raw") -> DataFrame:
        """Scores by BETA of the statistics, or its standardised form where BETA is missing."""
        standard = F.col("Z") / F.sqrt(F.col("N") - 1 + F.col("Z") * F.col("Z")) if {"Z", "N"} <= set(self.stats.columns) else F.lit(None).cast("double")
        beta = F.coalesce(F.col("BETA"), standard) if "BETA" in self.stats.columns else standard
        effects = self.stats.withColumn("score", beta).join(self.variants.select("SNP", "variant_idx"), "SNP").select("variant_idx", "score")
        return scoring.score(self.calls, effects, ["score"], mode, samples=self.samples)

    def split(self) -> dict[int, Study]:
        """One study per chromosome."""
        chromosomes = [r.CHR for r in self.variants.select("CHR").distinct().orderBy("CHR").collect()]
        own = lambda df, c: None if df is None else df.where(F.col("CHR") == c)
        return {c: replace(self, variants=own(self.variants, c), stats=own(self.stats, c), annotations=own(self.annotations, c))._synced() for c in chromosomes}
