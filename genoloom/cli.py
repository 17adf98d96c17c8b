"""Commands compute-ld, prune, expand, extract, simulate and gwas, in the session that the environment gives.

    python -m genoloom.cli prune --ld store --stats stats.txt --r2 0.2 --out kept
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genoloom.loader import Study
from genoloom.operators import banded, graph, intervals, simulate
from genoloom.sources import ldstore, sumstats, tables
from genoloom.storage import sorted_join


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genoloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compute-ld")
    c.add_argument("--bed", required=True), c.add_argument("--out", required=True)
    c.add_argument("--estimator", default="windowed", choices=["sample", "windowed", "block", "shrinkage"])
    c.add_argument("--size", type=int), c.add_argument("--kb", type=float), c.add_argument("--cm", type=float)
    c.add_argument("--blocks"), c.add_argument("--ne", type=float), c.add_argument("--n", type=int)
    c.add_argument("--min-maf", type=float), c.add_argument("--min-mac", type=int), c.add_argument("--bits", type=int, default=16)
    for name in ("prune", "expand", "extract"):
        c = sub.add_parser(name)
        c.add_argument("--ld", required=True), c.add_argument("--out", required=True)
        c.add_argument("--snps"), c.add_argument("--r2", type=float, default=0.2)
        c.add_argument("--stats"), c.add_argument("--format", default="canonical"), c.add_argument("--region", action="append")
        c.add_argument("--dense", action="store_true", help="extract: a line for every variant with its whole row of its chromosome's matrix")
    c = sub.add_parser("simulate")
    c.add_argument("--bed", required=True), c.add_argument("--out", required=True)
    c.add_argument("--h2", type=float, default=0.2), c.add_argument("--causal", type=float, default=0.1)
    c.add_argument("--prevalence", type=float), c.add_argument("--seed", type=int, default=1)
    c = sub.add_parser("gwas")
    c.add_argument("--bed", required=True), c.add_argument("--out", required=True), c.add_argument("--pheno"), c.add_argument("--format", default="canonical")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "compute-ld":
        study = Study.from_bed(spark, a.bed).frequent(a.min_maf, a.min_mac)
        if a.blocks:
            v = intervals.as_of_blocks(study.variants, tables.read_blocks(spark, a.blocks), matched_only=True)
            study = Study(v, study.calls, study.samples)
        edges = study.correlation(a.estimator, size=a.size, kb=a.kb, cm=a.cm, ne=a.ne, n=a.n)
        v = study.variants.select(F.col("CHR").alias("chr"), F.col("variant_idx").alias("i"), "SNP", "POS", "A1", "A2")
        ldstore.write_store(a.out, edges, v, {"estimator": a.estimator}, a.bits)
    elif a.command in ("prune", "expand", "extract"):
        edges, v = ldstore.read_store(spark, a.ld), ldstore.read_variants(spark, a.ld)
        listed = tables.read_snp_list(spark, a.snps).withColumn("ord", F.monotonically_increasing_id()) if a.snps else None
        if a.command == "prune":
            rank = None
            if a.stats or listed is not None:
                v, rank = graph.ordered(v, listed, sumstats.read_sumstats(spark, a.stats, a.format) if a.stats else None), "rank"
            kept = graph.prune(edges, v, a.r2**0.5, by=["chr"], rank=rank)
            tables.write_table(v.join(kept, ["chr", "i"], "left_semi").select("SNP"), a.out, header=False)
        elif a.command == "expand":
            found = graph.expand(edges, v.join(listed, "SNP").select("chr", "i", "ord"), a.r2, by=["chr"])
            tables.write_table(sorted_join(v, found, ["chr", "i"]).orderBy("part", "ord", "chr", "i").select("SNP"), a.out, header=False)
        else:
            own = v if listed is None else v.join(listed, "SNP", "left_semi")
            if a.region:
                r = spark.createDataFrame([(tables.chromosome(c), s, e) for c, s, e in intervals.regions(a.region)], "chr int, start_pos int, end_pos int")
                own = intervals.inside(own, F.broadcast(r), ["chr", "i"], chr_col="chr")  # those of the command line
            ids = own.select("chr", "i", "SNP")
            if a.dense:
                cells = F.transform("values", lambda x: x.cast("string"))
                banded.dense(edges, ids, by=["chr"]).orderBy("chr", "i").select(F.concat_ws("\t", "chr", "SNP", cells).alias("value")).write.mode("overwrite").text(a.out)
                return
            near = sorted_join(sorted_join(edges, ids.withColumnRenamed("SNP", "SNP_A"), ["chr", "i"]), ids.select("chr", F.col("i").alias("j"), F.col("SNP").alias("SNP_B")), ["chr", "j"])
            tables.write_table(near.select("chr", "SNP_A", "SNP_B", "r"), a.out)
    elif a.command == "simulate":
        study = Study.from_bed(spark, a.bed)
        truth, y = simulate.simulate(study.calls, study.variants, a.h2, (1 - a.causal, a.causal), (0.0, 1.0), a.seed, a.prevalence)
        tables.write_table(truth.select("SNP", "A1", "BETA", "causal"), f"{a.out}/effects")
        tables.write_table(study.samples.drop("phenotype").join(y, "sample_idx").select("FID", "IID", "phenotype"), f"{a.out}/phenotype")
    else:
        study = Study.from_bed(spark, a.bed)
        if a.pheno:
            study = Study(study.variants, study.calls, tables.read_phenotype(spark, study.samples, a.pheno))
        sumstats.write_sumstats(study.gwas(), a.out, a.format)


if __name__ == "__main__":
    main()
