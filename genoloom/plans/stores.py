"""Queries of sources, sinks, stores, the loader and simulations: what is written and read again equals the view it came from.

Files go to the application's folder in the shared one. Random results are checked by what must hold of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom import cli, storage
from genoloom.functions.sumstats import derive
from genoloom.loader import Study
from genoloom.operators import association, banded, genotype, graph, intervals, ld, merge, phenotype, simulate, spectral
from genoloom.plans.genetics import _BOTH, _FREQ, _R, _W, _greedy_sql, by_chr, lettered, rounded
from genoloom.plans.views import duck, view
from genoloom.sources import bed, ldstore, sumstats, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The views of a folder, and new paths for files."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def path(self, name: str) -> str:
        return storage.scratch(self.spark, name)

    def lines(self, df: DataFrame, *columns: str, sep: str = " ", header: str | None = None) -> str:
        """Path of a text file with the columns of df; one file, if it has a header."""
        path = self.path("lines")
        text = df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns or df.columns]).alias("value"))
        if header is not None:
            text = self.spark.createDataFrame([(0, header)], "k int, value string").unionByName(text.withColumn("k", F.lit(1))).repartition(1).sortWithinPartitions("k").select("value")
        text.write.text(path)
        return path


def query(sql: str, views: str):
    """Registers a query under its function's name; views names those that the SQL needs."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = duck(sql, *views.split())
        return f

    return add


# --- genotype files -------------------------------------------------------------------------------------------------


def _panel(v: Views) -> str:
    """Path of a bed file with bim and fam made of the calls; sample i of the file is sample_idx i."""
    base = v.path("panel").removeprefix("file://")
    os.makedirs(os.path.dirname(base), exist_ok=True)
    variants, samples = v("variants64").orderBy("variant_idx").collect(), v("samples").orderBy("sample_idx").collect()  # 64 and a panel's samples
    bed.write_bed(v("calls"), base + ".bed", len(samples))
    with open(base + ".bim", "w") as f:
        f.writelines(f"{r.chr}\t{r.snp}\t{r.cm}\t{r.pos}\tA\tC\n" for r in variants)
    with open(base + ".fam", "w") as f:
        f.writelines(f"F{r.sample_idx % 7}\tI{r.sample_idx}\t0\t0\t{int(r.covar_1)}\t{r.phenotype if r.sample_idx % 10 else -9}\n" for r in samples)
    return base + ".bed"


def _study(v: Views) -> Study:
    return Study.from_bed(v.spark, _panel(v))


@query("SELECT CAST(sample_idx AS BIGINT) AS sample_idx, CAST(variant_idx AS BIGINT) AS variant_idx, dosage FROM calls", "calls")
def bed_scan(v):
    bed.register(v.spark)
    return v.spark.read.format("genoloom_bed").load(_panel(v))


@query("SELECT CAST(sample_idx AS BIGINT) AS sample_idx, CAST(variant_idx AS BIGINT) AS variant_idx, dosage FROM calls WHERE sample_idx IN (3, 10, 20, 50) AND variant_idx >= 40", "calls")
def bed_selected(v):
    bed.register(v.spark)
    return v.spark.read.format("genoloom_bed").option("samples", "50,3,20,10").load(_panel(v)).where("variant_idx >= 40")


@query("SELECT variant_idx, CAST(sum(coalesce(dosage, 0)) AS BIGINT) AS total, count(*) - count(dosage) AS missing, count(*) AS n FROM calls GROUP BY variant_idx", "calls")
def packed_genotypes(v):
    p = genotype.packed(v("calls"))
    return p.select("variant_idx", F.aggregate("dosages", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"), F.size(F.filter("dosages", lambda x: x.isNull())).cast("bigint").alias("missing"), F.size("samples").cast("bigint").alias("n"))


@query("SELECT sample_idx, variant_idx, dosage FROM calls", "calls")
def unpacked_genotypes(v):
    return genotype.unpacked(genotype.packed(v("calls"))).select("sample_idx", "variant_idx", "dosage")


@query("SELECT CHR, SNP, POS, A1, A2, round(MAF, 5) AS cM FROM refpanel", "refpanel")
def bim_scan(v):
    df = v("refpanel").withColumn("cM", F.round("MAF", 5))
    chromosome = F.when(F.col("CHR") % 2 == 0, F.concat(F.lit("chr"), F.col("CHR"))).otherwise(F.col("CHR").cast("string"))
    return rounded(tables.read_bim(v.spark, v.lines(df.withColumn("CHR", chromosome), "CHR", "SNP", "cM", "POS", "A1", "A2", sep="\t")).withColumn("cM", F.round(F.col("cM").cast("double"), 5)), 5)


@query("SELECT concat('F', sample_idx % 7) AS FID, concat('I', sample_idx) AS IID, '0' AS fatherID, '0' AS motherID, nullif(CAST(covar_1 AS FLOAT), 0) AS sex, round(CASE WHEN sample_idx % 10 <> 0 THEN phenotype END, 4) AS phenotype FROM samples", "samples")
def fam_scan(v):
    return tables.read_fam(v.spark, _panel(v)).withColumn("phenotype", F.round(F.col("phenotype").cast("double"), 4))


@query("SELECT CAST(row_number() OVER (ORDER BY sample_idx) - 1 AS BIGINT) AS sample_idx, concat('I', sample_idx) AS IID FROM samples", "samples")
def numbered_samples(v):
    return _study(v).samples.select("sample_idx", "IID")


# --- text tables ----------------------------------------------------------------------------------------------------


@query("SELECT SNP FROM vars", "vars")
def snp_list_scan(v):
    path = v.path("list")
    tables.write_table(v("vars").select("SNP"), path, header=False)
    return tables.read_snp_list(v.spark, path)


@query("SELECT concat('I', sample_idx) AS IID FROM samples", "samples")
def sample_list_scan(v):
    s = v("samples").select(F.concat(F.lit("F"), "sample_idx").alias("FID"), F.concat(F.lit("I"), "sample_idx").alias("IID"))
    return tables.read_sample_list(v.spark, v.lines(s))


@query("SELECT concat('I', sample_idx) AS IID, concat('c', sample_idx % 3) AS Cluster, phenotype FROM samples", "samples")
def samples_in_clusters(v):
    s = v("samples").select(F.concat(F.lit("F"), "sample_idx").alias("FID"), F.concat(F.lit("I"), "sample_idx").alias("IID"), F.concat(F.lit("c"), (F.col("sample_idx") % 3).cast("string")).alias("Cluster"), "phenotype")
    clusters = tables.read_clusters(v.spark, v.lines(s, "FID", "IID", "Cluster"))
    return genotype.split_groups(s.select("IID", "phenotype"), clusters.select("IID", "Cluster"), "IID").select("IID", "Cluster", "phenotype")


@query("SELECT CASE WHEN chr = 22 THEN 23 ELSE chr END AS chr, start_pos, end_pos FROM intervals", "intervals")
def intervals_scan(v):
    df = v("intervals").withColumn("chr", F.when(F.col("chr") == 22, "chrX").when(F.col("chr") % 2 == 0, F.concat(F.lit("chr"), "chr")).otherwise(F.col("chr").cast("string")))
    return tables.read_intervals(v.spark, v.lines(df, "chr", "start_pos", "end_pos", "id", sep="\t"))


@query("SELECT chr, block_start, block_end FROM blocks WHERE block_start <> 20000", "blocks")
def blocks_scan(v):
    df = v("blocks").withColumn("end", F.when(F.col("block_start") == 20000, "None").otherwise(F.col("block_end").cast("string")))
    return tables.read_blocks(v.spark, v.lines(df, "chr", "block_start", "end", header="chr start stop"))


@query("SELECT CHR, SNP, POS, CAST(big AS DOUBLE) AS big, CAST(quarter AS DOUBLE) AS quarter, price FROM annot", "annot")
def annotations_scan(v):
    path = v.path("annotations")
    tables.write_table(v("annot").select("CHR", "SNP", "POS", "big", "quarter", "price").coalesce(1), path, gzip=True)
    return tables.read_annotations(v.spark, path)


@query("SELECT CHR, SNP, POS, CAST(big AS DOUBLE) AS big FROM annot", "annot")
def annotations_ldsc_scan(v):
    df = v("annot").select("CHR", F.col("POS").alias("BP"), "SNP", F.lit(0.5).alias("CM"), F.lit(1).alias("base"), "big")
    return tables.read_annotations(v.spark, v.lines(df, sep="\t", header="CHR\tBP\tSNP\tCM\tbase\tbig"), ldsc=True)


@query("SELECT concat('I', sample_idx) AS IID, phenotype FROM samples WHERE sample_idx % 5 <> 0 AND sample_idx % 7 <> 0", "samples")
def phenotype_scan(v):
    s = v("samples").withColumn("FID", F.lit("F")).withColumn("IID", F.concat(F.lit("I"), "sample_idx"))
    rows = s.where("sample_idx % 7 <> 0").withColumn("y", F.when(F.col("sample_idx") % 5 == 0, -9.0).otherwise(F.col("phenotype")))
    return tables.read_phenotype(v.spark, s.select("FID", "IID"), v.lines(rows, "FID", "IID", "y")).select("IID", "phenotype")


@query("SELECT concat('I', sample_idx) AS IID, CASE WHEN sample_idx % 6 <> 0 THEN covar_1 END AS age, covar_2 AS centre FROM samples WHERE sample_idx % 4 <> 0", "samples")
def covariates_scan(v):
    s = v("samples").withColumn("FID", F.lit("F")).withColumn("IID", F.concat(F.lit("I"), "sample_idx"))
    rows = s.where("sample_idx % 4 <> 0").withColumn("age", F.when(F.col("sample_idx") % 6 != 0, F.col("covar_1")))
    return tables.read_covariates(v.spark, s.select("FID", "IID"), v.lines(rows, "FID", "IID", "age", "covar_2", header="FID IID age centre")).select("IID", "age", "centre")


@query("SELECT concat('I', sample_idx) AS IID, CASE WHEN sample_idx % 3 = 0 THEN NULL ELSE phenotype * 2 END AS phenotype FROM samples", "samples")
def set_phenotype(v):
    s = v("samples").withColumn("IID", F.concat(F.lit("I"), "sample_idx"))
    return Study(samples=s).with_values(s.where("sample_idx % 3 <> 0").select("IID", (F.col("phenotype") * 2).alias("phenotype"))).samples.select("IID", "phenotype")


# --- summary statistics ---------------------------------------------------------------------------------------------

_STATS = "CHR, SNP, POS, A1, A2, round(MAF, 6) AS MAF, CAST(N AS DOUBLE) AS N, round(BETA, 6) AS BETA, round(SE, 6) AS SE"


def _through(fmt: str) -> Callable[[Views], DataFrame]:
    """Statistics written in a format and read again; rows without an effect are dropped as incomplete."""

    def run(v: Views) -> DataFrame:
        path = v.path(fmt)
        df = v("sumstats_v").select("CHR", "SNP", "POS", "A1", "A2", "MAF", "N", F.when(F.col("idx") % 10 != 0, F.col("BETA")).alias("BETA"), "SE", (F.col("BETA") / F.col("SE")).alias("Z"))
        sumstats.write_sumstats(df.coalesce(1), path, fmt)
        return rounded(sumstats.read_sumstats(v.spark, path, fmt).select("CHR", "SNP", "POS", "A1", "A2", "MAF", "N", "BETA", "SE"))

    return run


for _fmt in ("canonical", "plink", "plink2", "plink1.9", "cojo", "fastgwa", "ssf", "gwas-ssf", "gwascatalog", "saige"):
    _run = _through(_fmt)
    _run.__name__ = "sumstats_" + _fmt.replace(".", "").replace("-", "_")
    query(f"SELECT {_STATS} FROM sumstats_v WHERE idx % 10 <> 0", "sumstats_v")(_run)


@query("SELECT SNP, CASE WHEN idx % 2 = 0 THEN 'G' ELSE 'T' END AS A2 FROM vars", "vars")
def plink2_other_allele(v):
    df = v("vars").select("SNP", F.lit("1").alias("#CHROM"), F.lit("G").alias("REF"), F.lit("T").alias("ALT"), F.when(F.col("idx") % 2 == 0, "T").otherwise("G").alias("A1"), "BETA", "SE")
    return sumstats.canonical(df, sumstats.get_format("plink2")).select("SNP", "A2")


@query("SELECT SNP, round(SE * 100 / (2 * MAF), 6) AS N FROM vars", "vars")
def saige_sample_size(v):
    df = v("vars").select(F.col("SNP").alias("MarkerID"), F.col("A1").alias("Allele2"), F.col("MAF").alias("AF_Allele2"), (F.col("SE") * 100).alias("AC_Allele2"), "BETA", "SE")
    return rounded(sumstats.canonical(df, sumstats.get_format("saige")).select("SNP", "N"))


@query("SELECT SNP, round(ln(1 + MAF), 6) AS BETA, round(ln(1 + MAF) / SE, 6) AS Z, CAST(sign(ln(1 + MAF)) AS DOUBLE) AS SIGN FROM vars", "vars")
def odds_ratio_derive(v):
    return rounded(derive(v("vars").select("SNP", "SE", (1 + F.col("MAF")).alias("OR")), ["SNP", "BETA", "Z", "SIGN"]))


# --- stores of correlations -----------------------------------------------------------------------------------------

_BACK = "round(round_even(r * 32767, 0) / 32767.0, 6) AS r"
_V = "v AS (SELECT CHR AS chr, i, SNP, POS FROM ranked)"


def _store(v: Views, **how) -> str:
    path = v.path("store")
    ldstore.write_store(path, v("edges"), by_chr(v("ranked")).select("chr", "i", "SNP", "POS", "MAF"), {"estimator": "sample", "n": 500}, **how)
    return path


@query(f"SELECT chr, i, j, {_BACK} FROM edges", "edges")
def ld_store(v):
    return rounded(ldstore.read_store(v.spark, _store(v)))


@query("SELECT chr, i, j, r FROM edges WHERE chr = 5 AND i >= 10 AND i < 25", "edges")
def ld_store_part(v):
    return ldstore.read_store(v.spark, _store(v, bits=None), 5, (10, 25))


@query(f"SELECT i, j, r FROM (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_BACK} FROM (SELECT * FROM edges UNION ALL SELECT chr, j, i, r FROM edges) WHERE chr = 5 AND i >= 10 AND i < 25 UNION ALL SELECT i, i, 1.0 FROM (SELECT unnest(range(10, 25)) AS i))", "edges")
def ld_store_symmetric_rows(v):
    return rounded(ldstore.read_rows(v.spark, _store(v), 5, 10, 25, symmetric=True, diagonal=True))


@query("WITH e AS (SELECT chr, count(*) AS n FROM edges GROUP BY chr) SELECT v.CHR AS chr, count(*) AS variants, any_value(coalesce(n, 0)) AS entries, round(2.0 * any_value(coalesce(n, 0)) / count(*), 6) AS mean_neighbors, round(any_value(coalesce(n, 0)) * 16 / 8 / 1048576.0, 6) AS size_mb FROM ranked v LEFT JOIN e ON e.chr = v.CHR GROUP BY v.CHR", "edges ranked")
def ld_store_summary(v):
    return rounded(ldstore.summary(v.spark, _store(v)))


@query("SELECT 'valid' AS first, 'the entries are not contiguous around the diagonal' AS second, true AS moved, false AS deleted", "edges")
def ld_store_upkeep(v):
    """A store is valid, one with gaps isn't, and a store can be moved and deleted."""

    def told(path: str) -> str:
        try:
            ldstore.validate(v.spark, path)
        except ValueError as e:
            return str(e)
        return "valid"

    one, two = _store(v), v.path("gaps")
    ldstore.write_store(two, v("edges").where("j <> i + 2"), by_chr(v("ranked")).select("chr", "i"), {})
    results = told(one), told(two)
    new = v.path("moved")
    ldstore.move(v.spark, one, new)
    moved = not ldstore.read_store(v.spark, new).isEmpty()
    ldstore.delete(v.spark, two)
    fs, p = ldstore._fs(v.spark, two)
    return v.spark.createDataFrame([(*results, moved, bool(fs.exists(p)))], "first string, second string, moved boolean, deleted boolean")


@query(f"WITH {_BOTH}, q AS (SELECT chr, i, j, round_even(r * 32767, 0) / 32767.0 AS r FROM e2), s AS (SELECT chr, i, sum({_W}) AS s, count(*) AS n FROM q GROUP BY chr, i) SELECT v.CHR AS chr, v.i, SNP, POS, round(1 + coalesce(s.s, 0), 5) AS LDScore, coalesce(s.n, 0) + 1 AS WindowSize FROM ranked v LEFT JOIN s ON s.chr = v.CHR AND s.i = v.i", "edges ranked")
def ld_snp_table(v):
    return rounded(ldstore.snp_table(v.spark, _store(v)).select("chr", "i", "SNP", "POS", "LDScore", "WindowSize"), 5)


@query("WITH k AS (SELECT CHR AS chr, i, SNP, row_number() OVER (PARTITION BY CHR ORDER BY i) - 1 AS n FROM ranked v WHERE NOT EXISTS (SELECT 1 FROM intervals x WHERE x.chr = v.CHR AND v.POS BETWEEN x.start_pos AND x.end_pos)) SELECT e.chr, a.n AS i, b.n AS j, a.SNP AS SNP_A, b.SNP AS SNP_B FROM edges e JOIN k a ON a.chr = e.chr AND a.i = e.i JOIN k b ON b.chr = e.chr AND b.i = e.j", "edges ranked intervals")
def ld_outside_regions(v):
    e, w = ldstore.outside_regions(v.spark, _store(v), v("intervals"))
    name = lambda i, n: w.select("chr", F.col("i").alias(i), F.col("SNP").alias(n))
    return e.join(name("i", "SNP_A"), ["chr", "i"]).join(name("j", "SNP_B"), ["chr", "j"]).select("chr", "i", "j", "SNP_A", "SNP_B")


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, coalesce(CASE WHEN i % 9 <> 0 THEN r END, 0) AS r FROM edges WHERE chr = 3", "edges ranked")
def ld_pair_table(v):
    w = by_chr(v("ranked")).where("chr = 3").select("SNP", F.col("i").cast("bigint").alias("i"))
    e = storage.sorted_join(storage.sorted_join(v("edges").where("chr = 3"), w.withColumnRenamed("SNP", "SNP_B"), ["i"]), w.select(F.col("SNP").alias("SNP_A"), F.col("i").alias("j")), ["j"])
    return banded.from_pair_table(e.select("SNP_A", "SNP_B", F.when(F.col("i") % 9 != 0, F.col("r")).alias("R")), w)


_DENSE = "WITH m AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, r FROM edges WHERE chr = 3 AND i >= 5 AND j < 20)"


@query(f"{_DENSE} SELECT a.i - 5 AS i, a.j - 5 AS j, r FROM m a", "edges")
def ld_from_dense(v):
    rows = banded.dense(v("edges").where("chr = 3"), v("ranked").where("CHR = 3 AND i >= 5 AND i < 20").select(F.col("i").cast("bigint").alias("i"), "SNP"))
    e = banded.from_dense(rows.select((F.col("i") - 5).alias("i"), "values")).where("r <> 0")
    return e.select("i", F.col("j").cast("bigint").alias("j"), "r")


@query(f"{_DENSE} SELECT i, j, r FROM m", "edges")
def ld_from_ragged(v):
    e = v("edges").where("chr = 3 AND i >= 5 AND j < 20").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "r")
    rows = e.groupBy("i").agg(F.min("j").alias("start"), F.sort_array(F.collect_list(F.struct("j", "r"))).alias("c")).select("i", "start", F.col("c.r").alias("values"))
    return banded.from_ragged(rows)


@query("SELECT i, list(j ORDER BY j)::VARCHAR AS columns, round(list_sum(list(r ORDER BY j)), 6) AS total FROM edges WHERE chr = 3 GROUP BY i", "edges")
def ld_compressed(v):
    c = banded.compressed(v("edges").where("chr = 3"))
    return rounded(c.select("i", F.concat(F.lit("["), F.concat_ws(", ", F.transform("columns", lambda x: x.cast("string"))), F.lit("]")).alias("columns"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("SELECT SNP, len(x)::INTEGER AS n, round(list_sum(x), 6) AS total FROM (SELECT a.SNP, list(CASE WHEN a.i = b.i THEN 1.0 ELSE coalesce(e.r, f.r, 0) END) AS x FROM ranked a JOIN ranked b ON b.CHR = a.CHR AND b.POS BETWEEN 1000 AND 30000 LEFT JOIN edges e ON e.chr = a.CHR AND e.i = a.i AND e.j = b.i LEFT JOIN edges f ON f.chr = a.CHR AND f.i = b.i AND f.j = a.i WHERE a.POS BETWEEN 1000 AND 30000 GROUP BY a.SNP)", "edges ranked")
def ld_dense_region(v):
    regions = v.spark.createDataFrame([(tables.chromosome(c), s, e) for c, s, e in intervals.regions([f"chr{k}:1,000-30,000" for k in range(1, 23)])], "chr int, start_pos int, end_pos int")
    own = intervals.inside(by_chr(v("ranked")), F.broadcast(regions), ["chr", "i"], chr_col="chr")  # 22 rows
    d = banded.dense(v("edges"), own, by=["chr"])
    return rounded(d.select("SNP", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("WITH n AS (SELECT count(*) AS m FROM ranked WHERE CHR = 3) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, r FROM edges WHERE chr = 3 UNION ALL SELECT i + m, j + m, r FROM edges, n WHERE chr = 4", "edges ranked")
def ld_stack_blocks(v):
    m = v("ranked").where("CHR = 3").count()
    return banded.stack_blocks([(v("edges").where("chr = 3"), m), (v("edges").where("chr = 4"), 0)]).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "r")


@query("SELECT i, j, CASE WHEN i >= 10 AND i < 20 THEN r / 2 ELSE r END AS r FROM edges WHERE chr = 3", "edges")
def ld_replace_rows(v):
    e = v("edges").where("chr = 3").select("i", "j", "r")
    return banded.replace_rows(e, e.withColumn("r", F.col("r") / 2), 10, 20)


@query("WITH n AS (SELECT unnest(range(0, (SELECT count(*) FROM ranked WHERE CHR = 3) + 1)) AS i), c AS (SELECT i, count(*) AS c FROM edges WHERE chr = 3 GROUP BY i) SELECT i, CAST(coalesce(sum(c) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM n LEFT JOIN c USING (i)", "edges ranked")
def ld_row_pointer(v):
    return banded.row_pointer(v("edges").where("chr = 3"), v("ranked").where("CHR = 3").count())


@query("SELECT e.chr, CAST(i // 15 AS BIGINT) AS block_id, i, j, r FROM edges e WHERE i // 15 = j // 15", "edges ranked")
def ld_block_iterator(v):
    return banded.block_edges(v("edges"), banded.assign_blocks(by_chr(v("ranked")), size=15), by=["chr"])


@query("SELECT chr, CAST(block_id AS BIGINT) AS block_id, min(i) AS first, max(i) + 1 AS \"end\", count(*) AS variants FROM (SELECT CHR AS chr, i, CASE WHEN i < 7 THEN 0 WHEN i < 30 THEN 1 WHEN i < 50 THEN 2 END AS block_id FROM ranked) WHERE block_id IS NOT NULL GROUP BY 1, 2", "ranked")
def ld_block_ends(v):
    return banded.block_ends(banded.assign_given_blocks(by_chr(v("ranked")), [0, 7, 30, 50]), by=["chr"])


@query("SELECT CHR, min(n) AS first, max(n) + 1 AS \"end\" FROM (SELECT CHR, row_number() OVER (ORDER BY CHR, i) - 1 AS n FROM ranked) GROUP BY CHR", "ranked")
def slice_table(v):
    w = W.orderBy("CHR", "i")  # the small view's rows in one order
    return banded.slices(v("ranked").withColumn("n", F.row_number().over(w).cast("bigint") - 1), "CHR", "n")


@query("SELECT round(quantile_cont(m, 0.5), 6) AS median_cm, count(*) AS chromosomes FROM (SELECT max(MAF * 100) - min(MAF * 100) AS m FROM vars GROUP BY CHR)", "vars")
def median_map_span(v):
    span = v("vars").groupBy("CHR").agg((F.max(F.col("MAF") * 100) - F.min(F.col("MAF") * 100)).alias("m"))
    return rounded(span.agg(F.median("m").alias("median_cm"), F.count("m").alias("chromosomes")))


# --- spectra: blocks of two variants have the eigenvalues 1 - |r| and 1 + |r| -------------------------------------------

_PAIRS = f"WITH {_R} SELECT CAST(i // 2 AS BIGINT) AS block_id"


@query(f"{_PAIRS}, round(1 - abs(r), 6) AS lambda_min, round(1 + abs(r), 6) AS lambda_max FROM rr WHERE i % 2 = 0 AND j = i + 1", "calls variants64")
def eigen_pairs(v):
    w = banded.assign_blocks(lettered(v).withColumnRenamed("variant_idx", "i"), size=2)
    e = spectral.extremal_eigenvalues(ld.estimate(v("calls"), lettered(v), "sample", tile=16), w)
    return rounded(e.select("block_id", "lambda_min", "lambda_max"))


@query(f"{_PAIRS}, k AS rank_no, round(CASE WHEN k = 1 THEN 1 + abs(r) ELSE 1 - abs(r) END, 6) AS value FROM rr, (VALUES (1), (2)) t(k) WHERE i % 2 = 0 AND j = i + 1", "calls variants64")
def svd_pairs(v):
    w = banded.assign_blocks(lettered(v).withColumnRenamed("variant_idx", "i"), size=2)
    return rounded(spectral.singular_values(ld.estimate(v("calls"), lettered(v), "sample", tile=16), w, 5))


@query(f"WITH {_R}, b AS (SELECT i // 2 AS b, abs(r) AS r FROM rr WHERE i % 2 = 0 AND j = i + 1) SELECT CAST(variant_idx AS BIGINT) AS i, round(abs(least((1 - b.r) + 0.9 * (1 + b.r) - 1.8, 0)) / 1.9, 6) AS shift FROM variants64 JOIN b ON b.b = variant_idx // 2", "calls variants64")
def lambda_min_of_variants(v):
    w = banded.assign_blocks(lettered(v).withColumnRenamed("variant_idx", "i"), size=2)
    values = spectral.extremal_eigenvalues(ld.estimate(v("calls"), lettered(v), "sample", tile=16), w).withColumn("lambda_min", F.col("lambda_min") - 1.8)
    return rounded(spectral.lambda_min_per_variant(values, w, 0.9).select("i", "shift"))


@query(f"{_PAIRS}, round(1 - abs(r), 6) AS lambda_min, round(1 + abs(r), 6) AS lambda_max, CASE WHEN a.pos BETWEEN 0 AND 12000 OR b.pos BETWEEN 0 AND 12000 THEN (CASE WHEN b.pos > 12000 THEN 1.0 END) ELSE round(1 - abs(r), 6) END AS lambda_min_outside FROM rr JOIN variants64 a ON a.variant_idx = i JOIN variants64 b ON b.variant_idx = j WHERE i % 2 = 0 AND j = i + 1", "calls variants64")
def window_eigenvalues(v):
    w = lettered(v).withColumnRenamed("variant_idx", "i")
    regions = v.spark.createDataFrame([(1, 0, 12000), (2, 0, 12000)], "chr int, start_pos int, end_pos int")
    e = spectral.window_spectrum(ld.estimate(v("calls"), lettered(v), "sample", tile=16), w, "i", 2 / 1.2, regions)
    return rounded(e.select("block_id", "lambda_min", "lambda_max", "lambda_min_outside"))


@query(f"WITH {_R} SELECT round(1 - max(abs(r)), 4) AS lambda_min, round(1 + max(abs(r)), 4) AS lambda_max FROM rr WHERE i % 2 = 0 AND j = i + 1 AND i < 8", "calls variants64")
def eigen_whole(v):
    """A matrix of four blocks of two variants, by steps over its edges."""
    e = storage.cut(ld.estimate(v("calls"), lettered(v), "sample", tile=16).where("i % 2 = 0 AND j = i + 1 AND i < 8"), "edges")
    low, high = spectral.extremal_of_whole(e, lettered(v).where("variant_idx < 8").select(F.col("variant_idx").alias("i")), 8)
    return v.spark.createDataFrame([(round(low, 4), round(high, 4))], "lambda_min double, lambda_max double")


@query("SELECT SNP, round(BETA / 10, 6) AS whole, round(0.8 * N, 6) AS train_n FROM sumstats_v JOIN (SELECT idx, i FROM ranked WHERE CHR = 3) USING (idx) WHERE N > 2", "sumstats_v ranked")
def correlated_split(v):
    """A split with correlated noise: both parts give the effect again."""
    w = v("sumstats_v").where("N > 2").join(v("ranked").where("CHR = 3").select("idx", F.col("i").cast("bigint").alias("i")), "idx")
    blocks = banded.assign_blocks(v("ranked").where("CHR = 3").select(F.col("i").cast("bigint").alias("i")), size=20)
    e = v("edges").where("chr = 3").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), (F.col("r") / 20).alias("r"))
    out = spectral.train_test_correlated(w.withColumn("STD_BETA", F.col("BETA") / 10), e, blocks, 0.8, 3)
    return rounded(out.select("SNP", (0.8 * F.col("train_beta") + 0.2 * F.col("test_beta")).alias("whole"), "train_n"))


# --- commands ----------------------------------------------------------------------------------------------------------


@query(_greedy_sql("abs(round_even(r * 32767, 0) / 32767.0) >= sqrt(CAST(0.49 AS DOUBLE))", "i").replace("SELECT chr, i FROM walk WHERE took", "SELECT SNP FROM walk JOIN (SELECT CHR AS chr, i, SNP FROM ranked) USING (chr, i) WHERE took"), "edges ranked")
def command_prune(v):
    out = v.path("kept")
    cli.main(["prune", "--ld", _store(v), "--r2", "0.49", "--out", out])
    return tables.read_snp_list(v.spark, out)


@query(f"SELECT a.CHR AS chr, a.SNP AS SNP_A, b.SNP AS SNP_B, {_BACK} FROM edges e JOIN ranked a ON a.CHR = e.chr AND a.i = e.i JOIN ranked b ON b.CHR = e.chr AND b.i = e.j WHERE a.CHR IN (2, 5) AND a.POS BETWEEN 1000 AND 40000 AND b.POS BETWEEN 1000 AND 40000", "edges ranked")
def command_extract(v):
    out = v.path("part")
    cli.main(["extract", "--ld", _store(v), "--region", "chr2:1,000-40,000", "--region", "5:1000-40000", "--out", out])
    return rounded(v.spark.read.csv(out, sep="\t", header=True, schema="chr int, SNP_A string, SNP_B string, r double"))


@query(f"SELECT SNP FROM ranked WHERE idx % 40 = 0 UNION SELECT b.SNP FROM (SELECT chr, i, j, {_BACK} FROM edges UNION ALL SELECT chr, j, i, {_BACK} FROM edges) e JOIN ranked a ON a.CHR = e.chr AND a.i = e.i JOIN ranked b ON b.CHR = e.chr AND b.i = e.j WHERE a.idx % 40 = 0 AND e.r * e.r > 0.5", "edges ranked")
def command_expand(v):
    listed, out = v.path("list"), v.path("wide")
    tables.write_table(v("ranked").where("idx % 40 = 0").select("SNP"), listed, header=False)
    cli.main(["expand", "--ld", _store(v), "--r2", "0.5", "--snps", listed, "--out", out])
    return tables.read_snp_list(v.spark, out)


@query(f"WITH {_FREQ} SELECT snp AS SNP, CAST(N AS DOUBLE) AS N, round(MAF, 6) AS MAF FROM freq JOIN variants64 USING (variant_idx)", "calls variants64")
def command_gwas(v):
    """Association by the command, over the panel's files, written as plink2 and read again (the phenotype is complete)."""
    base, out = _panel(v), v.path("gwas")
    y = v.lines(v("samples").select(F.concat(F.lit("F"), (F.col("sample_idx") % 7).cast("string")), F.concat(F.lit("I"), "sample_idx"), "phenotype"))
    cli.main(["gwas", "--bed", base, "--pheno", y, "--out", out, "--format", "plink2"])
    return rounded(sumstats.read_sumstats(v.spark, out, "plink2").select("SNP", "N", "MAF"))


@query("SELECT SNP FROM vars", "vars")
def glob_scan(v):
    """Several files by one pattern."""
    base = v.path("parts")
    for k in range(2):
        tables.write_table(v("vars").where(f"idx % 2 = {k}").select("SNP"), f"{base}/part_{k}", header=False)
    return tables.read_snp_list(v.spark, base + "/part_*")


@query("SELECT round(count(*) * (SELECT count(*) FROM samples) / 1048576.0, 6) AS mb, 7 AS first, 23 AS last FROM variants64", "samples variants64")
def matrix_size(v):
    """Megabytes of the dense matrix; and chromosome keys without their prefixes."""
    mb = round(genotype.memory_mb(v("samples").count(), v("variants64").count(), 1), 6)
    k = v.spark.createDataFrame([("chr_7", "CHR:23")], "a string, b string").select(merge.chromosome_key(F.col("a")).cast("int").alias("first"), merge.chromosome_key(F.col("b")).cast("int").alias("last"))
    return k.select(F.lit(mb).alias("mb"), "first", "last")


@query("SELECT SNP, CAST(5000 AS DOUBLE) AS N FROM vars WHERE idx % 10 <> 0", "vars")
def study_sample_size(v):
    """A file without sample sizes gets one for all rows."""
    path = v.path("stats")
    sumstats.write_sumstats(v("vars").where("idx % 10 <> 0").select("SNP", "A1", "A2", "BETA", "SE").coalesce(1), path)
    return Study().with_stats(v.spark, path, n=5000).stats.select("SNP", "N")


# --- loader -----------------------------------------------------------------------------------------------------------


def _sources(v: Views) -> Study:
    """Variants, statistics (some without BETA) and annotations of the views."""
    stats = v("sumstats_v").where("N > 2").withColumn("Z", F.col("BETA") / F.col("SE")).withColumn("BETA", F.when(F.col("idx") % 4 != 0, F.col("BETA"))).withColumn("N", F.col("N").cast("double"))
    return Study(variants=v("refpanel").withColumnRenamed("idx", "variant_idx"), stats=stats, annotations=v("annot"))


@query("SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM refpanel) AS variants, count(*) AS stats, CAST(max(N) AS DOUBLE) AS max_n FROM sumstats_v WHERE N > 2", "sumstats_v refpanel samples")
def study_sizes(v):
    s = _sources(v)
    return Study(s.variants, samples=v("samples"), stats=s.stats).sizes()


@query("SELECT CHR, count(*) AS variants FROM refpanel GROUP BY CHR", "refpanel")
def study_shapes(v):
    return _sources(v).shapes()


@query(f"WITH {_FREQ} SELECT CAST(N AS BIGINT) AS N, snp AS SNP, round(MAF, 6) AS MAF, round(2 * MAF * N, 4) AS MAC, round(2 * MAF * (1 - MAF), 6) AS MAF_VAR, pos AS POS FROM freq JOIN variants64 USING (variant_idx)", "calls variants64")
def study_snp_table(v):
    s = Study(variants=lettered(v).withColumnsRenamed({"snp": "SNP", "pos": "POS", "chr": "CHR"}), calls=v("calls"))
    return rounded(s.snp_table(("N", "SNP", "MAF", "MAC", "MAF_VAR", "POS")).withColumn("MAC", F.round("MAC", 4)))


@query("SELECT concat('F', sample_idx % 7) AS FID, concat('I', sample_idx) AS IID, '0' AS fatherID, '0' AS motherID, nullif(CAST(covar_1 AS FLOAT), 0) AS sex, round(CASE WHEN sample_idx % 10 <> 0 THEN phenotype END, 4) AS phenotype FROM samples", "samples")
def study_individuals(v):
    return _study(v).individual_table().withColumn("phenotype", F.round(F.col("phenotype").cast("double"), 4))


@query("SELECT SNP, POS, round(BETA / SE * BETA / SE, 6) AS CHISQ FROM sumstats_v WHERE N > 2", "sumstats_v")
def study_stats_table(v):
    return rounded(_sources(v).stats_table(("SNP", "POS", "CHISQ")))


@query("SELECT 'big' AS name UNION ALL SELECT 'quarter'", "annot")
def study_binary_annotations(v):
    return v.spark.createDataFrame([(n,) for n in _sources(v).binary_annotations()], "name string")


@query(f"WITH b AS (SELECT variant_idx, CASE WHEN variant_idx % 4 <> 0 THEN variant_idx / 64.0 - 0.4 ELSE 3 / sqrt(CAST(100 - 1 + 9 AS DOUBLE)) END AS b FROM variants64) SELECT CAST(sample_idx AS BIGINT) AS sample_idx, round(sum(coalesce(dosage, 0) * b), 6) AS score FROM calls JOIN b USING (variant_idx) GROUP BY sample_idx", "calls variants64")
def study_score(v):
    """Scores where some effects are missing: the standardised effect stands in for them."""
    w = lettered(v).withColumnsRenamed({"snp": "SNP", "pos": "POS", "chr": "CHR"})
    stats = w.select("SNP", F.when(F.col("variant_idx") % 4 != 0, F.col("variant_idx") / 64.0 - 0.4).alias("BETA"), F.lit(3.0).alias("Z"), F.lit(100.0).alias("N"))
    return rounded(Study(w, v("calls"), v("samples"), stats).score().withColumn("sample_idx", F.col("sample_idx").cast("bigint")))


@query("SELECT v.CHR, count(*) AS n FROM vars v GROUP BY v.CHR", "vars")
def study_split(v):
    parts = Study(variants=v("vars").withColumnRenamed("idx", "variant_idx")).split()
    out = None
    for c, s in parts.items():  # at most as many as there are chromosomes
        own = s.variants.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).cast("int").alias("CHR"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT SNP, CHR, big FROM annot", "annot")
def keep_annotations(v):
    path = v.path("annotations")
    tables.write_table(v("annot").select("CHR", "SNP", "POS", "big", "quarter").coalesce(1), path)
    return Study().with_annotations(v.spark, path, keep=["big"]).annotations.select("SNP", "CHR", F.col("big").cast("int").alias("big"))


@query("SELECT chr, variant_idx, n AS sample_size FROM (SELECT CHR AS chr, i AS variant_idx, CAST(1000 AS DOUBLE) AS n FROM ranked)", "ranked edges")
def study_with_ld(v):
    s = Study().with_ld(v.spark, _store(v))
    return s.variants.select(F.col("CHR").alias("chr"), "variant_idx", F.lit(1000.0).alias("sample_size"))


# --- selection by lists, association, phenotypes --------------------------------------------------------------------------


@query(_greedy_sql("abs(r) >= 0.7", "CASE WHEN idx % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN idx % 5 = 0 THEN -idx ELSE MAF END, i"), "edges ranked")
def ld_prune_listed(v):
    """A list first, in its order, then the others by their p-values."""
    r = by_chr(v("ranked"))
    listed = r.where("idx % 5 = 0").select("SNP", (-F.col("idx")).alias("ord"))
    return graph.prune(v("edges"), graph.ordered(r, listed, r.select("SNP", F.col("MAF").alias("PVAL"))), 0.7, by=["chr"], rank="rank")


@query(_greedy_sql("abs(r) >= 0.7", "abs(BETA / SE) DESC, i"), "edges ranked")
def ld_prune_in_rounds(v):
    """As ld_prune_ranked, every piece of the genome counted as too large for one task."""
    return graph.prune(v("edges"), by_chr(v("ranked")).withColumn("rank", -F.abs(F.col("BETA") / F.col("SE"))), 0.7, by=["chr"], rank="rank", piece_rows=0)


@query("SELECT CAST(variant_idx AS BIGINT) AS variant_idx, CAST(count(*) AS BIGINT) AS N, true AS solved FROM calls JOIN samples USING (sample_idx) WHERE dosage IS NOT NULL GROUP BY variant_idx", "calls samples")
def gwas_logistic_solved(v):
    """The likelihood's derivatives are zero at the estimates, which the six counts of a variant tell."""
    found = association.logistic(v("calls"), v("samples"))
    rows = v("calls").where("dosage IS NOT NULL").join(v("samples"), "sample_idx").groupBy("variant_idx", F.col("dosage").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("status").alias("y"))
    # the intercept follows from the slope: by bisection over a grid it is found where the first derivative vanishes
    lists = rows.groupBy("variant_idx").agg(F.collect_list(F.struct("g", "n", "y")).alias("c")).join(found, "variant_idx")

    def check(batches):
        for b in batches:
            ok = []
            for c, beta in zip(b.c, b.BETA):
                g, n, y = (np.array([x[k] for x in c], float) for k in ("g", "n", "y"))
                low, high = -50.0, 50.0
                for _ in range(200):
                    mid = (low + high) / 2
                    e = (y - n / (1 + np.exp(-(mid + beta * g)))).sum()
                    low, high = (mid, high) if e > 0 else (low, mid)
                ok.append(bool(abs(((y - n / (1 + np.exp(-(low + beta * g)))) * g).sum()) < 1e-5))
            yield b[["variant_idx", "N"]].assign(solved=ok)

    return lists.mapInPandas(check, "variant_idx bigint, N bigint, solved boolean")


@query("WITH s AS (SELECT sample_idx, phenotype AS y, covar_2 AS c FROM samples), z AS (SELECT sample_idx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, c FROM s), f AS (SELECT regr_slope(y, c) AS b, regr_intercept(y, c) AS a FROM z), r AS (SELECT sample_idx, y - a - b * c AS y FROM z, f), m AS (SELECT avg(y) AS m, stddev_pop(y) AS d FROM r) SELECT sample_idx, round(y, 6) AS phenotype FROM r, m WHERE abs(y - m) <= 3 * d", "samples")
def phenotype_chain(v):
    return rounded(phenotype.transform(v("samples"), ["covar_2"], ("standardize", "covariates", "outliers")).select("sample_idx", "phenotype"))


@query("SELECT sample_idx, CAST(status AS INTEGER) AS status, 'binomial' AS kind FROM samples", "samples")
def phenotype_coding(v):
    own, kind = phenotype.check_coding(v("samples").select("sample_idx", (F.col("status") + 1).alias("phenotype")))
    return own.select("sample_idx", F.col("phenotype").cast("int").alias("status"), F.lit(kind).alias("kind"))


# --- simulation: what must hold of random results ---------------------------------------------------------------------


@query("SELECT count(*) AS variants, 0.5 AS h2, true AS share, true AS moments, true AS zeros FROM vars", "vars")
def simulate_effects(v):
    """Shares add up to the heritability, the causal share and the effects' moments are as asked within five standard errors."""
    w = simulate.effects(simulate.heritability(simulate.mixture(v("vars"), [0.7, 0.2, 0.1], 11, "idx"), 0.5, [0.0, 1.0, 3.0]), 12, "idx")
    z = F.col("BETA") / F.sqrt("h2")
    n = F.count(F.lit(1))
    c = F.count(F.when(F.col("causal"), 1))
    return w.agg(
        n.alias("variants"), F.round(F.sum("h2"), 9).alias("h2"), (F.abs(c / n - 0.3) < 5 * F.sqrt(0.21 / n)).alias("share"),
        ((F.abs(F.avg(F.when(F.col("causal"), z))) < 5 / F.sqrt(c)) & (F.abs(F.var_samp(F.when(F.col("causal"), z)) - 1) < 5 * F.sqrt(2 / c))).alias("moments"),
        (F.count(F.when(~F.col("causal") & (F.col("BETA") != 0), 1)) == 0).alias("zeros"),
    )


@query("SELECT count(*) AS samples, 1 AS genetic, 2 AS classes, true AS near FROM samples", "samples")
def simulate_traits(v):
    """Without noise the trait is the standardised score; with a prevalence, that share of samples is affected."""
    w = simulate.set_effects(v("variants64").withColumn("h2", F.lit(1 / 64)), v("variants64").where("variant_idx % 3 = 0").select("snp", F.lit(0.1).alias("BETA")), "snp")
    pure = simulate.phenotype(v("calls"), w, 1.0, 5).join(Study(w.withColumn("SNP", F.col("snp")), v("calls"), v("samples"), w.select(F.col("snp").alias("SNP"), "BETA")).score("standardize"), "sample_idx")
    ill = simulate.phenotype(v("calls"), w, 0.4, 5, 0.25).agg(F.avg("phenotype").alias("p"), F.count_distinct("phenotype").cast("int").alias("classes"))
    return pure.agg(F.count(F.lit(1)).alias("samples"), F.round(F.corr("phenotype", "score"), 6).cast("int").alias("genetic")).join(F.broadcast(ill)).select("samples", "genetic", "classes", (F.abs(F.col("p") - 0.25) < 0.08).alias("near"))


@query("SELECT true AS first_is_truth, true AS own_outside, true AS shared_part, true AS own_part FROM vars LIMIT 1", "vars")
def simulate_cohorts(v):
    """Half of the causal variants are common to all cohorts; the others have about as many of their own, outside the first's."""
    w = v("vars").withColumn("causal", F.col("idx") % 5 == 0).withColumn("h2", F.when(F.col("idx") % 5 == 0, 0.01).otherwise(0.0))
    c = simulate.cohort_effects(w, np.array([[1.0, 0.6], [0.6, 1.0]]), 3, 0.5, "idx")
    n = F.count(F.when(F.col("causal"), 1))
    both, own = F.count(F.when(F.col("causal") & F.col("causal_1"), 1)), F.count(F.when(~F.col("causal") & F.col("causal_1"), 1))
    return c.agg(
        (F.count(F.when((F.col("BETA_0") != 0) != F.col("causal"), 1)) == 0).alias("first_is_truth"),
        (F.count(F.when((F.col("BETA_1") != 0) & ~F.col("causal_1"), 1)) == 0).alias("own_outside"),
        (F.abs(both / n - 0.5) < 5 * F.sqrt(0.25 / n)).alias("shared_part"), (F.abs(own / n - 0.5) < 5 * F.sqrt(0.5 / n)).alias("own_part"),
    )


@query("SELECT SNP, round(greatest(big * 0.3 + quarter * -0.5, 0), 6) AS h2, round(1 / (1 + exp(-(ln(CAST(0.1 AS DOUBLE)) + big * ln(CAST(2 AS DOUBLE))))), 6) AS pi FROM annot", "annot")
def annotated_architecture(v):
    a = simulate.annotated_pi(simulate.annotated_heritability(v("annot"), {"big": 0.3, "quarter": -0.5}), 0.1, {"big": 2.0})
    return rounded(a.select("SNP", "h2", "pi"))


@query("SELECT SNP, CASE WHEN idx % 7 = 0 THEN 1 ELSE 0 END AS component FROM vars", "vars")
def chosen_causal(v):
    return simulate.set_causal(v("vars"), v("vars").where("idx % 7 = 0")).select("SNP", "component")


@query("SELECT SNP, round(BETA / 10, 6) AS whole, round(CAST(0.8 AS DOUBLE) * N, 6) AS train_n, round((1 - CAST(0.8 AS DOUBLE)) * N, 6) AS test_n, true AS spread FROM sumstats_v WHERE N > 2", "sumstats_v")
def pumas_split(v):
    """Both parts, weighted by their shares, give the effect again, and the training part's noise has its variance."""
    s = v("sumstats_v").where("N > 2").withColumn("STD_BETA", F.col("BETA") / 10)
    out = simulate.train_test(s, 0.8, 1, "idx")
    z = (F.col("train_beta") - F.col("STD_BETA")) / F.sqrt(1 / (0.8 * F.col("N")) - 1 / F.col("N"))
    spread = out.agg(F.var_samp(z).alias("v"), F.count(F.lit(1)).alias("n")).select((F.abs(F.col("v") - 1) < 6 * F.sqrt(2 / F.col("n"))).alias("spread"))
    whole = 0.8 * F.col("train_beta") + 0.2 * F.col("test_beta")
    return rounded(out.join(F.broadcast(spread)).select("SNP", whole.alias("whole"), "train_n", "test_n", "spread"))


@query("SELECT count(*) AS samples, true AS shares FROM samples", "samples")
def split_of_samples(v):
    g = simulate.split_samples(v("samples"), [0.5, 0.3, 0.2], 9)
    n = F.count(F.lit(1))
    near = [F.abs(F.count(F.when(F.col("group_no") == k, 1)) / n - p) < 5 * F.sqrt(p * (1 - p) / n) for k, p in enumerate((0.5, 0.3, 0.2))]
    return g.agg(n.alias("samples"), (near[0] & near[1] & near[2]).alias("shares"))


@query("SELECT * FROM (VALUES ('a', 'a', 1.0), ('a', 'b', 0.5), ('b', 'a', 0.5), ('b', 'b', 0.75), ('a', 'c', 0.0), ('c', 'a', 0.0), ('b', 'c', 0.0), ('c', 'b', 0.0), ('c', 'c', 0.5)) t(a, b, rho) WHERE rho > 0 AND (SELECT count(*) FROM samples) > 0", "samples")
def tree_correlation(v):
    nodes = [("root", None, 0.0), ("ab", "root", 2.0), ("a", "ab", 2.0), ("b", "ab", 1.0), ("c", "root", 2.0)]
    return simulate.tree_correlation(v.spark.createDataFrame(nodes, "node string, parent string, length double")).where("rho > 0")

