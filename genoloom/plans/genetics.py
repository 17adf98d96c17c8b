"""Queries of the genetic operators over projections of the test tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import stats as S
from genoloom.functions.sumstats import derive
from genoloom.operators import association, banded, genotype, graph, intervals, ld, merge, phenotype, plotdata, scoring, simulate, spectral
from genoloom.plans.checks import with_erfc
from genoloom.plans.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function's name; views names those that the SQL needs."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = duck(sql, *views.split())
        return f

    return add


def digits_of(x: Column, digits: int) -> Column:
    """x rounded as the SQL's round does it: x times a power of ten goes to the next whole number. F.round goes by the
    decimal text of x, whose ties are others: 0.5046875 is one, but in doubles 0.5046875 * 1e6 is less than 504687.5."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[digits_of(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_log(df: DataFrame) -> DataFrame:
    """Association results with -log10 of the p-value, which shows what rounding hides."""
    logs = df.withColumn("NLOG10_PVAL", S.nlog10_pvalue("Z"))
    return rounded(logs.withColumn("NLOG10_PVAL", digits_of(F.col("NLOG10_PVAL"), 4)))


def lettered(v: Callable[[str], DataFrame]) -> DataFrame:
    """The panel of 64 variants with integer keys."""
    return v("variants64").withColumn("variant_idx", F.col("variant_idx").cast("bigint"))


def by_chr(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"CHR": "chr"})


# --- frequencies, filters, association ---------------------------------------------------------------------------

_FREQ = "freq AS (SELECT variant_idx, count(dosage) AS N, sum(dosage) / (2.0 * count(dosage)) AS MAF FROM calls GROUP BY variant_idx)"


@query(f"WITH {_FREQ} SELECT variant_idx, N, round(MAF, 6) AS MAF, round(2 * MAF * (1 - MAF), 6) AS MAF_VAR FROM freq", "calls")
def allele_frequency(v):
    return rounded(genotype.allele_frequency(v("calls")))


@query(f"WITH {_FREQ} SELECT variant_idx, N, round(MAF, 6) AS MAF FROM freq WHERE floor(2 * MAF * N) >= 10 AND 2 * N - floor(2 * MAF * N) >= 10 AND MAF >= 0.499 AND 1 - MAF >= 0.499", "calls")
def maf_filter(v):
    return rounded(genotype.frequent(genotype.allele_frequency(v("calls")), 0.499, 10).select("variant_idx", "N", "MAF"))


def _gwas_sql(xy: str, xx: str) -> str:
    return f"""WITH y AS (SELECT sample_idx, phenotype AS y FROM samples WHERE phenotype IS NOT NULL),
tot AS (SELECT avg(y) AS my FROM y), yc AS (SELECT sample_idx, y - my AS yc FROM y, tot), syy AS (SELECT sum(yc * yc) AS yy FROM yc),
s AS (SELECT variant_idx, count(dosage) AS n, CAST(sum(dosage) AS DOUBLE) AS sx, CAST(sum(dosage * dosage) AS DOUBLE) AS sxx, sum(dosage * yc) AS sxy, sum(yc) AS sy FROM calls JOIN yc USING (sample_idx) WHERE dosage IS NOT NULL GROUP BY variant_idx),
c AS (SELECT *, sxx - sx * sx / n AS cc, sxy - sx / n * sy AS d FROM s),
x AS (SELECT variant_idx, n, sx / (2 * n) AS maf, {xy} AS xy, {xx} AS xx FROM c),
b AS (SELECT *, xy / xx AS beta FROM x), e AS (SELECT *, sqrt(greatest(yy - beta * xy, 0) / (n - 2) / xx) AS se FROM b, syy), z AS (SELECT *, beta / se AS z FROM e), {with_erfc("w", "z", "z")}
SELECT variant_idx, n AS N, round(maf, 6) AS MAF, round(beta, 6) AS BETA, round(se, 6) AS SE, round(z, 6) AS Z, round(PV, 6) AS PVAL, round(NL, 4) AS NLOG10_PVAL FROM w"""


@query(_gwas_sql("d", "cc"), "calls samples")
def gwas_linear(v):
    return with_log(association.linear(v("calls"), v("samples")))


@query(_gwas_sql("d * sqrt(n / cc)", "CAST(n AS DOUBLE)"), "calls samples")
def gwas_standardized(v):
    return with_log(association.linear(v("calls"), v("samples"), standardize=True))


@query()
def gwas_logistic(v):
    return rounded(association.logistic(v("calls"), v("samples")))


@query("SELECT round(quantile_cont((BETA / SE) * (BETA / SE), 0.5) / 0.454936423119572, 6) AS lambda_gc FROM vars", "vars")
def inflation_factor(v):
    return rounded(association.inflation(derive(v("vars"), ["CHISQ"])))


@query(
    f"""WITH b AS (SELECT *, BETA / SE AS Z FROM sumstats_v WHERE N > 2), {with_erfc("a", "b", "Z")}
SELECT SNP, round(Z, 6) AS Z, round(PV, 6) AS PVAL, round(NL, 4) AS NLOG10_PVAL, round(Z * Z, 6) AS CHISQ, round(2 * MAF * (1 - MAF), 6) AS MAF_VAR, round(Z / sqrt(N - 1 + Z * Z), 6) AS STD_BETA,
  round((N - 2) * SE * SE + BETA * BETA, 6) AS YY, CAST(sign(BETA) AS DOUBLE) AS SIGN FROM a""",
    "sumstats_v",
)
def sumstats_derive(v):
    d = derive(v("sumstats_v").where("N > 2"), ["SNP", "Z", "PVAL", "NLOG10_PVAL", "CHISQ", "MAF_VAR", "STD_BETA", "YY", "SIGN"])
    return rounded(d.withColumn("NLOG10_PVAL", digits_of(F.col("NLOG10_PVAL"), 4)))


@query("SELECT POS FROM vars GROUP BY POS HAVING count(*) = 1", "vars")
def drop_duplicates(v):
    return genotype.drop_repeated(v("vars").select("POS"), ["POS"])


@query("SELECT SNP FROM vars WHERE CAST(idx AS VARCHAR) IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)", "vars")
def filter_by_ids(v):
    return genotype.keep_ids(v("vars"), v("intervals").select("id"), "idx").select("SNP")


@query("SELECT SNP, CHR FROM vars WHERE idx NOT IN (SELECT s_suppkey FROM supplier)", "vars")
def exclude_ids(v):
    return genotype.drop_ids(v("vars"), v("intervals").select("id"), "idx").select("SNP", "CHR")


# The same over a panel that grows with the tables: one call of ten to a hundred thousand samples in a few variants each.


@query(f"WITH {_FREQ.replace('calls', 'calls_big')} SELECT variant_idx, N, round(MAF, 6) AS MAF, round(2 * MAF * (1 - MAF), 6) AS MAF_VAR FROM freq", "calls_big")
def big_allele_frequency(v):
    return rounded(genotype.allele_frequency(v("calls_big")))


@query(_gwas_sql("d", "cc").replace("calls", "calls_big").replace("FROM samples", "FROM samples_big"), "calls_big samples_big")
def big_gwas_linear(v):
    return with_log(association.linear(v("calls_big"), v("samples_big")))


@query("""WITH g AS (SELECT sample_idx, variant_idx, dosage - avg(dosage) OVER (PARTITION BY variant_idx) AS x FROM calls_big),
ss AS (SELECT variant_idx, sum(x * x) AS s FROM g GROUP BY variant_idx),
xy AS (SELECT a.variant_idx AS i, b.variant_idx AS j, sum(a.x * b.x) AS p FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND b.variant_idx > a.variant_idx AND b.variant_idx < a.variant_idx + 20 GROUP BY 1, 2)
SELECT u.chr, CAST(u.variant_idx AS BIGINT) AS i, CAST(w.variant_idx AS BIGINT) AS j, round(coalesce(p / sqrt(a.s * b.s), 0), 6) AS r FROM variants_big u JOIN variants_big w ON w.chr = u.chr AND w.variant_idx > u.variant_idx AND w.variant_idx < u.variant_idx + 20
JOIN ss a ON a.variant_idx = u.variant_idx JOIN ss b ON b.variant_idx = w.variant_idx LEFT JOIN xy ON xy.i = u.variant_idx AND xy.j = w.variant_idx""", "calls_big variants_big")
def big_ld_windowed(v):
    return rounded(ld.estimate(v("calls_big"), v("variants_big"), "windowed", size=20))


# --- joins -----------------------------------------------------------------------------------------------------------

_MERGE = """m AS (
  SELECT r.SNP, r.A1, r.A2, s.BETA, s.SE, s.MAF, s.A1 AS b1, s.A2 AS b2 FROM refpanel r JOIN vars s ON r.SNP = s.SNP),
f AS (SELECT *, b1 = A1 AND b2 = A2 AS same, b1 = A2 AND b2 = A1 AND NOT (b1 = A1 AND b2 = A2) AS flip FROM m)"""


@query(f"WITH {_MERGE} SELECT SNP, A1, A2, round(CASE WHEN flip THEN -BETA ELSE BETA END, 6) AS BETA, round(SE, 6) AS SE, round(CASE WHEN flip THEN 1 - MAF ELSE MAF END, 6) AS MAF FROM f WHERE same OR flip", "vars refpanel")
def allele_merge(v):
    return rounded(merge.merge_alleles(v("refpanel"), v("vars").select("SNP", "A1", "A2", "BETA", "SE", "MAF")))


@query("SELECT r.SNP, r.A1, r.A2, round(CASE WHEN s.SNP IS NULL THEN NULL WHEN s.A1 = r.A2 AND s.A2 = r.A1 AND r.A1 <> r.A2 THEN -s.BETA ELSE s.BETA END, 6) AS BETA FROM vars r LEFT JOIN (SELECT SNP, A1, A2, MAF AS BETA FROM refpanel) s ON r.SNP = s.SNP", "vars refpanel")
def allele_merge_left(v):
    alt = v("refpanel").select("SNP", "A1", "A2", F.col("MAF").alias("BETA"))
    return rounded(merge.merge_alleles(v("vars"), alt, how="left"))


@query("SELECT s.SNP, s.A1, CASE WHEN s.A1 = r.A1 THEN r.A2 ELSE r.A1 END AS A2 FROM vars s LEFT JOIN refpanel r ON r.SNP = s.SNP", "vars refpanel")
def infer_a2(v):
    return merge.infer_a2(v("vars").select("SNP", "A1"), v("refpanel"), allow_na=True).select("SNP", "A1", "A2")


@query("WITH r AS (SELECT CHR, POS, min(SNP) AS SNP FROM refpanel GROUP BY CHR, POS) SELECT s.idx, r.SNP FROM vars s LEFT JOIN r ON r.CHR = s.CHR AND r.POS = s.POS", "vars refpanel")
def infer_snp_id(v):
    return merge.infer_snp(v("vars").select("idx", "CHR", "POS"), v("refpanel"), allow_na=True).select("idx", "SNP")


@query(f"WITH {_MERGE} SELECT f.SNP, v.CHR, f.A1, f.A2, round(CASE WHEN flip THEN -f.BETA ELSE f.BETA END, 6) AS BETA, round(CASE WHEN flip THEN 1 - f.MAF ELSE f.MAF END, 6) AS MAF FROM f JOIN refpanel v ON v.SNP = f.SNP WHERE (same OR flip) AND f.SNP IN (SELECT SNP FROM annot)", "vars refpanel annot")
def harmonize(v):
    stats = v("vars").select("CHR", "SNP", "A1", "A2", "BETA", "MAF")
    return rounded(merge.harmonize(v("refpanel").select("CHR", "SNP", "A1", "A2"), stats, v("annot"))[1].select("SNP", "CHR", "A1", "A2", "BETA", "MAF"))


@query("SELECT SNP FROM vars WHERE SNP IN (SELECT SNP FROM refpanel) AND SNP IN (SELECT SNP FROM annot WHERE big = 1)", "vars refpanel annot")
def align_sources(v):
    return merge.align([v("vars").select("SNP"), v("refpanel"), v("annot").where("big = 1")], ["SNP"])[0]


@query("SELECT v.SNP, v.BETA, r.CHR FROM vars v JOIN (SELECT SNP, min(CHR) AS CHR FROM refpanel GROUP BY SNP) r USING (SNP)", "vars refpanel")
def split_by_chromosome(v):
    return merge.split_by_chromosome(v("vars").select("SNP", "BETA"), v("refpanel"))


@query("SELECT v.SNP, v.POS, CAST(EXISTS (SELECT 1 FROM intervals i WHERE i.chr = v.CHR AND v.POS BETWEEN i.start_pos AND i.end_pos) AS INTEGER) AS inside FROM vars v", "vars intervals")
def interval_overlap(v):
    return intervals.annotate(v("vars").select("SNP", "CHR", "POS"), v("intervals"), "inside", ["SNP"]).select("SNP", "POS", "inside")


@query("SELECT SNP FROM vars v WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE i.chr = v.CHR AND v.POS BETWEEN i.start_pos AND i.end_pos)", "vars intervals")
def lrld_exclude(v):
    return intervals.outside(v("vars"), v("intervals"), ["SNP"]).select("SNP")


@query("SELECT v.SNP, b.block_start, b.block_end FROM vars v ASOF LEFT JOIN (SELECT * FROM blocks WHERE block_start % 20000 = 10000) b ON v.CHR = b.chr AND v.POS >= b.block_start", "vars blocks")
def asof_blocks(v):
    return intervals.as_of_blocks(v("vars").select("SNP", "CHR", "POS"), v("blocks").where("block_start % 20000 = 10000"), bin_width=5000).select("SNP", "block_start", "block_end")


@query("SELECT v.SNP, b.block_start, b.block_end FROM vars v ASOF LEFT JOIN blocks b ON v.CHR = b.chr AND v.POS >= b.block_start", "vars blocks")
def asof_all_blocks(v):
    return intervals.as_of_blocks(v("vars").select("SNP", "CHR", "POS"), v("blocks"), bin_width=5000).select("SNP", "block_start", "block_end")


@query("SELECT v.SNP, b.block_start FROM vars v JOIN blocks b ON v.CHR = b.chr AND v.POS >= b.block_start AND v.POS < b.block_end", "vars blocks")
def genomic_blocks(v):
    return intervals.as_of_blocks(v("vars").select("SNP", "CHR", "POS"), v("blocks"), matched_only=True).select("SNP", "block_start")


@query("""WITH n AS (SELECT chr, block_start, block_end, greatest(ceil((block_end - block_start) / 4000.0), 1) AS n FROM blocks),
k AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM n)
SELECT chr, CAST(block_start + floor((block_end - block_start) * k / n) AS INTEGER) AS block_start, CAST(block_start + floor((block_end - block_start) * (k + 1) / n) AS INTEGER) AS block_end FROM k""", "blocks")
def split_blocks(v):
    return intervals.split_blocks(v("blocks"), 4000)


@query("""WITH f AS (SELECT SNP, CHR, POS, POS - min(POS) OVER (PARTITION BY CHR) AS off, max(POS) OVER (PARTITION BY CHR) - min(POS) OVER (PARTITION BY CHR) AS span FROM vars)
SELECT SNP, CAST(least(floor(off / 25000), greatest(ceil((span - 25000) / 25000.0), 1) - 1) AS BIGINT) AS window_no FROM f""", "vars")
def tumbling_windows(v):
    return genotype.tumbling(v("vars"), "POS", 25000, by=["CHR"]).select("SNP", F.col("window_no").cast("bigint").alias("window_no"))


# --- correlation ------------------------------------------------------------------------------------------------------

_R = """g AS (SELECT sample_idx, variant_idx, dosage - avg(dosage) OVER (PARTITION BY variant_idx) AS x FROM calls WHERE dosage IS NOT NULL),
ss AS (SELECT variant_idx, sum(x * x) AS s FROM g GROUP BY variant_idx),
xy AS (SELECT a.variant_idx AS i, b.variant_idx AS j, sum(a.x * b.x) AS p FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND a.variant_idx < b.variant_idx GROUP BY 1, 2),
rr AS (SELECT i, j, p / sqrt(a.s * b.s) AS r FROM xy JOIN ss a ON a.variant_idx = i JOIN ss b ON b.variant_idx = j)"""
_LD = "SELECT CAST(a.chr AS INTEGER) AS chr, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(r, 6) AS r FROM rr JOIN variants64 a ON a.variant_idx = i JOIN variants64 b ON b.variant_idx = j WHERE a.chr = b.chr"


@query(f"WITH {_R} {_LD}", "calls variants64")
def ld_sample(v):
    return rounded(ld.estimate(v("calls"), lettered(v), "sample", tile=16))


@query(f"WITH {_R} {_LD} AND j - i < 8 AND b.pos - a.pos <= 5000 AND b.cm - a.cm <= 0.45", "calls variants64")
def ld_windowed(v):
    return rounded(ld.estimate(v("calls"), lettered(v), "windowed", size=8, kb=5, cm=0.45, tile=16))


@query(f"WITH {_R} {_LD} AND a.pos // 7000 = b.pos // 7000", "calls variants64")
def ld_block(v):
    variants = lettered(v).withColumn("block_start", F.floor(F.col("pos") / 7000))
    return rounded(ld.estimate(v("calls"), variants, "block", tile=16))


@query("""WITH g AS (SELECT sample_idx, variant_idx, dosage - avg(dosage) OVER (PARTITION BY variant_idx) AS x FROM calls WHERE dosage IS NOT NULL),
ss AS (SELECT variant_idx, avg(x * x) AS s FROM g GROUP BY variant_idx),
xy AS (SELECT a.variant_idx AS i, b.variant_idx AS j, sum(a.x * b.x) / count(*) AS p FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND b.variant_idx = (a.variant_idx * 7 + 3) % 64 AND a.variant_idx <> b.variant_idx GROUP BY 1, 2)
SELECT i, j, round(p / sqrt(a.s * b.s), 6) AS r FROM xy JOIN ss a ON a.variant_idx = i JOIN ss b ON b.variant_idx = j""", "calls")
def ld_pairs(v):
    pairs = v("variants64").select(F.col("variant_idx").alias("i"), F.expr("CAST((variant_idx * 7 + 3) % 64 AS INT)").alias("j")).where("i <> j")
    return rounded(ld.pairwise(v("calls"), pairs, impute=False))


def _shrink_sql(ne: float, n: int, cutoff: float) -> str:
    k, h = 0.02 * ne / n, sum(1 / t for t in range(1, 2 * n))
    theta = (1 / h) / (2 * n + 1 / h)
    f, g = (1 - theta) ** 2, 0.5 * theta * (1 - 0.5 * theta)
    import math

    d = -math.log(cutoff) / k
    s = lambda x: f"sqrt({x}.v) / sqrt(CAST({f!r} AS DOUBLE) * {x}.v + CAST({g!r} AS DOUBLE))"
    return f"""WITH {_R}, {_FREQ}, m AS (SELECT variant_idx, chr, cm, MAF * (1 - MAF) AS v FROM freq JOIN variants64 USING (variant_idx))
SELECT CAST(a.chr AS INTEGER) AS chr, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(r * {s("a")} * {s("b")} * CASE WHEN exp(-CAST({k!r} AS DOUBLE) * abs(a.cm - b.cm)) < {cutoff} THEN 0 ELSE exp(-CAST({k!r} AS DOUBLE) * abs(a.cm - b.cm)) END * CAST({f!r} AS DOUBLE), 6) AS r
FROM rr JOIN m a ON a.variant_idx = i JOIN m b ON b.variant_idx = j WHERE a.chr = b.chr AND CAST(round(b.cm * 1000000) AS BIGINT) - CAST(round(a.cm * 1000000) AS BIGINT) <= CAST(round(CAST({d!r} AS DOUBLE) * 1000000) AS BIGINT)"""


@query(_shrink_sql(11400, 183, 0.2), "calls variants64")
def ld_shrinkage(v):
    return rounded(ld.estimate(v("calls"), lettered(v), "shrinkage", ne=11400, n=183, cutoff=0.2, tile=16))


@query("SELECT chr, CAST(variant_idx AS BIGINT) AS variant_idx, CAST(min(variant_idx) OVER w AS BIGINT) AS v_start, CAST(max(variant_idx) OVER w + 1 AS BIGINT) AS v_end FROM variants64 WINDOW w AS (PARTITION BY chr ORDER BY pos RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING)", "variants64")
def ld_bounds(v):
    return ld.position_bounds(lettered(v), "pos", 5000).select("chr", "variant_idx", "v_start", "v_end")


_BOTH = "e2 AS (SELECT chr, i, j, r FROM edges UNION ALL SELECT chr, j, i, r FROM edges)"
_W = "r * r - (1 - r * r) / 498.0"


@query(f"WITH {_BOTH}, s AS (SELECT chr, i, sum({_W}) AS s FROM e2 GROUP BY chr, i) SELECT v.CHR AS chr, v.i, round(1 + coalesce(s.s, 0), 6) AS LDScore FROM ranked v LEFT JOIN s ON s.chr = v.CHR AND s.i = v.i", "edges ranked")
def ld_score(v):
    return rounded(ld.ld_scores(v("edges"), by_chr(v("ranked")), 500, by=["chr"]))


@query(f"""WITH {_BOTH}, a AS (SELECT CHR AS chr, i, CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END AS third, MAF AS freq FROM ranked),
s AS (SELECT e.chr, e.i, sum(({_W}) * a.third) AS third, sum(({_W}) * a.freq) AS freq FROM e2 e JOIN a ON a.chr = e.chr AND a.i = e.j GROUP BY 1, 2)
SELECT a.chr, a.i, round(CAST(a.third + coalesce(s.third, 0) AS DOUBLE), 6) AS third, round(a.freq + coalesce(s.freq, 0), 6) AS freq FROM a LEFT JOIN s ON s.chr = a.chr AND s.i = a.i""", "edges ranked")
def ld_score_annotated(v):
    a = by_chr(v("ranked")).withColumn("third", F.expr("CASE WHEN idx % 3 = 0 THEN 1.0D ELSE 0.0D END")).withColumn("freq", F.col("MAF"))
    return rounded(ld.ld_scores(v("edges"), a, 500, ["third", "freq"], by=["chr"]))


@query(f"WITH {_BOTH}, c AS (SELECT chr, i, count(*) AS n FROM e2 GROUP BY 1, 2) SELECT v.CHR AS chr, v.i, coalesce(n, 0) AS neighbors, coalesce(n, 0) + 1 AS window_size FROM ranked v LEFT JOIN c ON c.chr = v.CHR AND c.i = v.i", "edges ranked")
def ld_window_size(v):
    return ld.window_size(v("edges"), by_chr(v("ranked")), by=["chr"])


@query("SELECT chr, i, j, CAST(round_even(r * 32767, 0) AS SMALLINT) AS q, round(round_even(r * 32767, 0) / 32767.0, 6) AS back FROM edges", "edges")
def quantize(v):
    e = v("edges").withColumn("q", S.quantize(F.col("r")))
    return rounded(e.select("chr", "i", "j", "q", S.dequantize(F.col("q")).alias("back")))


# --- linear algebra on edges -------------------------------------------------------------------------------------------

_X = "x AS (SELECT CHR AS chr, i, BETA AS x FROM ranked)"


def vector(v) -> DataFrame:
    return by_chr(v("ranked")).select("chr", "i", F.col("BETA").alias("x"))


@query(f"WITH {_BOTH}, {_X}, p AS (SELECT chr, i, 1.5 * x AS p FROM x UNION ALL SELECT e.chr, e.i, e.r * x.x FROM e2 e JOIN x ON x.chr = e.chr AND x.i = e.j) SELECT chr, i, round(sum(p), 9) AS y FROM p GROUP BY 1, 2", "edges ranked")
def ld_matvec(v):
    return rounded(banded.matvec(v("edges"), vector(v), by=["chr"], shift=0.5), 9)


@query(f"WITH {_X} SELECT e.chr, e.i, e.j, round(e.r + 0.25 * a.x * b.x, 10) AS r FROM edges e JOIN x a ON a.chr = e.chr AND a.i = e.i JOIN x b ON b.chr = e.chr AND b.i = e.j", "edges ranked")
def ld_rank_one(v):
    return rounded(banded.rank_one(v("edges"), vector(v), 0.25, by=["chr"]), 10)


@query(f"WITH {_BOTH} SELECT chr, i, j, round(r, 6) AS r FROM e2 UNION ALL SELECT CHR, i, i, 1.0 FROM ranked", "edges ranked")
def ld_symmetrize(v):
    return rounded(ld.symmetrize(v("edges"), by_chr(v("ranked")), by=["chr"]))


@query("""WITH s AS (SELECT chr, i, j, r FROM edges WHERE (i * 5 + j * 3) % 4 <> 0), m AS (SELECT chr, i, max(j) AS last FROM s GROUP BY 1, 2),
g AS (SELECT chr, i, unnest(range(i + 1, last + 1)) AS j FROM m) SELECT g.chr, g.i, CAST(g.j AS INTEGER) AS j, round(coalesce(s.r, 0), 6) AS r FROM g LEFT JOIN s ON s.chr = g.chr AND s.i = g.i AND s.j = g.j""", "edges")
def csr_repair(v):
    return rounded(banded.fill_gaps(v("edges").where("(i * 5 + j * 3) % 4 <> 0"), by=["chr"]))


@query(f"""WITH {_BOTH} SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(CASE WHEN a.i = b.j THEN 1 ELSE coalesce(e.r, 0) END, 6) AS r
FROM (SELECT unnest(range(10, 30)) AS i) a, (SELECT unnest(range(20, 45)) AS j) b LEFT JOIN (SELECT * FROM e2 WHERE chr = 3) e ON e.i = a.i AND e.j = b.j""", "edges")
def ld_submatrix(v):
    return rounded(banded.block(v("edges").where("chr = 3"), (10, 30), (20, 45)))


@query("WITH k AS (SELECT CHR AS chr, i, row_number() OVER (PARTITION BY CHR ORDER BY i) - 1 AS n FROM ranked WHERE idx % 3 <> 0) SELECT e.chr, a.n AS i, b.n AS j, round(e.r, 6) AS r FROM edges e JOIN k a ON a.chr = e.chr AND a.i = e.i JOIN k b ON b.chr = e.chr AND b.i = e.j", "edges ranked")
def ld_mask(v):
    return rounded(banded.apply_mask(v("edges"), by_chr(v("ranked")).where("idx % 3 <> 0").select("chr", "i"), by=["chr"]))


@query("SELECT v.CHR AS chr, v.i, least(v.i, coalesce(min(e.i), v.i)) AS leftmost FROM ranked v LEFT JOIN edges e ON e.chr = v.CHR AND e.j = v.i GROUP BY 1, 2", "edges ranked")
def ld_leftmost(v):
    return banded.leftmost(v("edges"), by_chr(v("ranked")), by=["chr"])


# --- selection ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_BOTH} SELECT DISTINCT chr, i FROM (SELECT CHR AS chr, i FROM ranked WHERE idx % 25 = 0 UNION ALL SELECT e.chr, e.j FROM e2 e JOIN ranked v ON v.CHR = e.chr AND v.i = e.i WHERE v.idx % 25 = 0 AND abs(e.r) >= 0.7)", "edges ranked")
def tagging_variants(v):
    return graph.tagging(v("edges"), by_chr(v("ranked")).where("idx % 25 = 0"), 0.7, by=["chr"])


def _greedy_sql(condition: str, order: str) -> str:
    """One pass along the order of each chromosome, with the kept ones of the walk in a list."""
    return f"""WITH o AS (SELECT CHR AS chr, i, row_number() OVER (PARTITION BY CHR ORDER BY {order}) AS k FROM ranked),
links AS (SELECT chr, i, list(j) AS near FROM (SELECT chr, i, j, r FROM edges UNION ALL SELECT chr, j, i, r FROM edges) WHERE {condition} GROUP BY chr, i),
n AS (SELECT o.chr, o.i, o.k, coalesce(l.near, []) AS near FROM o LEFT JOIN links l ON l.chr = o.chr AND l.i = o.i),
walk(chr, k, kept, i, took) AS (
  SELECT chr, k, [i], i, true FROM n WHERE k = 1
  UNION ALL SELECT n.chr, n.k, CASE WHEN list_has_any(w.kept, n.near) THEN w.kept ELSE list_append(w.kept, n.i) END, n.i, NOT list_has_any(w.kept, n.near) FROM walk w JOIN n ON n.chr = w.chr AND n.k = w.k + 1)
SELECT chr, i FROM walk WHERE took"""


@query(_greedy_sql("abs(r) >= 0.7", "i"), "edges ranked")
def ld_prune(v):
    return graph.prune(v("edges"), by_chr(v("ranked")), 0.7, by=["chr"])


@query(_greedy_sql("abs(r) >= 0.7", "abs(BETA / SE) DESC, i"), "edges ranked")
def ld_prune_ranked(v):
    return graph.prune(v("edges"), by_chr(v("ranked")).withColumn("rank", -F.abs(F.col("BETA") / F.col("SE"))), 0.7, by=["chr"], rank="rank")


@query(_greedy_sql("r * r > 0.3", "abs(BETA / SE) DESC, i"), "edges ranked")
def ld_clump(v):
    return graph.clump(v("edges"), by_chr(v("ranked")).withColumn("rank", -F.abs(F.col("BETA") / F.col("SE"))), 0.3, by=["chr"], rank="rank")


@query("""WITH e2 AS (SELECT chr, i, j, r FROM edges UNION ALL SELECT chr, j, i, r FROM edges), f AS (SELECT CHR AS chr, i, idx FROM ranked WHERE idx % 40 = 0)
SELECT chr, i, 0 AS part, CAST(idx AS BIGINT) AS ord FROM f UNION ALL
SELECT DISTINCT e.chr, e.j, 1, CAST(0 AS BIGINT) FROM e2 e JOIN f ON f.chr = e.chr AND f.i = e.i WHERE e.r * e.r > 0.5 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.chr = e.chr AND g.i = e.j)""", "edges ranked")
def expand_snps(v):
    return graph.expand(v("edges"), by_chr(v("ranked")).where("idx % 40 = 0").withColumn("ord", F.col("idx")), 0.5, by=["chr"])


@query("""WITH e2 AS (SELECT chr, i, j, r FROM edges UNION ALL SELECT chr, j, i, r FROM edges), z AS (SELECT CHR AS chr, i, BETA / SE AS z FROM ranked)
SELECT e.chr, e.i, round(avg((a.z - e.r * b.z) * (a.z - e.r * b.z) / (1 - e.r * e.r)), 6) AS T FROM e2 e JOIN z a ON a.chr = e.chr AND a.i = e.i JOIN z b ON b.chr = e.chr AND b.i = e.j WHERE e.r * e.r < 0.95 GROUP BY 1, 2""", "edges ranked")
def dentist_mismatch(v):
    stats = by_chr(v("ranked")).withColumn("Z", F.col("BETA") / F.col("SE"))
    return rounded(graph.mismatch(v("edges"), stats, 500, by=["chr"]))


# --- scores, phenotypes ---------------------------------------------------------------------------------------------------

_BETAS = "b AS (SELECT variant_idx, -0.2 + 0.5 * variant_idx / 63.0 AS s1, cos(variant_idx / 7.0) AS s2 FROM variants64)"


def betas(v) -> DataFrame:
    return v("variants64").select("variant_idx", F.expr("-0.2D + 0.5D * variant_idx / 63.0D").alias("s1"), F.expr("cos(variant_idx / 7.0D)").alias("s2"))


def _score_sql(g: str) -> str:
    return f"WITH {_BETAS}, {_FREQ} SELECT sample_idx, round(sum({g} * s1), 6) AS s1, round(sum({g} * s2), 6) AS s2 FROM calls JOIN b USING (variant_idx) JOIN freq USING (variant_idx) GROUP BY sample_idx"


@query(_score_sql("coalesce(dosage, 0)"), "calls variants64")
def pgs_raw(v):
    return rounded(scoring.score(v("calls"), betas(v), ["s1", "s2"]))


@query(_score_sql("coalesce(dosage, 2 * MAF)"), "calls variants64")
def pgs_impute(v):
    return rounded(scoring.score(v("calls"), betas(v), ["s1", "s2"], "impute"))


@query(_score_sql("(CASE WHEN dosage IS NULL OR MAF <= 0 OR MAF >= 1 THEN 0 ELSE (dosage - 2 * MAF) / sqrt(2 * MAF * (1 - MAF)) END)"), "calls variants64")
def pgs_standardize(v):
    return rounded(scoring.score(v("calls"), betas(v), ["s1", "s2"], "standardize"))


@query(f"WITH {_BETAS}, s AS (SELECT sample_idx, sum(coalesce(dosage, 0) * s2) AS s FROM calls JOIN b USING (variant_idx) GROUP BY sample_idx), {with_erfc('n', 's', 's')} SELECT sample_idx, round(CASE WHEN s < 0 THEN PV / 2 ELSE 1 - PV / 2 END, 5) AS prediction FROM n", "calls variants64")
def predict_binomial(v):
    return rounded(scoring.predict(scoring.score(v("calls"), betas(v), ["s2"]), "s2", "binomial"), 5)


@query("SELECT sample_idx, round((phenotype - avg(phenotype) OVER ()) / stddev_pop(phenotype) OVER (), 6) AS phenotype FROM samples", "samples")
def standardize_phenotype(v):
    return rounded(phenotype.standardize(v("samples")).select("sample_idx", "phenotype"))


@query("WITH c AS (SELECT regr_slope(phenotype, covar_2) AS b, regr_intercept(phenotype, covar_2) AS a FROM samples) SELECT sample_idx, round(phenotype - a - b * covar_2, 6) AS phenotype FROM samples, c", "samples")
def covariate_adjust(v):
    return rounded(phenotype.adjust(v("samples"), ["covar_2"]).select("sample_idx", "phenotype"))


@query(f"WITH r AS (SELECT sample_idx, (rank() OVER (ORDER BY phenotype) + (count(*) OVER (PARTITION BY phenotype) - 1) / 2.0 - 0.375) / (count(*) OVER () + 0.25) AS u FROM samples) SELECT sample_idx, round({S.qnorm_sql('u')}, 6) AS phenotype FROM r", "samples")
def rint(v):
    return rounded(phenotype.rint(v("samples")).select("sample_idx", "phenotype"))


@query("WITH s AS (SELECT *, avg(phenotype) OVER () AS m, stddev_pop(phenotype) OVER () AS d FROM samples) SELECT sample_idx, phenotype FROM s WHERE abs(phenotype - m) <= 1.5 * d", "samples")
def outlier_filter(v):
    return phenotype.outliers(v("samples"), sigma=1.5).select("sample_idx", "phenotype")


# --- heritability, simulation, spectra, plots ------------------------------------------------------------------------------


@query("SELECT round((avg((BETA / SE) * (BETA / SE)) - 1) * count(*) / (avg(1 + MAF * 40) * max(N)), 6) AS h2 FROM sumstats_v", "sumstats_v")
def ldsc_simple(v):
    stats = derive(v("sumstats_v"), ["SNP", "CHISQ", "N"])
    return rounded(association.simple_ldsc(stats, v("vars").select("SNP", (1 + F.col("MAF") * 40).alias("LDScore"))))


@query("""WITH a AS (SELECT *, BETA * BETA AS h FROM annot JOIN (SELECT SNP, BETA FROM vars) USING (SNP)), t AS (SELECT sum(h) AS h, count(*) AS m FROM a)
SELECT 'big' AS annotation, round((sum(a.h) / max(t.h)) / (count(*) / CAST(max(t.m) AS DOUBLE)), 6) AS enrichment FROM a, t WHERE big = 1
UNION ALL SELECT 'quarter', round((sum(a.h) / max(t.h)) / (count(*) / CAST(max(t.m) AS DOUBLE)), 6) FROM a, t WHERE quarter = 1""", "annot vars")
def enrichment(v):
    a = v("annot").join(v("vars").select("SNP", (F.col("BETA") * F.col("BETA")).alias("h2")), "SNP")
    return rounded(association.enrichment(a, ["big", "quarter"]))


@query()
def simulate_phenotype(v):
    return rounded(simulate.simulate(v("calls"), v("variants64"), 0.5, (0.5, 0.5), (0.0, 1.0), 7)[1])


@query()
def eigen_blocks(v):
    variants = banded.assign_blocks(lettered(v).withColumnRenamed("variant_idx", "i"), size=16)
    edges = ld.estimate(v("calls"), lettered(v), "sample", tile=16)
    return rounded(spectral.lambda_min(spectral.extremal_eigenvalues(edges, variants)))


@query()
def svd_blocks(v):
    variants = banded.assign_blocks(lettered(v).withColumnRenamed("variant_idx", "i"), size=16)
    return rounded(spectral.singular_values(ld.estimate(v("calls"), lettered(v), "sample", tile=16), variants, 5))


@query(f"WITH m AS (SELECT CHR, CAST(max(POS) AS BIGINT) AS m FROM vars GROUP BY CHR), o AS (SELECT CHR, coalesce(sum(m) OVER (ORDER BY CHR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m), {with_erfc('w', 'vars', 'BETA / SE')} SELECT CHR, POS, CAST(POS + o AS BIGINT) AS x, round(NL, 4) AS NLOG10_PVAL FROM w JOIN o USING (CHR)", "vars")
def manhattan_data(v):
    return rounded(plotdata.manhattan(derive(v("vars"), ["SNP", "CHR", "POS", "BETA", "SE", "NLOG10_PVAL"])), 4)


@query("SELECT round(-log10(count(*) OVER (ORDER BY MAF RANGE UNBOUNDED PRECEDING) / CAST(count(*) OVER () AS DOUBLE)), 6) AS expected, round(-log10(MAF), 6) AS observed FROM vars", "vars")
def qq_data(v):
    return rounded(plotdata.qq(v("vars"), "MAF"))
