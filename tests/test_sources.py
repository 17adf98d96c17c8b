import numpy as np
import pytest

from genoloom.operators import banded
from genoloom.sources import bed, ldstore, sumstats, tables


def test_bed_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    g = rng.integers(-1, 3, (13, 11))
    calls = spark.createDataFrame([(s, v, None if g[v, s] < 0 else int(g[v, s])) for v in range(13) for s in range(11)], "sample_idx bigint, variant_idx bigint, dosage int")
    path = str(tmp_path / "x.bed")
    bed.write_bed(calls, path, 11)
    (tmp_path / "x.bim").write_text("".join(f"1 rs{k} 0.1 {k + 1} A C\n" for k in range(13)))
    (tmp_path / "x.fam").write_text("".join(f"F{k} I{k} 0 0 0 -9\n" for k in range(11)))
    bed.register(spark)
    read = spark.read.format("genoloom_bed").load(path)
    got = {(r.sample_idx, r.variant_idx): r.dosage for r in read.collect()}
    assert got == {(s, v): None if g[v, s] < 0 else int(g[v, s]) for v in range(13) for s in range(11)}
    assert spark.read.format("genoloom_bed").option("samples", "2,9").load(path).where("variant_idx >= 5").count() == 16
    numbered = tables.numbered(tables.read_bim(spark, path), "variant_idx").orderBy("variant_idx").collect()
    assert [r.SNP for r in numbered] == [f"rs{k}" for k in range(13)]
    assert tables.read_fam(spark, path).columns == ["FID", "IID", "fatherID", "motherID"]
    (tmp_path / "x.bed").write_bytes(b"no")
    with pytest.raises(Exception):
        spark.read.format("genoloom_bed").load(path).count()


def test_formats(spark, tmp_path):
    (tmp_path / "s.txt").write_text("CHR\tSNP\tPOS\tA1\tA2\tAF1\tN\tBETA\tSE\tP\n1\trs1\t10\tA\tC\t0.2\t100\t0.1\t0.05\t0.04\n1\trs2\t11\tA\tNA\tNA\t100\tNA\t0.05\t0.5\n")
    df = sumstats.read_sumstats(spark, str(tmp_path / "s.txt"), "fastgwa")
    assert [r.SNP for r in df.collect()] == ["rs1"] and {"MAF", "PVAL"} <= set(df.columns)
    theirs = sumstats.formatted(df.select("SNP", "A1", "MAF", "SE", "PVAL"), "cojo").columns
    assert theirs == ["SNP", "A1", "freq", "se", "p"]
    plink2 = spark.createDataFrame([("1", "rs1", "C", "A", "A", "0.1", "0.2")], "`#CHROM` string, ID string, REF string, ALT string, A1 string, BETA string, SE string")
    assert sumstats.canonical(plink2, sumstats.get_format("plink2")).first().A2 == "C"
    assert sumstats.essential(["CHR", "POS", "A1", "Z", "PVAL"]) == ["CHR", "POS", "A1", "Z"]


def test_gap_repair_and_store(spark, tmp_path):
    e = spark.createDataFrame([(1, 3, 0.25), (1, 5, -0.5), (4, 7, 0.125), (6, 7, 0.75)], "i bigint, j bigint, r double")
    full = banded.fill_gaps(e)
    filled = {(1, j): 0.0 for j in (2, 4)} | {(4, j): 0.0 for j in (5, 6)} | {(1, 3): 0.25, (1, 5): -0.5, (4, 7): 0.125, (6, 7): 0.75}
    assert {(r.i, r.j): r.r for r in full.collect()} == filled
    assert [r.indptr for r in banded.row_pointer(full, 8).orderBy("i").collect()] == [sum(i < k for i, _ in filled) for k in range(9)]
    with pytest.raises(ValueError, match="not contiguous around the diagonal"):
        banded.fill_gaps(e.where("i = 1"), strict=True)
    path = str(tmp_path / "store")
    v = spark.createDataFrame([(1, k, f"rs{k}") for k in range(8)], "chr int, i bigint, SNP string")
    ldstore.write_store(path, full.selectExpr("1 AS chr", "i", "j", "r"), v, {"estimator": "sample"})
    ldstore.validate(spark, path)
    back = {(r.i, r.j): r.r for r in ldstore.read_store(spark, path, chromosome=1).collect()}
    assert abs(back[(1, 5)] + 0.5) <= 0.5 / 32767 and len(back) == 8
    assert ldstore.summary(spark, path).first().entries == 8
