"""Loader, commands and streams over a small panel."""

import numpy as np
import pytest

from genoloom import cli, streaming
from genoloom.loader import Study
from genoloom.sources import bed, ldstore, tables


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("panel")
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (24, 60))
    g[1::4] = g[0::4]  # pairs of equal variants
    calls = spark.createDataFrame([(s, v, int(g[v, s])) for v in range(24) for s in range(60)], "sample_idx bigint, variant_idx bigint, dosage int")
    path = str(folder / "x.bed")
    bed.write_bed(calls, path, 60)
    (folder / "x.bim").write_text("".join(f"{'X' if k >= 16 else 1 + k // 8} rs{k} {k / 10} {1000 * k + 1} A C\n" for k in range(24)))
    (folder / "x.fam").write_text("".join(f"F{k} I{k} 0 0 {1 + k % 2} {g[0, k] + rng.normal():.4f}\n" for k in range(60)))
    (folder / "list.txt").write_text("rs5\nrs4\n")
    return folder, path, g


def rows(spark, path, header=True):
    return spark.read.csv(str(path), sep="\t", header=header).collect()


def test_study_reads_filters_and_splits(spark, panel):
    folder, path, g = panel
    s = Study.from_bed(spark, path)
    (folder / "y.txt").write_text("".join(f"F{k} I{k} {k if k % 3 else -9}\n" for k in range(50)))
    (folder / "c.txt").write_text("FID IID age\n" + "".join(f"F{k} I{k} {20 + k}\n" for k in range(60)))
    t = s.with_phenotype(spark, str(folder / "y.txt")).with_covariates(spark, str(folder / "c.txt"))
    assert t.samples.count() == 33 and t.calls.count() == 33 * 24 and t.covariates_table().columns == ["FID", "IID", "age"]
    assert t.phenotype_table().columns == ["FID", "IID", "phenotype"]
    kept = s.keep_variants(spark.createDataFrame([("rs1",), ("rs17",)], "SNP string"))
    assert kept.calls.count() == 120 and {c: x.variants.count() for c, x in kept.split().items()} == {1: 1, 23: 1}
    assert [round(r.MAF, 9) for r in s.snp_table(("SNP", "MAF", "POS")).orderBy("POS").collect()] == [round(x, 9) for x in g.mean(1) / 2]
    with pytest.raises(KeyError):
        s.snp_table(("SNP", "beauty"))
    assert s.frequent(min_mac=1000).variants.count() == 0
    assert tuple(s.sizes().first()) == (60, 24, 0, None)


def test_commands(spark, panel):
    folder, path, g = panel
    store = str(folder / "ld")
    cli.main(["compute-ld", "--bed", path, "--out", store, "--size", "6"])
    ldstore.validate(spark, store)
    cli.main(["prune", "--ld", store, "--r2", "0.9", "--out", str(folder / "kept")])
    kept = {r[0] for r in rows(spark, folder / "kept", header=False)}
    assert kept == {f"rs{k}" for k in range(24) if k % 4 != 1}
    cli.main(["prune", "--ld", store, "--r2", "0.9", "--snps", str(folder / "list.txt"), "--out", str(folder / "listed")])
    assert {r[0] for r in rows(spark, folder / "listed", header=False)} == {"rs5"}  # rs4 equals rs5, others aren't listed
    cli.main(["expand", "--ld", store, "--r2", "0.9", "--snps", str(folder / "list.txt"), "--out", str(folder / "wide")])
    assert {r[0] for r in rows(spark, folder / "wide", header=False)} == {"rs4", "rs5"}
    cli.main(["extract", "--ld", store, "--region", "chrX:16,001-18,001", "--region", "2:8001-8001", "--out", str(folder / "part")])
    assert {(r.SNP_A, r.SNP_B) for r in rows(spark, folder / "part")} == {("rs16", "rs17"), ("rs16", "rs18"), ("rs17", "rs18")}
    with pytest.raises(ValueError):
        cli.main(["extract", "--ld", store, "--region", "chrX:9-1", "--out", str(folder / "none")])
    cli.main(["gwas", "--bed", path, "--out", str(folder / "gwas"), "--format", "plink2"])
    found = rows(spark, folder / "gwas")
    assert len(found) == 24 and {"#CHROM", "ID", "P", "OBS_CT"} <= set(found[0].asDict())
    cli.main(["simulate", "--bed", path, "--out", str(folder / "sim"), "--causal", "0.5", "--prevalence", "0.3", "--seed", "4"])
    truth, y = rows(spark, folder / "sim" / "effects"), rows(spark, folder / "sim" / "phenotype")
    assert len(truth) == 24 and len(y) == 60 and {r.phenotype for r in y} == {"0", "1"}
    assert all((float(r.BETA) != 0) == (r.causal == "true") for r in truth)


def test_dense_extract(spark, panel):
    folder, path, _ = panel
    store = str(folder / "ld2")
    cli.main(["compute-ld", "--bed", path, "--out", store, "--estimator", "sample"])
    from genoloom.operators import banded

    e, v = ldstore.read_store(spark, store), ldstore.read_variants(spark, store)
    d = {r.SNP: r["values"] for r in banded.dense(e, v, by=["chr"]).where("chr = 1").collect()}
    assert len(d) == 8 and all(len(x) == 8 for x in d.values()) and abs(d["rs0"][1] - 1) < 1e-4 and d["rs0"][3] == d["rs3"][0]
    cli.main(["extract", "--ld", store, "--region", "1:1-3500", "--dense", "--out", str(folder / "dense")])
    lines = [r.value.split("\t") for r in spark.read.text(str(folder / "dense")).collect()]
    assert {x[1]: len(x) for x in lines} == {f"rs{k}": 6 for k in range(4)} and all(float(x[2 + int(x[1][2:])]) == 1 for x in lines)


def test_streams_give_what_tables_give(spark, tmp_path):
    calls = spark.createDataFrame([(s, v, (s + v) % 3 if s else None) for v in range(4) for s in range(6)], "sample_idx int, variant_idx int, dosage int")
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    q = streaming.running_frequency(stream).writeStream.format("memory").queryName("freq").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.variant_idx, r.N, r.MAF) for r in spark.table("freq").collect()} == {(r.variant_idx, r.N, r.MAF) for r in streaming.running_frequency(calls).collect()}

    events = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:10', 'a'), (TIMESTAMP'2024-01-01 00:00:50', 'a'), (TIMESTAMP'2024-01-01 00:03:00', 'b'), (TIMESTAMP'2024-01-01 02:00:00', 'c') t(at, k)")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = streaming.windowed_counts(stream, "at", "1 minute", "1 minute", ["k"]).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r["rows"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}

    lines = spark.createDataFrame([(1, 1, "0.1,2,3"), (2, 1, "1,2"), (3, 1, '1,"2,3')], "line_id int, file_id int, raw string")
    lines.write.parquet(str(tmp_path / "lines"))
    files = spark.createDataFrame([(1, "comma", "BETA,SE,PVAL")], "file_id int, separator string, column_list string")
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    q = streaming.unreadable(stream, files).writeStream.format("memory").queryName("bad").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("bad").collect()} == {(2, "columns"), (3, "quoting")}


def test_chromosome_names():
    assert [tables.chromosome(c) for c in ("7", "chr7", "X", "chrMT", "un")] == [7, 7, 23, 26, None]
