"""Operators of genetics against plain versions of them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.functions import stats as S
from genoloom.operators import association, graph, ld
from genoloom.sources import sumstats


def test_p_values_hold_in_the_tails(spark):
    zs = [0.0, 0.3, -1.96, 3.0, 5.0, -6.0, 10.0, 25.0, 37.0, 100.0, None]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.pvalue("z").alias("p"), S.nlog10_pvalue("z").alias("n")).collect()
    for r in rows[:-2]:
        exact = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p / exact - 1) < 2e-7 and abs(r.n + math.log10(exact)) < 1e-6
    assert abs(rows[-2].n - (5000 / math.log(10) + math.log10(math.sqrt(math.pi / 2) * 100))) < 1e-3 and rows[-1].p is None and rows[-1].n is None


def test_p_values_are_right_to_the_last_digits(spark):
    rows = spark.range(4001).selectExpr("id * 0.01D - 3 AS z").select("z", S.pvalue("z").alias("p"), S.nlog10_pvalue("z").alias("n"), F.expr(S.norm_cdf_sql("z")).alias("c")).collect()
    for r in rows:
        exact = math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p / exact - 1) < 1e-15 * (1 + r.z * r.z) and abs(r.n + math.log10(exact)) < 1e-15 * (1 + r.z * r.z)
        assert abs(r.c - math.erfc(-r.z / math.sqrt(2)) / 2) < 1e-15
    zero = spark.sql("SELECT 0D AS z").select(S.pvalue("z").alias("p"), S.nlog10_pvalue("z").alias("n")).first()
    assert (zero.p, zero.n) == (1.0, 0.0)


def test_linear_association_of_a_phenotype_far_from_zero(spark):
    calls = spark.range(400).selectExpr("id DIV 2 AS sample_idx", "id % 2 AS variant_idx", "CAST((id * 7 + id DIV 5) % 3 AS INT) AS dosage")
    rows = [association.linear(calls, spark.range(200).selectExpr("id AS sample_idx", f"(id * 37 % 101) / 64D + {at} AS phenotype")).orderBy("variant_idx").collect() for at in (0, 10**8)]
    for a, b in zip(*rows):
        assert a.SE == pytest.approx(b.SE, rel=1e-7) and a.PVAL == pytest.approx(b.PVAL, rel=1e-6)


@pytest.mark.parametrize(("name", "own"), [("plink", "plink2"), ("plink2", "plink2"), ("plink1.9", "plink1.9"), ("gwas-ssf", "ssf"), ("gwascatalog", "ssf"), ("GWAS-Catalog", "ssf"), ("gcta", "fastgwa"), ("saige", "saige")])
def test_aliases_of_formats(name, own):
    assert sumstats.get_format(name).name == own


def sequential(n, links, order):
    near = {i: set() for i in range(n)}
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    kept = set()
    for i in order:
        if not near[i] & kept:
            kept.add(i)
    return kept


def test_a_chain_through_a_chromosome_is_one_pass(spark):
    n = 100_000
    v = spark.range(n).select(F.col("id").alias("i"))
    e = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(0.9).alias("r"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = [r.i for r in graph.prune(e, v, 0.5).collect()]
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(kept) == list(range(0, n, 2)) and jobs < 40


def test_selection_equals_the_sequential_one_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(graph, "BIN", 4)
    rng = np.random.default_rng(2)
    n = 120
    links = {(int(i), int(min(n - 1, i + d))) for i, d in zip(rng.integers(0, n, 150), rng.integers(1, 6, 150))} - {(n - 1, n - 1)}
    rank = rng.permutation(n)
    e = spark.createDataFrame([(i, j, 0.9) for i, j in links if i < j], "i bigint, j bigint, r double")
    v = spark.createDataFrame([(i, float(rank[i]) if i % 10 else None) for i in range(n)], "i bigint, x double")
    got = lambda **how: {r.i for r in graph.prune(e, v, 0.5, **how).collect()}
    order = [i for i in np.argsort(rank).tolist() if i % 10]  # variants without a rank are never kept
    assert got() == sequential(n, links, range(n))
    assert got(rank="x") == got(rank="x", piece_rows=3) == got(rank="x", piece_rows=0) == sequential(n, links, order)
    assert graph.prune(e.limit(0), v.limit(0), 0.5, rank="x").count() == 0


def test_removal_is_capped_apart_for_associated_variants(spark):
    n = 40
    e = spark.createDataFrame([(i, j, 0.0) for i in range(n) for j in range(i + 1, n)], "i int, j int, r double")
    z = [30.0 if i < 3 else 0.1 for i in range(n)]
    stats = spark.createDataFrame(list(enumerate(z)), "i int, Z double")
    assert {r.i for r in graph.drop_mismatched(e, stats, 500, rounds=2, cap=0.03).collect()} == set(range(3, n))
    few = e.where("j - i <= 2")  # fewer neighbours than are needed to judge
    assert graph.drop_mismatched(few, stats, 500).count() == n


def test_correlation_of_many_samples_in_blocks(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(-1, 3, (6, 50))
    g[3] = 1  # constant
    calls = spark.createDataFrame([(s, v, None if g[v, s] < 0 else int(g[v, s]), "x") for v in range(6) for s in range(50)], "sample_idx bigint, variant_idx bigint, dosage int, chr string")
    b = ld.count_bounds(spark.createDataFrame([(v, 1) for v in range(6)], "variant_idx bigint, chr int"), 4)
    for impute in (True, False):
        one, many = ({(r.i, r.j): r.r for r in ld.banded(calls, b, tile=2, impute=impute, sample_block=k).collect()} for k in (1000, 7))
        assert one.keys() == many.keys() == {(i, j) for i in range(6) for j in range(i + 1, min(6, i + 4))}
        for (i, j), r in one.items():
            both = (g[i] >= 0) & (g[j] >= 0)
            x, y = (np.where(g[k] >= 0, g[k] - g[k][g[k] >= 0].mean(), 0.0) for k in (i, j))
            v = lambda k: g[k][g[k] >= 0].var()
            scale = math.sqrt((x**2).sum() * (y**2).sum()) if impute else math.sqrt(v(i) * v(j)) * both.sum()
            want = (x * y).sum() / scale if scale > 1e-12 else 0.0
            assert abs(r - want) < 1e-12 and abs(many[i, j] - want) < 1e-12
    assert ld.banded(calls.limit(0), b).count() == 0
