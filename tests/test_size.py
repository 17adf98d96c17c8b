"""Queries of the correlation edges over a chromosome of so many variants that the edges' products are beyond 32 bits, and
their joins of sides that both grow."""

import os
import re

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from genoloom.operators import banded
from genoloom.plans import registry

#: Queries that are compared with their SQL there.
LONG = ["quantize", "ld_compressed", "ld_pair_table", "ld_replace_rows", "ld_stack_blocks", "ld_store_part", "ld_store_summary", "ld_symmetrize", "study_with_ld", "csr_repair", "ld_mask", "ld_block_iterator", "ld_matvec", "ld_score", "ld_snp_table", "ld_store_upkeep", "ld_prune", "ld_prune_ranked", "ld_prune_listed", "ld_dense_region", "command_extract", "command_expand", "expand_snps", "correlated_split"]


@pytest.fixture(scope="session")
def long(tmp_path_factory):
    """A folder of tables with 19,100 variants of chromosome 3 and 40 of every other one."""
    folder = tmp_path_factory.mktemp("long")
    ids = [*range(22 * 40), *range(22 * 40 + 2, 22 * 19_100, 22)]
    tables = {
        "part": {"p_partkey": ids, "p_size": pa.array([1 + i * 7 % 50 for i in ids], pa.int32()), "p_retailprice": [(90_000 + i * 37 % 20_011) / 100 for i in ids]},
        "lineitem": {"l_partkey": [i for i in ids for _ in range(i % 6)]},
        "supplier": {"s_suppkey": [1]}, "orders": {"o_orderkey": [1]}, "embeddings": {"vec_id": [1]},
    }
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
    return str(folder)


def want(folder, name):
    """The rows of the SQL with its products of 64 bits, as those of 32 end it by an error there."""
    base = duckdb.connect()
    for t in os.listdir(folder):
        base.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return base.execute(registry.SQL[name].replace("(a.i * 7919 + b.i * 104729)", "(CAST(a.i AS BIGINT) * 7919 + CAST(b.i AS BIGINT) * 104729)")).df()


def norm(d):
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        d[c] = d[c].astype(float).round(6) + 0.0 if d[c].dtype.kind in "fiub" else d[c].astype(str)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", LONG)
def test_edges_of_a_long_chromosome(name, spark, long):
    got = registry.QUERIES[name](spark, long).toPandas()
    pd.testing.assert_frame_equal(norm(got), norm(want(long, name)), check_dtype=False)


#: Queries and their broadcast joins in one plan (before and after it is adapted): those with a row for a bin or for a region.
JOINED = {"csr_repair": 0, "ld_mask": 0, "ld_block_iterator": 0, "ld_matvec": 0, "ld_score": 0, "ld_snp_table": 0, "ld_store_upkeep": 0, "ld_prune": 1, "ld_prune_ranked": 3, "ld_prune_listed": 3, "command_extract": 5, "ld_pair_table": 0, "correlated_split": 4, "ld_prune_in_rounds": 4}


@pytest.mark.parametrize("name", JOINED)
def test_no_side_that_grows_goes_through_the_driver(name, spark):
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.execution(k).get().physicalPlanDescription() for k in range(first, store.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans)
    assert max(len(re.findall(r"^\(\d+\) BroadcastHashJoin", p, re.M)) for p in plans) <= JOINED[name]


def test_dense_rows_join_no_side_through_the_driver(spark):
    variants = spark.range(40).selectExpr("id % 2 AS chr", "id DIV 2 AS i", "concat('rs', id) AS SNP")
    edges = spark.range(38).selectExpr("id % 2 AS chr", "id DIV 2 AS i", "id DIV 2 + 1 AS j", "id / 40D AS r")
    d = banded.dense(edges, variants.where("i < 10"), by=["chr"])
    assert d._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1  # a row for a chromosome
    rows = {(r.chr, r.i): r["values"] for r in d.collect()}
    e = {(c, k): (2 * k + c) / 40 for c in (0, 1) for k in range(9)}
    assert rows == {(c, i): [1.0 if i == j else e.get((c, min(i, j)), 0.0) if abs(i - j) == 1 else 0.0 for j in range(10)] for c in (0, 1) for i in range(10)}
