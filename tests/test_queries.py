import glob
import os
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from genoloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.SQL[name])


#: Queries whose rounded values are those of the SQL in every digit.
EXACT = ["gwas_linear", "gwas_standardized", "sumstats_derive", "big_gwas_linear"]


@pytest.mark.parametrize("name", EXACT)
def test_rounded_values_are_those_of_the_sql(name, spark):
    folder = "/root/testdata/sf0.01"
    base = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, folder), base.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    # adding zero takes the sign off a zero, a NaN equals no NaN
    rows = lambda r: sorted(tuple(repr(x + 0.0) if isinstance(x, float) else repr(x) for x in t) for t in r)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


#: Queries whose values on rounding ties go where those of the SQL go.
TIED = ["big_gwas_linear", "sumstats_derive", "gwas_standardized"]


@pytest.fixture(scope="session")
def tied(tmp_path_factory):
    """A folder of small tables with many ties: 320 calls of sum 323 have the frequency 0.5046875, odd numbers over 16,000 are z-scores."""
    folder = tmp_path_factory.mktemp("tied")
    ids = [i for i in range(1, 400) if i % 37][:320]
    dosage = lambda i: 0 if i < 80 else 1 if i < 237 else 2
    tables = {
        "lineitem": {"l_orderkey": ids, "l_suppkey": [1] * 320, "l_linenumber": [3 + dosage(i * 7 % 320) for i in range(320)], "l_partkey": [i % 100 for i in range(320)]},
        "orders": {"o_orderkey": ids, "o_totalprice": [100.0 * (i * 37 % 101) for i in ids]},
        "supplier": {"s_suppkey": [1]},
        "part": {"p_partkey": list(range(100)), "p_size": [15] * 100, "p_retailprice": [(108601 + 250 * i) / 100 for i in range(100)]},
        "embeddings": {"vec_id": ids, "embedding": [[dosage((i * 7 + v * 11) % 320) - 1.0 for v in range(64)] for i in range(320)], "label": [i * 13 % 7 for i in ids]},
    }
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", TIED)
def test_ties_are_rounded_as_by_the_sql(name, spark, tied):
    base = duckdb.connect()
    for p in glob.glob(f"{tied}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = base.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda r: sorted(tuple(repr(x + 0.0) if isinstance(x, float) else repr(x) for x in t) for t in r)
    assert rows(registry.QUERIES[name](spark, tied).select(*names).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", ["gwas_linear", "gwas_standardized"])
@pytest.mark.parametrize(("step", "label"), [(629, lambda i: 8 * (i % 2)), (37, lambda i: 10**14 + i * i * 37 % 1009)], ids=["without residual", "far from zero"])
def test_phenotypes_without_residual_or_far_from_zero(name, step, label, spark, tied, tmp_path):
    for p in glob.glob(f"{tied}/*.parquet"):
        shutil.copy(p, tmp_path)
    # ids that divide by 37: no call is missing but in two variants; if by 17 too, nothing is added to the label
    n = range(500)
    columns = {"vec_id": [step * (i + 1) for i in n], "embedding": [[2.0 * (i % 2) - 1 if v % 2 else (i * 7 + v) % 3 - 1.0 for v in range(64)] for i in n], "label": [label(i) for i in n]}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = base.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    rows = lambda r: sorted(tuple(repr(x + 0.0) if isinstance(x, float) else repr(x) for x in t) for t in r)
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert rows(got) == rows(want.fetchall())
    assert len(got) == 62 and sum(r.PVAL == 0 and r.NLOG10_PVAL == float("inf") for r in got) == (31 if step == 629 else 0)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_blocks_of_all_variants_are_looked_up_among_all_blocks(spark):
    from genoloom.plans.views import view

    folder = "/root/testdata/sf0.001"
    got = registry.QUERIES["asof_all_blocks"](spark, folder)
    assert got.count() == view(spark, folder, "vars").count()
    assert got.where("block_start % 20000 = 0").count() > 0 and got.where("block_start IS NULL").isEmpty()
