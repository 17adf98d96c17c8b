import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("GENOLOOM_SHUFFLE", "4")
os.environ.setdefault("GENOLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from genoloom.session import local_session

    return local_session(4)


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables and compares the rows."""
    import glob

    import duckdb
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def norm(d):
        d = d[sorted(d.columns)].copy()
        for c in d.columns:
            if d[c].dtype.kind in "fiub":
                d[c] = d[c].astype(float).round(6) + 0.0
            else:
                d[c] = d[c].map(lambda x: None if pd.isna(x) else str(x))
        return d.sort_values(list(d.columns)).reset_index(drop=True)

    def run(f, sql):
        got, want = f(spark, folder).toPandas(), base.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False)

    return run
