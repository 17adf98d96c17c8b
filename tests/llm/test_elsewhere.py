"""The queries started from a folder where workers can't import the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in ("p2_found", "p5_percentiles", "p6_found", "p7_containers", "p8_found", "p9_found"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_workers_need_not_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.count("True") == 6, out.stdout + out.stderr[-3000:]
