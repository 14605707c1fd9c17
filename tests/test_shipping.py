"""Executors must not need the package installed: run a UDF query from a
foreign folder, with the repository only on the driver's path."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as E
n = E.queries()["label_similar"](spark, "/root/testdata/sf0.001").count()
m = E.queries()["manifest_files"](spark, "/root/testdata/sf0.001").count()
print("OK", n, m)
spark.stop()
"""


def test_udfs_run_without_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
