"""The entry module must work from any working directory, Python workers included."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
print("rows", module.entry(spark).count())
for name in ("l1_l4_login_verdicts", "m6_m9_member_changes_verdicts"):
    print("rows", module.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_from_another_folder(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(here, "__spark_entry__.py")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    # 17 of the 1000 staged member changes repeat the number of another one.
    found = [line for line in done.stdout.splitlines() if line.startswith("rows")]
    assert found == ["rows 25", "rows 1000", "rows 983"], done.stderr[-2000:]
