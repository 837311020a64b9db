"""All queries run where the executors' Python has no copy of this repository."""

import os
import subprocess
import sys

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
import __spark_entry__ as entry
from dossier.llm import queries
for name in [*queries.QUERIES, "pipeline"]:
    rows = entry.queries()[name](spark, {sf!r}).count()
    print("ran", name, rows)
"""


def test_queries_run_without_the_package_on_the_executors(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"), sf=SF)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.count("ran ") == 14, run.stdout + run.stderr[-3000:]
