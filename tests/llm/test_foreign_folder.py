"""Queries run where neither the driver's folder nor the workers' path leads to the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.local.dir": "{tmp}", "spark.checkpoint.dir": "{tmp}/c"}}).getOrCreate()
spark.range(1).mapInPandas(lambda b: b, "id long").count()  # workers start before the package is on any path
spec = importlib.util.spec_from_file_location("__spark_entry__", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in {names}:
    print(name, entry.queries()[name](spark, "{sf}").count())
"""


def test_workers_without_the_package(sf, tmp_path):
    names = ["op3_topk", "op11_merkle", "op12_minhash", "op13_lexical"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", PROGRAM.format(tmp=tmp_path, root=ROOT, names=names, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0] for line in run.stdout.splitlines() if line.startswith("op")] == names
