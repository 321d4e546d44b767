"""The library works when the driver alone knows where it lies."""

import os
import subprocess
import sys
from pathlib import Path

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from codeloom.operators import graphs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
edges = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
print("BACK", graphs.back_edges(edges.selectExpr("src as id"), edges).count())
"""


def test_code_is_shipped_to_workers(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", RUN.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "BACK 1" in said.stdout, said.stderr[-2000:]
