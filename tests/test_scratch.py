"""Scratch tables go with the application that made them."""

import subprocess
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = """
import sys
from pyspark.sql import SparkSession
from waypost.operators import batching
from waypost.sources.scratch import filed
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
kept = filed(spark.range(10), "table")
print(kept.count(), batching.numbered(spark.range(100).toDF("place_id")).count())
spark.stop()
"""


def test_tables_go_at_the_end(tmp_path):
    out = subprocess.run([sys.executable, "-c", SAY, f"file://{tmp_path}"], cwd=ROOT, capture_output=True, text=True, timeout=200)
    assert out.stdout.split() == ["10", "100"], out.stderr
    for _ in range(50):  # the JVM ends after its Python
        left = list(tmp_path.rglob("*.parquet"))
        if not left:
            break
        time.sleep(0.2)
    assert not left
