"""The operators with Python functions, started where the workers cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
for name in ("op2_jaccard_join", "op4_quality_classifier", "op6_bit_sliced_top_k", "op8_token_counts", "op9_best_fit_packing", "op10_toxicity", "op11_align_tokens", "op12_fill_in_middle", "op13_embedding_dedup", "chunk_text", "vector_top_k"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count(), name
print("all ran")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
