"""The first call of an operator in a fresh process whose workers don't have the package on their path."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lexiloom.llm import {module}
docs = spark.createDataFrame([(1, "a b c under the MIT License. d"), (2, "")], "doc_id long, text string")
print("rows", {module}.{call}(docs).count())
print("again", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))
"""


def told(folder, module, call):
    run = subprocess.run([sys.executable, "-B", "-c", CODE.format(root=str(ROOT), module=module, call=call)], cwd=folder, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.split()


def test_first_calls(tmp_path):
    assert told(tmp_path, "packing", "pack_documents")[:2] == ["rows", "1"]
    scanned = told(tmp_path, "license_scan", "scan")
    assert scanned[:2] == ["rows", "1"] and scanned[2:] != ["again", "4m"]  # operators leave the session's settings alone
