"""Queries whose tasks run the package's own code, from a folder that is not the repository's."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# the driver finds the package by its path alone; workers inherit neither that path nor the working folder
PROGRAM = f"""
import json, sys
sys.path.insert(0, {REPO!r})
from typeharvest.session import local_session
spark = local_session(4, 4)
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
found = entry.queries()
counts = {{name: found[name](spark, "/root/testdata/sf0.001").count() for name in ("ex5_file_info", "ex6_ex12_extract_annotations")}}
counts["entry"] = entry.entry(spark).count()
here = spark.range(1).rdd.map(lambda _: [p for p in sys.path if p.rstrip("/") == {REPO!r}]).first()
print(json.dumps([counts, here]))
"""


def test_file_queries_run_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    counts, repo_on_workers = json.loads(run.stdout.strip().splitlines()[-1])
    assert repo_on_workers == []  # nothing but the shipped archive holds the package there
    assert counts["ex5_file_info"] == 1500 and counts["ex6_ex12_extract_annotations"] > 100 and counts["entry"] == 50
