"""Tasks must run on workers that cannot import this package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as contract
from panelweave.session import local_session
spark = local_session("4", 4)
seen = spark.range(1, numPartitions=1).mapInArrow(lambda b: (__import__("importlib").import_module("panelweave") and x for x in b), "id long")
try:
    seen.collect()
    raise SystemExit("the package can be imported by the workers: the test tests nothing")
except Exception as error:
    assert "ModuleNotFoundError" in str(error)
queries = contract.queries()
for name in {names!r}:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
spark.stop()
print("all ran")
"""
NAMES = [
    "op2_language_id", "op3_packing", "op4_fingerprints", "op5_near_dedup", "op6_suffix_dedup", "op8_html_extraction", "op10_secret_scan",
    "op11_fill_in_middle", "op12_collocations", "pipeline",
]


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO, names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stdout[-2000:] + done.stderr[-4000:]
