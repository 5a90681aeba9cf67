"""The engine without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'flagship' in q and 'flagship' in o and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidewheel")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert not re.search(r"tidewheel[.]llm|from tidewheel import.*llm", text), name


def test_queries_without_spark_defaults(tmp_path):
    code = """
from tidewheel.session import session
from tidewheel import plans
spark = session("bare", "local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
print(plans.QUERIES["copy_roundtrip_csv"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") or k == "SPARK_HOME"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**env, "PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}, check=True, timeout=120)
