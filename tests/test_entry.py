"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["error"] < 1


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data operators, everything else imports."""
    for p in ("labelgrid", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "labelgrid/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1] == "False"


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nimport __spark_entry__ as e\nprint('rows', e.queries()['components_list'](s, '/root/testdata/sf0.001').count())"
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows" in out.stdout, out.stderr[-2000:]
