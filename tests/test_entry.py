"""The driver contract, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["district", "received", "ready", "correction", "attention", "approved"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "casemill", tmp_path / "casemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    n, any_op = said.stdout.split()
    assert int(n) > 100 and any_op == "False", said.stderr
