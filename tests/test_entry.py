"""The driver's entry works with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(e.oracle_sql()) - set(q)))"


@pytest.mark.parametrize("gone", [["sitelattice/llm"], ["sitelattice/llm", "corpus_pipeline.py"]])
def test_core_without_the_training_data_subpackage(tmp_path, gone):
    for part in ("sitelattice", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    for part in gone:
        if (tmp_path / part).is_dir():
            shutil.rmtree(tmp_path / part)
        elif (tmp_path / part).exists():
            (tmp_path / part).unlink()
    said = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, optional, unknown = map(int, said.stdout.split()[-3:])
    assert n > 60 and optional == 0 and unknown == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
